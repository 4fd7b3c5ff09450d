"""The corpus pipeline: documents from raw to packed training sequences.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, and what one
stage returns is written as Parquet and read again as the next one's docs. The classifiers learn from the labels
of sf_dir; the last stage returns packed pieces, the others documents with all their columns. The stages set the
session to remove a query's shuffle files when it ends, so that those of earlier stages are not on disk in later ones;
run deletes what a stage has read and what it has written on its way when its result is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespan.llm import exact_dedup, gam, near_text, packing, text_cnn
from tilespan.llm.common import REMOVE_SHUFFLES, alone, remainder, removed, unused

#: Documents of a lower quality score go.
KEEP_QUALITY = 0.5


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(REMOVE_SHUFFLES, "true")
        return work(spark, docs, sf_dir)

    return run


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of KEEP_QUALITY or more; null and empty texts are scored, repeated rows each by itself."""
    (name,) = unused(docs.columns, "quality_score")
    model = gam.fit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "quality", remainder("doc_id", 4) != 2)
    return gam.score(docs, model, name).where(F.col(name) >= KEEP_QUALITY).select(*docs.columns)


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold; null and empty texts are scored, repeated rows each by itself."""
    name, limit, flag = unused(docs.columns, "toxic_score", "toxic_limit", "toxic_flag")
    net = text_cnn.fit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 3) != 1)
    return text_cnn.score(docs, net, name, limit_name=limit, flag_name=flag).where(~F.col(flag)).select(*docs.columns)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null: empty), the one with the largest doc_id; of rows that repeat doc_id and text, one."""
    return exact_dedup.deduplicate(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the least doc_id; texts without words are alike."""
    return near_text.deduplicate(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences; a null text is the empty one. No documents: no pieces."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: The classifiers' and the packer's decisions can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of sf_dir."""
    docs, last = _read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = alone(partial(stage, spark, docs, sf_dir), f"stage-{name}")
        removed(*last)
        last = [docs]
    return docs
