"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session's setting that a query's shuffle files go when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where written tables lie.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The folders that tables are written to within `alone`.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tilespan-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files: Spark removes them when it ends, not when the driver's garbage collector comes to them."""
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: cuts lineage, and a lost executor costs a re-read."""
    return appended(df.sparkSession, iter([df]), name)


def appended(spark: SparkSession, parts: Iterator[DataFrame], name: str) -> DataFrame:
    """The rows of all parts (one at least, of one schema) as `written` has them; a part is made when the one before is written and its shuffle files are gone."""
    at = new_folder(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(at)
    for df in parts:
        with shuffles_removed(spark):
            df.write.mode("append").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    _PLACES[out] = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(*tables: DataFrame) -> None:
    """Deletes tables as `written` returned them; what reads them has to be written itself by now."""
    for df in tables:
        _delete(df.sparkSession, _PLACES.pop(df))


def alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns, written; the tables that were written on the way to it are deleted."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        out = written(make(), name)
    finally:
        _MADE.reset(before)
    at = _PLACES[out]
    for other in made:
        if other != at:
            _delete(out.sparkSession, other)
    if (outer := _MADE.get()) is not None:
        outer.append(at)
    return out


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as it takes to be none of columns (whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column as binary (UTF-8), nulls as empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"")


def in_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `column` holds about `limit` bytes in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_slices(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str) -> DataFrame:
    """mapInArrow over slices of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, column):
            out = each(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def remainder(column: str, n: int) -> F.Column:
    """crc32 of an id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def connected(edges: DataFrame, name: str = "links") -> DataFrame:
    """(u, v) long links -> (node, root), root the least node reachable; only nodes with a link appear.

    Alternates large-star and small-star rounds, each a shuffle over the links that remain; every round is
    written to the shared folder, where the one before goes, and only its count of changes comes to the driver.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, name)
        removed(now, large)
        # Done when every node hangs on one root and no root is itself a child.
        more = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() + after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        now = after
        if not more:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
