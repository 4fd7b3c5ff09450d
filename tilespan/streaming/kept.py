"""A keyed table that batches are merged into: Parquet by hashed bucket, and a small commit file that says which folder holds each bucket.

A merge reads and rewrites the buckets that its batch touches, and no others. The commit file is written last and moved
into place, so a batch that fails half-way changes nothing, and one that runs again finds its number and does nothing.
One writer at a time: batches come with rising numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilespan.tables import written

BUCKETS = 64


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []


def commit_of(spark: SparkSession, folder: str, upto: int | None = None) -> dict | None:
    """The newest commit, or the newest of a number up to `upto`: number, buckets, schema, and held (the folder of each bucket)."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{folder}/commits") if n.endswith(".json")]
    numbers = [n for n in numbers if upto is None or n <= upto]
    if not numbers:
        return None
    fs, path = _files(spark, folder)
    stream = fs.open(path(f"{folder}/commits/{max(numbers):020d}.json"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _rows(spark: SparkSession, folder: str, commit: dict, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(commit["schema"])
    held = [f"{folder}/{at}" for b, at in commit["held"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame | None:
    """The table after the newest merge, or after that of number `upto`; None before the first one."""
    commit = commit_of(spark, folder, upto)
    return _rows(spark, folder, commit) if commit else None


def merge(folder: str, number: int, changes: DataFrame, keys: list[str], apply: Callable[[DataFrame, DataFrame], DataFrame], schema: str, buckets: int = BUCKETS) -> bool:
    """Merges a batch: apply(rows of the touched buckets, changes) gives these buckets' rows (of the schema, by the same keys).

    False if the batch was merged before. buckets counts for the first merge; later ones keep its number.
    """
    spark = changes.sparkSession
    last = commit_of(spark, folder)
    if last and number <= last["number"]:
        return False
    count = last["buckets"] if last else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
    staged = written(changes, "changes")
    touched = {r.b for r in staged.select(bucket.alias("b")).distinct().collect()}  # no more than there are buckets
    empty = spark.createDataFrame([], schema)
    old = _rows(spark, folder, last, touched) if last else empty
    now = apply(old, staged).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema))
    place = f"data/{number:020d}"
    now.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/{place}")
    made = {n.partition("=")[2] for n in _names(spark, f"{folder}/{place}") if n.startswith("_bucket=")}
    held = {b: at for b, at in (last["held"] if last else {}).items() if int(b) not in touched} | {b: f"{place}/_bucket={b}" for b in made}
    _commit(spark, folder, {"number": number, "buckets": count, "schema": json.loads(empty.schema.json()), "held": held})
    return True


def _commit(spark: SparkSession, folder: str, commit: dict) -> None:
    fs, path = _files(spark, folder)
    name = f"{folder}/commits/{commit['number']:020d}.json"
    out = fs.create(path(f"{name}.part"), True)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    if not fs.rename(path(f"{name}.part"), path(name)):
        raise RuntimeError(f"another writer has committed {commit['number']}")


def upserted(old: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None, guard: F.Column | None = None) -> DataFrame:
    """old with the last change (by `order`) of each key (not null) in place of its row; rows for which guard holds refuse to change."""
    others = [c for c in old.columns if c not in keys]
    new = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*(order or others))).alias("_new"))
    stays = F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(False)
    both = old.withColumn("_had", F.lit(True)).withColumn("_stays", stays).join(new, keys, "full_outer")
    take = F.col("_new").isNotNull() & ~F.coalesce("_stays", F.lit(False))
    return both.select(*(F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c not in keys else F.col(c) for c in old.columns))


def without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """old less the rows of the given keys (some of its own)."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")
