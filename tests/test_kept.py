from pathlib import Path

from pyspark.sql import functions as F

from tilespan.streaming import kept

SCHEMA, KEYS = "task long, kind string, status string, seq long", ["task", "kind"]


def _rows(df):
    return {(r.task, r.kind): (r.status, r.seq) for r in df.collect()}


def test_batches_touch_their_buckets_only_and_once(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    assert kept.read(spark, folder) is None
    put = lambda old, new: kept.upserted(old, new, KEYS, ["seq"])
    first = spark.createDataFrame([(i, "k", "queued", i) for i in range(200)] + [(5, "k", "later", 900)], SCHEMA)
    assert kept.merge(folder, 0, first, KEYS, put, SCHEMA, buckets=16)
    assert _rows(kept.read(spark, folder)) == {(i, "k"): ("queued", i) if i != 5 else ("later", 900) for i in range(200)}
    before = kept.commit_of(spark, folder)["held"]
    second = spark.createDataFrame([(7, "k", "running", 1000), (7, "new", "queued", 1001)], SCHEMA)
    assert kept.merge(folder, 1, second, KEYS, put, SCHEMA)
    after = kept.commit_of(spark, folder)["held"]
    assert sum(before.get(b) != at for b, at in after.items()) <= 2 and len(before) > 10
    files = len(list(Path(folder).rglob("*.parquet")))
    assert not kept.merge(folder, 1, second.withColumn("status", F.lit("again")), KEYS, put, SCHEMA)
    assert len(list(Path(folder).rglob("*.parquet"))) == files
    now = _rows(kept.read(spark, folder))
    assert now[7, "k"] == ("running", 1000) and now[7, "new"] == ("queued", 1001) and len(now) == 201
    assert _rows(kept.read(spark, folder, upto=0))[7, "k"] == ("queued", 7)


def test_a_running_row_refuses_and_deletion_empties_buckets(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    guarded = lambda old, new: kept.upserted(old, new, KEYS, ["seq"], F.col("status") == "running")
    kept.merge(folder, 3, spark.createDataFrame([(1, "k", "running", 1), (2, "k", "failed", 2), (3, None, None, 3)], SCHEMA), KEYS, guarded, SCHEMA)
    kept.merge(folder, 4, spark.createDataFrame([(1, "k", "queued", 9), (2, "k", "queued", 9)], SCHEMA), KEYS, guarded, SCHEMA)
    rows = _rows(kept.read(spark, folder))
    assert rows == {(1, "k"): ("running", 1), (2, "k"): ("queued", 9), (3, None): (None, 3)}
    kept.merge(folder, 5, spark.createDataFrame([(1, "k", None, 0), (2, "k", None, 0)], SCHEMA), KEYS, lambda old, gone: kept.without(old, gone, KEYS), SCHEMA)
    assert _rows(kept.read(spark, folder)) == {(3, None): (None, 3)}
    # A batch that failed before its commit leaves a folder and changes nothing.
    (Path(folder) / "data" / f"{6:020d}").mkdir()
    assert _rows(kept.read(spark, folder)) == {(3, None): (None, 3)}
    assert kept.merge(folder, 6, spark.createDataFrame([], SCHEMA), KEYS, guarded, SCHEMA)
    assert _rows(kept.read(spark, folder)) == {(3, None): (None, 3)}
