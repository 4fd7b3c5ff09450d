import datetime as dt

from tilespan.operators import ledger
from tilespan.streaming import feeds

SCHEMA = "task long, zoom int, x long, y long, outcome string, ts timestamp"


def rows():
    start = dt.datetime(2024, 1, 1)
    outcomes = ["success", "no_data", "retryable_failure", "cache_failure"]
    return [(i % 3, 5, i % 7, 0, outcomes[(i * 5) % 4], start + dt.timedelta(seconds=i)) for i in range(200)]


def test_counts_and_ledger(spark, tmp_path):
    data = rows()
    source = str(tmp_path / "in")
    for part in (data[:90], data[90:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = feeds.outcome_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("counts").groupBy("task").sum("n_success").collect()
    assert len(got) == 3
    query = feeds.keep_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    last = {}
    for t, z, x, y, o, ts in data:
        last[t, z, x, y] = max(last.get((t, z, x, y), (ts, o)), (ts, o))
    want = {(*k, o) for k, (_, o) in last.items() if o != "success"}
    assert {(r.task, r.zoom, r.x, r.y, r.outcome) for r in feeds.read_ledger(spark, str(tmp_path / "ledger")).collect()} == want


def test_rates(spark):
    start = dt.datetime(2024, 1, 1)
    samples = spark.createDataFrame([(1, start + dt.timedelta(seconds=i), 300) for i in range(10)], "task long, ts timestamp, bytes long")
    got = {r["at"]: r.rate for r in feeds.rates(samples).collect()}
    assert got[start + dt.timedelta(seconds=5)] == 300.0


def test_merge(spark):
    keys = ["task", "zoom", "x", "y"]
    old = spark.createDataFrame([(1, 1, 0, 0, "no_data", 0), (1, 1, 0, 1, "cache_failure", 2), (1, 1, 1, 1, "no_data", 0)], "task long, zoom int, x long, y long, outcome string, retries int")
    new = spark.createDataFrame([(1, 1, 0, 0, "success"), (1, 1, 0, 1, "no_data"), (2, 1, 0, 0, "cache_failure"), (2, 1, 1, 0, "success")], "task long, zoom int, x long, y long, outcome string")
    assert {tuple(r) for r in ledger.merge(old, new, keys).collect()} == {(1, 1, 0, 1, "no_data", 3), (1, 1, 1, 1, "no_data", 0), (2, 1, 0, 0, "cache_failure", 0)}
