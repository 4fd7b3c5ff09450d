import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tilespan.operators import tasks
from tilespan.streaming import feeds

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _at(ms):
    return START + dt.timedelta(milliseconds=ms)


def _plain(events, seconds=0.5):
    out = set()
    by_key = {}
    for i, k, ms in events:
        by_key.setdefault(k, []).append((ms, i))
    for rows in by_key.values():
        rows.sort()
        sent = None
        for ms, i in rows:
            if sent is None or ms - sent >= seconds * 1000:
                sent = ms
                out.add(i)
        out.add(rows[-1][1])
    return out


def _frame(spark, events):
    return spark.createDataFrame([(i, k, _at(ms)) for i, k, ms in events], "i long, k long, ts timestamp")


def test_half_a_second_since_the_last_one_sent(spark):
    events = [(i, 1, ms) for i, ms in enumerate((0, 900, 1100, 1300, 2600))]
    assert sorted(r.i for r in tasks.throttled(_frame(spark, events), "k").collect()) == [0, 1, 4]
    assert sorted(r.i for r in tasks.throttled(_frame(spark, events[:4]), "k").collect()) == [0, 1, 3]  # the last goes out too soon


@pytest.mark.parametrize(("seed", "stretch"), [(1, 3600), (2, 2), (3, 1)])
def test_bursts_over_stretches_and_batches(spark, seed, stretch):
    rng = random.Random(seed)
    events, i = [], 0
    for k in range(8):
        ms = rng.randrange(3000)
        for _ in range(rng.randrange(1, 120)):
            events.append((i, k, ms))
            ms += rng.choice([0, 10, 130, 250, 490, 499, 500, 501, 900, 5000])
            i += 1
    rng.shuffle(events)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = tasks.throttled(_frame(spark, events), "k", ("i",), stretch=stretch)
        assert found.columns == ["i", "k", "ts"] and sorted(r.i for r in found.collect()) == sorted(_plain(events))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_keys_times_and_no_events(spark):
    rows = [(1, None, _at(0)), (2, None, _at(100)), (3, None, _at(700)), (4, 5, None), (5, 5, _at(0))]
    assert sorted(r.i for r in tasks.throttled(spark.createDataFrame(rows, "i long, k long, ts timestamp"), "k", ("i",)).collect()) == [1, 3, 4, 5]
    assert tasks.throttled(spark.createDataFrame([], "i long, k long, ts timestamp"), "k").collect() == []


def test_pausing_adds_the_open_seconds(spark):
    rows = spark.createDataFrame([(1, "running", 10), (2, "retrying", None), (3, "paused", 5), (4, "running", 1)], "task long, status string, running_seconds long")
    records = spark.createDataFrame([(1, "start", _at(0)), (1, "resume", _at(60_000)), (1, "pause", _at(70_000)), (2, "start", _at(99_500)), (3, "start", _at(0))], "task long, action string, ts timestamp")
    held, made = tasks.paused(rows, records, F.lit(_at(100_900)))
    assert {r.task: (r.status, r.running_seconds) for r in held.collect()} == {1: ("paused", 50), 2: ("paused", 1), 3: ("paused", 5), 4: ("paused", 1)}
    assert sorted((r.task, r.action) for r in made.collect()) == [(1, "pause"), (2, "pause"), (4, "pause")]


def test_a_feed_keeps_the_time_last_sent(spark, tmp_path):
    events = [(0, 1, 0, False), (1, 1, 900, False), (2, 1, 1100, False), (3, 2, 0, False), (4, 1, 1300, False), (5, 1, 1350, True), (6, 2, 499, False), (7, 1, 1800, False), (8, 1, 1850, False), (9, 2, 500, False)]
    source = str(tmp_path / "in")
    for part in (events[:3], events[3:6], events[6:]):
        spark.createDataFrame([(i, k, _at(ms), done) for i, k, ms, done in part], "i long, k long, ts timestamp, done boolean").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("i long, k long, ts timestamp, done boolean").option("maxFilesPerTrigger", 1).parquet(source)
    run = feeds.throttled(stream, "k", F.col("done")).writeStream.outputMode("append").format("memory").queryName("sent").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.i for r in spark.table("sent").collect()) == [0, 1, 3, 5, 8, 9]
