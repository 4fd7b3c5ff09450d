"""Task history, statistics, paging, running time and transfer rates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespan.schemas import ACTIVE_STATES, SUCCESSFUL_STATES


def status_filter(status: str) -> Column:
    """`active` and `completed` stand for their states, any other word for itself."""
    groups = {"active": ACTIVE_STATES, "completed": SUCCESSFUL_STATES}
    return F.col("status").isin(*groups.get(status, (status,)))


def timeline(branches: dict[str, DataFrame], status: str | None = None) -> DataFrame:
    """All pipelines' tasks in one table with task_type; columns that a pipeline lacks are null. The filter goes into every branch."""
    named = [df.withColumn("task_type", F.lit(kind)) for kind, df in branches.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return rows.where(status_filter(status)) if status else rows


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first; task_type settles what created_at and id leave open."""
    return rows.orderBy(F.desc("created_at"), F.desc("id"), "task_type").offset((number - 1) * size).limit(size)


def paging(rows: DataFrame, size: int) -> DataFrame:
    """total_count, total_pages."""
    return rows.agg(F.count("*").alias("total_count")).withColumn("total_pages", F.ceil(F.col("total_count") / size).cast("long"))


def statistics(rows: DataFrame) -> DataFrame:
    """Tasks, done, failed and downloaded of each pipeline and of all (task_type null)."""
    return rows.rollup("task_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin(*SUCCESSFUL_STATES)).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("downloaded"), F.lit(0)).cast("long").alias("downloaded")
    )


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the least `order`; of several such, the one whose other columns are least, in their order."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col(order).isNull(), order, F.struct(*others).alias("row"))).alias("first")).select(*keys, "first.row.*")


def running_time(rows: DataFrame, records: DataFrame, now: Column, task: str = "task") -> DataFrame:
    """task, running_seconds: what is stored (running_seconds of rows) and, of running tasks, the seconds since the last start or resume."""
    last = records.where(F.col("action").isin("start", "resume")).groupBy(task).agg(F.max("ts").alias("open_since"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    open_ = F.when((F.col("status") == "running") & F.col("open_since").isNotNull(), ((micros(now) - micros(F.col("open_since"))) / 1_000_000).cast("long")).otherwise(0)
    return rows.join(last, task, "left").select(task, (F.coalesce("running_seconds", F.lit(0)) + open_).alias("running_seconds"))


def trailing_rate(samples: DataFrame, key: str, seconds: int = 3) -> DataFrame:
    """rate: bytes a second at each sample (ts, total: the bytes so far), from the last sample at or before the window's start.

    Where no sample is that old, from the first; without an earlier sample, or one at another time, 0.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros)
    back = F.max(F.struct(micros.alias("t"), F.col("total").alias("b"))).over(w.rangeBetween(Window.unboundedPreceding, -seconds * 1_000_000))
    first = F.min(F.struct(micros.alias("t"), F.col("total").alias("b"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(back, first)
    spent = (micros - start["t"]) / 1_000_000
    return samples.withColumn("rate", F.when(spent > 0, (F.col("total") - start["b"]) / spent).otherwise(0.0))


def orphans(rows: DataFrame) -> DataFrame:
    """Tasks that were at work when their process ended, with the state they go to: running ones pause, retrying ones wait for a decision."""
    state = F.col("status")
    return rows.where(state.isin("running", "retrying")).withColumn("recovered_status", F.when(state == "running", "paused").otherwise("pending_decision"))


def paused(rows: DataFrame, records: DataFrame, at: Column, task: str = "task") -> tuple[DataFrame, DataFrame]:
    """rows (task, status, running_seconds) with running and retrying tasks paused, and the time records (task, action, ts) that go with it.

    Whole seconds since the last start or resume in records are added to running_seconds.
    """
    active = F.col("status").isin("running", "retrying")
    since = records.where(F.col("action").isin("start", "resume")).groupBy(task).agg(F.max("ts").alias("_since"))
    spent = F.coalesce(((F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("_since").cast("timestamp"))) / 1_000_000).cast("long"), F.lit(0).cast("long"))
    made = rows.where(active).select(task, F.lit("pause").alias("action"), at.alias("ts"))
    total = F.coalesce("running_seconds", F.lit(0)).cast("long")
    held = rows.join(since, task, "left").withColumn("running_seconds", F.when(active, total + spent).otherwise(total)).drop("_since")
    return held.withColumn("status", F.when(active, "paused").otherwise(F.col("status"))), made


def refilled(rows: DataFrame, gaps: DataFrame, retryable: tuple[str, ...]) -> DataFrame:
    """rows; tasks that ended with gaps, failed or wait for a decision are retrying if one of their gaps may be tried again."""
    again = gaps.where(F.col("outcome").isin(*retryable)).select("task").distinct().withColumn("_again", F.lit(True))
    able = F.col("status").isin("completed_with_gaps", "pending_decision", "failed") & F.col("_again").isNotNull()
    return rows.join(again, "task", "left").withColumn("status", F.when(able, "retrying").otherwise(F.col("status"))).drop("_again")


def accepted(status: Column) -> Column:
    """The state of a task whose gaps the user accepts."""
    return F.when(status == "pending_decision", "completed_with_gaps").otherwise(status)


def plugin_state(outcome: Column) -> Column:
    """The state that a plugin's outcome stands for; anything unknown is a failure."""
    return F.when(outcome.isin("completed", "completed_with_gaps", "failed", "paused", "pending_decision"), outcome).otherwise("failed")


def first_named(rows: DataFrame, words: Column) -> DataFrame:
    """rows whose name holds the words, whatever their case."""
    return rows.where(F.contains(F.lower("name"), F.lower(F.trim(words))))


def throttled(events: DataFrame, key: str, ties: tuple[str, ...] = (), seconds: float = 0.5, stretch: int = 3600) -> DataFrame:
    """Of each key's events (ts; ties: columns that order equal times) those that go out: `seconds` or more after the last one sent, and the last.

    An event that long after the one before it goes out whatever came earlier, so bursts between such gaps are settled
    apart. Gaps are found within stretches of time, with the end of the stretch before; a burst is scanned in order and
    holds only the time last sent, so neither a key nor a burst is ever in memory whole. A null time counts as the earliest.
    """
    step = round(seconds * 1_000_000)
    at, block, before, new, first, last, burst, end, held = (f"_throttle_{c}" for c in ("at", "block", "before", "new", "first", "last", "burst", "end", "held"))
    rows = events.withColumn(at, F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62))))
    rows = rows.withColumn(block, F.floor(F.col(at) / (stretch * 1_000_000)))
    by_block = Window.partitionBy(key).orderBy(block)
    ends = rows.groupBy(key, block).agg(F.max(at).alias(end))
    ends = ends.select(F.col(key).alias(held), F.col(block).alias(f"{block}_"), F.lag(end).over(by_block).alias(before), F.lead(end).over(by_block).isNull().alias(end))
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col(held)) & (F.col(block) == F.col(f"{block}_"))).drop(held, f"{block}_")
    w = Window.partitionBy(key, block).orderBy(at, *ties)
    earlier = F.coalesce(F.lag(at).over(w), F.col(before))
    rows = rows.withColumn(new, earlier.isNull() | (F.col(at) - earlier >= step)).withColumn(last, F.lead(at).over(w).isNull() & F.col(end)).drop(before, end)
    # The burst of an event: the time of the last new one, in its stretch or an earlier one.
    rows = rows.withColumn(burst, F.max(F.when(F.col(new), F.col(at))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = rows.groupBy(key, block).agg(F.max(burst).alias(first))
    starts = starts.select(F.col(key).alias(held), F.col(block).alias(f"{block}_"), F.max(first).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias(first))
    rows = rows.join(starts, F.col(key).eqNullSafe(F.col(held)) & (F.col(block) == F.col(f"{block}_"))).drop(held, f"{block}_")
    rows = rows.withColumn(burst, F.coalesce(burst, first)).drop(first, block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = None
        for batch in batches:
            times, starts = batch.column(at).to_numpy(), batch.column(new).to_numpy(zero_copy_only=False)
            keep = batch.column(last).to_numpy(zero_copy_only=False).copy()
            edges = [0, *np.flatnonzero(starts).tolist(), len(times)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                i = a if starts[a] else a + int(np.searchsorted(times[a:b], sent + step))
                while i < b:
                    keep[i], sent = True, int(times[i])
                    i += int(np.searchsorted(times[i:b], sent + step))
            yield batch.select(names).filter(pa.array(keep))

    names = events.columns
    dealt = rows.repartition(F.col(key), F.col(burst)).sortWithinPartitions(F.col(key), F.col(burst), F.col(at), *ties)
    return dealt.mapInArrow(scan, events.schema)


def knee(samples: DataFrame, key: str, ratio: float = 0.9, rise: float = 1.15) -> DataFrame:
    """concurrency, best_rate, rising of samples (concurrency, rate, ok: how many succeeded).

    The smallest level that reaches `ratio` of the best rate, levels without a success left out; rising: it is the
    highest, and beats all below by `rise`.
    """
    valid = samples.where("ok > 0")
    w = Window.partitionBy(key)
    known = valid.withColumns({"best": F.max("rate").over(w), "top": F.max("concurrency").over(w)})
    out = known.groupBy(key).agg(
        F.min(F.when(F.col("rate") >= ratio * F.col("best"), F.col("concurrency"))).alias("concurrency"), F.max("best").alias("best_rate"), F.max("top").alias("top"), F.max(F.when(F.col("concurrency") < F.col("top"), F.col("rate"))).alias("below")
    )
    rising = (F.col("concurrency") == F.col("top")) & F.coalesce((F.col("below") > 0) & (F.col("best_rate") >= rise * F.col("below")), F.lit(False))
    return out.select(key, "concurrency", "best_rate", rising.alias("rising"))


def migrated(rows: DataFrame) -> DataFrame:
    """Task rows of older versions: cancelled becomes failed, retrying without a run becomes a decision, running pauses."""
    state = F.col("status")
    return rows.withColumn("status", F.when(state == "cancelled", "failed").when(state == "running", "paused").when(state == "retrying", "pending_decision").otherwise(state))


def available(ranges: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct availability ranges of a task and of its base together, with the levels they span."""
    both = ranges.select(*keys).union(base.select(*keys)).distinct()
    return both.groupBy("level").agg(F.count("*").alias("ranges"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
