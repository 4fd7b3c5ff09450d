"""Tile outcomes and the sparse gap ledger: only tiles that are not a success have a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespan.schemas import EXPLAINED_OUTCOMES, GAP_OUTCOMES, OUTCOMES, RETRYABLE_OUTCOMES


def classify(http_status: Column, is_image: Column, timed_out: Column) -> Column:
    """Outcome of a download: 404 and 410 hold no data, other 4xx but 429 and non-images stay failed, the rest may be tried again."""
    return (
        F.when(timed_out | http_status.isNull(), "retryable_failure")
        .when(http_status.isin(404, 410), "no_data")
        .when((http_status == 200) & is_image, "success")
        .when(http_status == 200, "permanent_failure")
        .when(http_status == 429, "retryable_failure")
        .when(http_status.between(400, 499), "permanent_failure")
        .otherwise("retryable_failure")
    )


def from_text(value: Column) -> Column:
    """A stored outcome; an unknown one may be tried again."""
    return F.when(value.isin(*OUTCOMES), value).otherwise("retryable_failure")


def is_gap(outcome: Column) -> Column:
    return outcome != "success"


def is_unexplained(outcome: Column) -> Column:
    return ~outcome.isin(*EXPLAINED_OUTCOMES)


def last_wins(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest observation of each tile with n_seen; max_by, so a tile that is seen often needs no sort."""
    others = [c for c in observations.columns if c not in keys]
    return observations.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"), F.count("*").alias("n_seen")).select(*keys, "last.*", "n_seen")


def merge(ledger: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger after a batch of one outcome a tile: gaps are inserted or updated (one retry more), successes deleted."""
    old = ledger.select(*keys, F.col("outcome").alias("old"), F.col("retries").alias("old_retries"))
    new = batch.select(*keys, F.col("outcome").alias("new"))
    both = old.join(new, keys, "full_outer")
    kept = both.where("new is null or new <> 'success'")
    retries = F.when(F.col("new").isNull(), F.col("old_retries")).when(F.col("old").isNull(), F.lit(0)).otherwise(F.col("old_retries") + 1)
    return kept.select(*keys, F.coalesce("new", "old").alias("outcome"), retries.cast("int").alias("retries"))


def counter_deltas(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of what outcome changes (old, new; old null: no row) do to the downloaded and failed counters."""
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    old, new = F.col("old"), F.col("new")
    down = one(new == "success") - one(old == "success")
    failed = one(is_unexplained(new)) - one(is_unexplained(old))
    return changes.groupBy(*keys).agg(F.sum(down).alias("downloaded_delta"), F.sum(failed).alias("failed_delta"))


def summary(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Gap counts of each task: total, one column an outcome, unexplained, explained (true where nothing is unexplained)."""
    counts = {f"n_{o}": F.count_if(F.col("outcome") == o) for o in GAP_OUTCOMES}
    found = gaps.groupBy(*keys).agg(F.count_if(is_gap(F.col("outcome"))).alias("total"), *(c.alias(n) for n, c in counts.items()))
    unexplained = reduce(lambda a, b: a + b, (F.col(f"n_{o}") for o in GAP_OUTCOMES if o not in EXPLAINED_OUTCOMES))
    return found.withColumn("unexplained", unexplained).withColumn("explained", F.col("unexplained") == 0)


def samples(gaps: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """The first k gaps of each task by zoom, y, x."""
    w = Window.partitionBy(*keys).orderBy("zoom", "y", "x")
    return gaps.where(is_gap(F.col("outcome"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def terminal_state(flush_error: Column, unexplained: Column, accepted: Column, stitched: Column, stitch_failed: Column, gaps: Column) -> Column:
    """State a map run ends in, first rule first."""
    return (
        F.when(flush_error, "failed")
        .when((unexplained > 0) & ~accepted, "pending_decision")
        .when((stitched > 0) & (stitch_failed == stitched), "failed")
        .when(gaps > 0, "completed_with_gaps")
        .otherwise("completed")
    )


def reconcile(wanted: DataFrame, cached: DataFrame, ledger: DataFrame, keys: list[str], namespace: list[str]) -> DataFrame:
    """Wanted tiles as hit (cached), pending (to fetch); stale: a hit whose ledger row should go; retry: its outcome may be tried again."""
    have = cached.select(*namespace, *keys).distinct().withColumn("cached", F.lit(True))
    gaps = ledger.select("task", *keys, F.col("outcome").alias("gap"))
    found = wanted.join(have, [*namespace, *keys], "left").join(gaps, ["task", *keys], "left")
    hit = F.coalesce("cached", F.lit(False))
    return found.select("task", *namespace, *keys, F.when(hit, "hit").otherwise("pending").alias("state"), (hit & F.col("gap").isNotNull()).alias("stale"), (~hit & F.coalesce(F.col("gap").isin(*RETRYABLE_OUTCOMES), F.lit(False))).alias("retry"))
