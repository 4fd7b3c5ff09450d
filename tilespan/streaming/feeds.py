"""Live feeds: tile outcomes into counts and a ledger table, byte samples into rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilespan.operators import ledger
from tilespan.schemas import GAP_OUTCOMES
from tilespan.streaming import kept


def outcome_counts(observations: DataFrame, every: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Outcomes of each task by window of event time; rows later than `late` are dropped by the watermark."""
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("success", *GAP_OUTCOMES)]
    return observations.withWatermark("ts", late).groupBy(F.window("ts", every), "task").agg(*counts).select("task", F.col("window.start").alias("start"), *(f"n_{o}" for o in ("success", *GAP_OUTCOMES)))


def rates(samples: DataFrame, span: str = "3 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Bytes a second of each task over sliding windows."""
    held = samples.withWatermark("ts", late).groupBy(F.window("ts", span, slide), "task").agg(F.sum("bytes").alias("bytes"))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return held.select("task", F.col("window.end").alias("at"), (F.col("bytes") / seconds).alias("rate"))


def throttled(events: DataFrame, key: str, final: Column, seconds: float = 0.5) -> DataFrame:
    """Of a feed of events (ts), those that go out: `seconds` or more after the last one that was sent of their key, and final ones.

    The state of a key is the time last sent. Events of one micro-batch are taken in the order of their times; one that
    comes later than a younger one was sent stays in unless it is final.
    """
    step, columns, schema = round(seconds * 1_000_000), events.columns, events.schema

    def scan(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["_at", "_final"], kind="stable")
        sent, keep = state.get[0] if state.exists else None, []
        for at, last in zip(rows["_at"], rows["_final"], strict=True):
            out = bool(last) or sent is None or at - sent >= step
            keep.append(out)
            sent = max(at, sent if sent is not None else at) if out else sent
        state.update((int(sent),))
        yield rows[np.array(keep)][columns]

    timed = events.withColumns({"_at": F.unix_micros(F.col("ts").cast("timestamp")), "_final": F.coalesce(final, F.lit(False))}).where("_at is not null")
    return timed.groupBy(key).applyInPandasWithState(scan, schema, "sent long", "append", GroupStateTimeout.NoTimeout)


def keep_ledger(observations: DataFrame, folder: str, checkpoint: str):
    """A running query that merges each micro-batch into the gap ledger under `folder`.

    A batch rewrites the buckets of the ledger that it touches; one that runs twice is merged once.
    """
    keys = ["task", "zoom", "x", "y"]
    schema = "task long, zoom int, x long, y long, outcome string, retries int"

    def merge(batch: DataFrame, number: int) -> None:
        kept.merge(folder, number, ledger.last_wins(batch, keys, ["ts"]), keys, lambda old, new: ledger.merge(old, new, keys), schema)

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def read_ledger(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame | None:
    """The ledger after the newest batch, or after batch `upto`; None where there is none."""
    return kept.read(spark, folder, upto)
