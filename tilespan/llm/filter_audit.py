"""Filter interaction audit: what each filter removes, in every order of application.

A document is reduced to its failure flags and its part; rows of equal flags and part are counted first, and a CUBE over
the five flags and the part sums them. In a grouping set, the row whose selected flags are all false counts the
survivors of that subset of filters. A step of an order goes from one subset to the next, so every figure of every
step is a difference of two subsets' survivors: one join of pairs of subsets gives all orders of all parts.

Duplicates are found without bringing equal texts together: each text's least doc_id comes from a pre-aggregated
minimum of its hash, and is joined back on hash and doc_id, which no group of copies shares.

Defined cases: a null text is the empty text; a null lang is the part of the empty string; rows that repeat a doc_id are
documents of their own; a null doc_id is larger than no other (never a duplicate, never the first of one) and has no
label; of labels that repeat a doc_id, one that says 1 counts; an empty table gives an empty result, empty labels give
no losses; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespan.llm.common import written

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the text) and the flags a to d of each row."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    counted = read.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("u"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"), F.length("text").cast("long").alias("points"), F.col("text").rlike(r"[#$%&*|]").alias("d"),
    )
    return counted.select("doc_id", "part", "digest", (F.col("n") < 100).alias("a"), (100 * F.col("u") < 80 * F.col("n")).alias("b"), (100 * F.col("capitals") > 10 * F.col("points")).alias("c"), "d")


def with_duplicates(found: DataFrame) -> DataFrame:
    """found with flag e: whether a smaller doc_id has the same text."""
    first = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    return found.join(first, ["digest", "doc_id"], "left").withColumn("e", F.col("doc_id").isNotNull() & F.col("is_first").isNull()).drop("is_first")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags a to e, n, good and toxic: the documents of each part and combination of failures."""
    rows = with_duplicates(written(features(docs), "features"))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marked.where("doc_id is not null"), "doc_id", "left")
    return rows.groupBy("part", "a", "b", "c", "d", "e").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset (bits of filters applied, A lowest), n, good and toxic of the documents that pass them all."""
    flags = FILTERS.lower()
    selected = sum(((1 - F.grouping(f)) * (1 << k) for k, f in enumerate(flags)), F.lit(0))
    sums = counts.cube("part", *flags).agg(F.grouping("part").alias("all_parts"), selected.cast("int").alias("subset"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    fails = F.lit(False)
    for f in flags:
        fails = fails | F.coalesce(F.col(f), F.lit(False))  # a flag that is not selected is null
    left = lambda c: F.sum(F.when(~fails, F.col(c)).otherwise(0)).alias(c)
    return sums.where("all_parts = 0").groupBy("part", "subset").agg(left("n"), left("good"), left("toxic"))


def _steps() -> list[tuple[str, int, int, int, int]]:
    """filter_order, step, bit of its filter, subset before, subset after."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), k + 1, bit, before, before | bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part, order and step."""
    spark = docs.sparkSession
    alive = written(survivors(flagged(docs, labels)), "survivors")
    every = (1 << len(FILTERS)) - 1
    steps = F.broadcast(spark.createDataFrame(_steps(), "filter_order string, step int, bit int, before int, after int"))  # 600 rows, always
    named = lambda on, tag: alive.select("part", F.col("subset").alias(on), *(F.col(c).alias(f"{tag}_{c}") for c in ("n", "good", "toxic")))
    pairs = named("before", "b").join(steps, "before").join(named("after", "a"), ["part", "after"])
    total = alive.groupBy("part").agg(*(_at("subset", k, "n").alias(f"pass_{k}") for k in (0, every, *(1 << i for i in range(5)), *(every ^ (1 << i) for i in range(5)))))
    rows = pairs.join(total, "part")
    by_bit = lambda make: F.coalesce(*(F.when(F.col("bit") == 1 << i, make(1 << i)) for i in range(5)))
    removed = F.col("b_n") - F.col("a_n")
    rows = rows.select(
        "part", "filter_order", "step", "bit", F.col("a_n").alias("kept"), removed.alias("removed"),
        (by_bit(lambda bit: F.col("pass_0") - F.col(f"pass_{bit}")) - removed).alias("redundant"),
        by_bit(lambda bit: F.col(f"pass_{every ^ bit}") - F.col(f"pass_{every}")).alias("unique_fails"),
        (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "bit"]).drop("bit")


def _at(key: str, value: int, column: str) -> Column:
    return F.sum(F.when(F.col(key) == value, F.col(column)).otherwise(0))
