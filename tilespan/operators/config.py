"""Configuration values against rules, and geocoders' answers as boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """entries (key, value, ...) with a verdict by rules (key, low, high, whole)."""
    number = F.col("value").try_cast("double")
    verdict = (
        F.when(F.col("low").isNull() & F.col("high").isNull(), "unknown")
        .when(number.isNull(), "not_a_number")
        .when(F.col("whole") & (number != F.floor(number)), "not_whole")
        .when(~number.between(F.col("low"), F.col("high")), "out_of_range")
        .otherwise("ok")
    )
    return entries.join(rules, "key", "left").withColumn("verdict", verdict)


def with_defaults(entries: DataFrame, defaults: DataFrame) -> DataFrame:
    """entries (key, value) and the defaults of the keys they lack."""
    return entries.select("key", "value").unionByName(defaults.select("key", "value").join(entries, "key", "left_anti"))


def upsert(entries: DataFrame, changes: DataFrame, unchanged: str) -> DataFrame:
    """entries (key, value) after changes, with whether each was changed; a value that is the mark for "as it was" changes nothing."""
    new = changes.where((F.col("value") != unchanged) | F.col("value").isNull()).select("key", F.col("value").alias("new"), F.lit(True).alias("changed"))
    both = entries.select("key", "value").join(new, "key", "full_outer")
    return both.select("key", F.when(F.col("changed"), F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce("changed", F.lit(False)).alias("changed"))


def geocoded(answers: DataFrame, column: str) -> DataFrame:
    """answers with the first hit's west, south, east, north and name, from a FeatureCollection's bbox or a list's boundingbox; no hit: no row."""
    box = F.from_json(F.get_json_object(column, "$.features[0].bbox"), "array<double>")
    listed = F.from_json(F.get_json_object(column, "$[0].boundingbox"), "array<string>")
    n = F.size(box)
    at = lambda four, six, named: F.when(box.isNotNull(), F.when(n == 6, F.get(box, F.lit(six))).otherwise(F.get(box, F.lit(four)))).otherwise(F.get(listed, F.lit(named)).try_cast("double"))
    name = F.coalesce(F.get_json_object(column, "$.features[0].properties.name"), F.get_json_object(column, "$[0].display_name"))
    found = answers.withColumns({"west": at(0, 0, 2), "south": at(1, 1, 0), "east": at(2, 3, 3), "north": at(3, 4, 1), "name": name})
    return found.where("west is not null and south is not null and east is not null and north is not null")
