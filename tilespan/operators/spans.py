"""Regions to tile spans: (zoom, y, x0, x1) rows, closed and disjoint, without listing single tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespan.functions import grid


def by_zoom(regions: DataFrame, zoom_min=None, zoom_max=None) -> DataFrame:
    """A row for each region and zoom; the zooms are numbers or the columns zoom_min and zoom_max."""
    lo = F.col("zoom_min") if zoom_min is None else F.lit(zoom_min)
    hi = F.col("zoom_max") if zoom_max is None else F.lit(zoom_max)
    return regions.withColumn("zoom", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))


def antimeridian_parts(regions: DataFrame) -> DataFrame:
    """Boxes whose east is beyond 180 become two, west and east of the antimeridian."""
    whole = F.array(F.struct(F.col("west").alias("west"), F.col("east").alias("east")))
    two = F.array(F.struct(F.col("west").alias("west"), F.lit(180.0).alias("east")), F.struct(F.lit(-180.0).alias("west"), (F.col("east") - 360.0).alias("east")))
    parts = regions.withColumn("part", F.explode(F.when(F.col("east") > 180.0, two).otherwise(whole)))
    return parts.withColumns({"west": F.col("part.west"), "east": F.col("part.east")}).drop("part")


def box_ranges(regions: DataFrame, zoom_min=None, zoom_max=None) -> DataFrame:
    """regions by part and zoom with x0, x1, y0, y1."""
    parts = by_zoom(antimeridian_parts(regions), zoom_min, zoom_max)
    r = grid.bbox_tile_range(F.col("north"), F.col("south"), F.col("east"), F.col("west"), F.col("zoom"))
    return parts.withColumn("r", r).select("*", "r.x0", "r.x1", "r.y0", "r.y1").drop("r")


def count_tiles(regions: DataFrame, keys: list[str], zoom_min=None, zoom_max=None) -> DataFrame:
    """Tiles of each region and zoom, overlapping parts counted once; a box's rows hold the same columns, so none is listed."""
    ranges = box_ranges(regions, zoom_min, zoom_max)
    one = ranges.groupBy(*keys, "zoom").agg(
        F.sum((F.col("x1") - F.col("x0") + 1)).alias("across"), F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("runs"), F.first("y0").alias("y0"), F.first("y1").alias("y1")
    )
    over = F.when((F.size("runs") == 2) & (F.col("runs")[0].x1 >= F.col("runs")[1].x0), F.least(F.col("runs")[0].x1, F.col("runs")[1].x1) - F.col("runs")[1].x0 + 1).otherwise(0)
    return one.select(*keys, "zoom", ((F.col("across") - over) * (F.col("y1") - F.col("y0") + 1)).alias("tiles"))


def merge_runs(rows: DataFrame, keys: list[str], low: str = "x0", high: str = "x1") -> DataFrame:
    """Closed runs of each key, those that overlap or touch joined (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(low) > before + 1), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_run")


def box_rows(regions: DataFrame, zoom_min=None, zoom_max=None) -> DataFrame:
    """regions by zoom and row with x0, x1: a row for each part of a box, not merged, without a shuffle."""
    return box_ranges(regions, zoom_min, zoom_max).withColumn("y", F.explode(F.sequence("y0", "y1")))


def row_spans(regions: DataFrame, keys: list[str], zoom_min=None, zoom_max=None) -> DataFrame:
    """Spans of boxes: keys, zoom, y, x0, x1, merged within each row."""
    rows = box_rows(regions, zoom_min, zoom_max)
    return merge_runs(rows.select(*keys, "zoom", "y", "x0", "x1"), [*keys, "zoom", "y"])


def cells(spans: DataFrame) -> DataFrame:
    """A row for each tile of spans."""
    return spans.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def subtract(mine: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (x0, x1) of each key that `mine` holds and `others` do not.

    Both sides are cut at each other's ends: every end is a row, and running sums say which side holds the stretch
    that follows. No tile is listed and no pair is made.
    """
    cut = lambda rows, a, b: rows.select(*keys, F.col("x0").alias("at"), F.lit(a).alias("m"), F.lit(b).alias("o")).union(rows.select(*keys, (F.col("x1") + 1).alias("at"), F.lit(-a).alias("m"), F.lit(-b).alias("o")))
    ends = cut(mine, 1, 0).union(cut(others, 0, 1)).groupBy(*keys, "at").agg(F.sum("m").alias("m"), F.sum("o").alias("o"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    held = ends.select(*keys, F.col("at").alias("x0"), (F.lead("at").over(w) - 1).alias("x1"), F.sum("m").over(run).alias("mine"), F.sum("o").over(run).alias("other"))
    return merge_runs(held.where("mine > 0 and other = 0").select(*keys, "x0", "x1"), keys)


def granules(regions: DataFrame, keys: list[str]) -> DataFrame:
    """One-degree cells of boxes: keys, lat, lon of the south-west corner; an edge on a degree line takes no next cell."""
    parts = antimeridian_parts(regions)
    lat = F.explode(F.sequence(F.floor("south").cast("int"), F.greatest(F.floor("south"), F.floor(F.col("north") - 1e-12)).cast("int")))
    lon = F.explode(F.sequence(F.floor("west").cast("int"), F.greatest(F.floor("west"), F.floor(F.col("east") - 1e-12)).cast("int")))
    return parts.withColumn("lat", lat).withColumn("lon", lon).select(*keys, "lat", "lon").distinct()
