"""Raster kernels on pixel tables (raster, row, col, elev): relief, overviews, sampling, contour levels, mesh coding.

Neighbours are window rows, so a raster is cut by (raster, row) or (raster, col) and its lines are the unit of work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gradient(along: str, across: str, spacing: float) -> Column:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy("raster", across).orderBy(along)
    before, after, here = F.lag("elev").over(w), F.lead("elev").over(w), F.col("elev")
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), (after - here) / spacing).when(after.isNull(), (here - before) / spacing).otherwise((after - before) / (2 * spacing))


def hillshade(pixels: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """pixels with shade from 0 to 1; flat ground is 0.5 whatever the raster."""
    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    light = (math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt))
    steep = pixels.withColumn("gx", _gradient("col", "row", dx) * exaggeration).withColumn("gy", _gradient("row", "col", -dy) * exaggeration)
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1.0)
    raw = (-F.col("gx") * light[0] - F.col("gy") * light[1] + light[2]) / length - light[2] + 0.5
    return steep.withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).drop("gx", "gy")


def overview(pixels: DataFrame, factor: int) -> DataFrame:
    """Means over factor x factor cells."""
    cell = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy("raster", cell("row"), cell("col")).agg(F.avg("elev").alias("elev"))


def bilinear(samples: DataFrame, pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """samples (id, raster, px, py in pixels from the corner) with the height by pixel centres; outside: clamped, null: 0."""
    x, y = F.col("px") - 0.5, F.col("py") - 0.5
    c = F.greatest(F.lit(0), F.least(F.lit(cols - 2), F.floor(x).cast("int")))
    r = F.greatest(F.lit(0), F.least(F.lit(rows - 2), F.floor(y).cast("int")))
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    placed = samples.select("id", "raster", c.alias("c"), r.alias("r"), unit(x - c).alias("fx"), unit(y - r).alias("fy"))
    corners = F.array(*(F.struct((F.col("r") + dr).alias("row"), (F.col("c") + dc).alias("col"), ((F.col("fy") if dr else 1 - F.col("fy")) * (F.col("fx") if dc else 1 - F.col("fx"))).alias("weight")) for dr in (0, 1) for dc in (0, 1)))
    found = placed.select("id", "raster", F.inline(corners)).join(pixels, ["raster", "row", "col"], "left")
    return found.groupBy("id", "raster").agg(F.sum(F.col("weight") * F.coalesce(F.nanvl("elev", F.lit(0.0)), F.lit(0.0))).alias("height"))


def interval_at(base: Column, zoom: Column, detail: int = 14, gentle: bool = False) -> Column:
    """Contour interval of a zoom: below the detail zoom it grows by 1, 2, 5, 10, ... with each level (or every second)."""
    steps = F.greatest(F.lit(0), F.lit(detail) - zoom)
    k = F.floor(steps / 2).cast("int") if gentle else steps.cast("int")
    ladder = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(5)), (k % 3 + 1).cast("int"))
    return base * ladder * F.pow(F.lit(10.0), F.floor(k / 3))


def contour_levels(low: Column, high: Column, interval: Column, most: int = 200) -> Column:
    """struct<first, last, n>: the levels that cover [low, high]; n is 0 for flat ground and for more than `most`."""
    first, last = F.floor(low / interval) * interval, F.ceil(high / interval) * interval
    n = F.rint((last - first) / interval).cast("long") + 1
    return F.struct(first.alias("first"), last.alias("last"), F.when((high - low < 1e-6) | (n > most), F.lit(0).cast("long")).otherwise(n).alias("n"))


def is_index_contour(elevation: Column, interval: Column, step: int) -> Column:
    ratio = elevation / (interval * step)
    return F.abs(ratio - F.rint(ratio)) < 1e-6


def tint_bin(value: Column, breaks: list[float]) -> Column:
    """How many of the rising breaks are at or below a value."""
    return F.size(F.filter(F.array(*map(F.lit, breaks)), lambda b: value >= b))


def oct_encode(x: Column, y: Column, z: Column) -> Column:
    """struct<u, v>: a unit vector on the octahedron, a byte each, halves rounded up."""
    norm = F.abs(x) + F.abs(y) + F.abs(z)
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    px, py = x / norm, y / norm
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    qx = F.when(z < 0, (1 - F.abs(py)) * sign(px)).otherwise(px)
    qy = F.when(z < 0, (1 - F.abs(px)) * sign(py)).otherwise(py)
    byte = lambda c: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) * 0.5 + 0.5) * 255.0 + 0.5).cast("int")
    return F.struct(byte(qx).alias("u"), byte(qy).alias("v"))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 31))


def zigzag_deltas(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with the zigzag code of each value's difference from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("code", zigzag((F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).cast("int")))


def high_water_codes(rows: DataFrame, key: str, order: str, index: str) -> DataFrame:
    """rows with the distance of each index from the next unused one (indices first appear in rising order)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("code", F.coalesce(F.max(index).over(w) + 1, F.lit(0)) - F.col(index))
