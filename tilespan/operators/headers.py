"""GeoTIFF headers (rows of tags) as records: geotransform, bounds, pixel sizes, recommended levels, and sums of file sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespan.functions import grid

#: Fixed value: the code of a system that the file defines itself.
USER_DEFINED = 32767
MOST_PIXELS = 2**31 - 1


def geotransform(transform: Column, scale: Column, tie: Column) -> Column:
    """Six numbers from a 4 x 4 matrix, or else from a pixel scale and a tie point; null without either."""
    t, s, p = (lambda k: F.get(transform, F.lit(k))), (lambda k: F.get(scale, F.lit(k))), (lambda k: F.get(tie, F.lit(k)))
    by_matrix = F.array(t(3), t(0), t(1), t(7), t(4), t(5))
    by_scale = F.array(p(3) - p(0) * s(0), s(0), F.lit(0.0), p(4) + p(1) * s(1), F.lit(0.0), -s(1))
    return F.when(F.size(transform) == 16, by_matrix).when((F.size(scale) == 3) & (F.size(tie) == 6) & (s(0) != 0) & (s(1) != 0), by_scale)


def epsg(model: Column, projected: Column, geographic: Column) -> Column:
    """The EPSG code by the model's kind: projected and geocentric rasters have theirs in one key alone, others may fall back."""
    usable = lambda c: F.when((c > 0) & (c < USER_DEFINED), c)
    return F.when(F.coalesce(model.isin(1, 3), F.lit(False)), usable(projected)).otherwise(F.coalesce(usable(projected), usable(geographic)))


def records(headers: DataFrame, geographic_codes: tuple[int, ...] = (4326, 4490)) -> DataFrame:
    """headers (name, size, width, height, samples, transform, scale, tie, model, projected, geographic) with what they say.

    geotransform, epsg, west, south, east, north (of geographic rasters), pixel_deg, pixel_3857, pixel_metres,
    max_level, max_zoom, level_precision, level_speed and warnings. Projected rasters keep their native bounds only: other
    projections are not worked out here.
    """
    gt = geotransform(F.col("transform"), F.col("scale"), F.col("tie"))
    read = F.coalesce(F.col("width").between(1, MOST_PIXELS) & F.col("height").between(1, MOST_PIXELS) & (F.coalesce("size", F.lit(0)) >= 0), F.lit(False))
    known = headers.withColumn("geotransform", F.when(read, gt)).withColumn("epsg", F.when(read, epsg(F.col("model"), F.col("projected"), F.col("geographic"))))
    g = lambda k: F.get("geotransform", F.lit(k))
    placed = F.col("geotransform").isNotNull() & F.col("epsg").isNotNull()
    plain = placed & F.col("epsg").isin(*geographic_codes)
    known = known.withColumn("b", F.when(placed, grid.raster_bounds(F.col("geotransform"), F.col("width"), F.col("height"))))
    known = known.select("*", "b.west", "b.south", "b.east", "b.north").drop("b")
    cosine = F.greatest(F.lit(1e-6), F.cos(F.radians((F.col("south") + F.col("north")) / 2)))
    deg = F.when(plain, F.abs(g(1)))
    known = known.withColumn("pixel_deg", deg).withColumn("pixel_metres", F.when(plain, F.abs(g(5)) * grid.DEGREE_METRES)).withColumn("pixel_3857", F.when(plain, F.least(F.abs(g(1)) * grid.DEGREE_METRES, F.abs(g(5)) * grid.DEGREE_METRES / cosine)))
    warnings = F.array_compact(
        F.array(
            F.when(~read, "header_unreadable"),
            F.when(read & (F.coalesce("samples", F.lit(1)) > 1), "multi_band"),
            F.when(read & F.col("geotransform").isNull(), "no_georeference").when(read & F.col("epsg").isNull(), "unknown_crs"),
            F.when(placed & ((g(2) != 0) | (g(4) != 0)), "rotated"),
            F.when(placed & ~plain, "crs_unresolved"),
        )
    )
    return known.withColumns(
        {
            "max_level": grid.level_by_quality(F.col("pixel_deg")),
            "level_precision": grid.level_by_quality(F.col("pixel_deg"), "precision"),
            "level_speed": grid.level_by_quality(F.col("pixel_deg"), "speed"),
            "max_zoom": F.when(F.col("pixel_3857") > 0, grid.max_zoom_3857(F.col("pixel_3857"))),
            "warnings": warnings,
        }
    )


def summary(files: DataFrame, key: str) -> DataFrame:
    """Of each set of records: count, total_size, the union of bounds (east beyond 180 where it crosses), the finest pixel, its level, warnings."""
    placed = F.col("pixel_deg").isNotNull()
    up = lambda c: F.when(F.col(c) < 0, F.col(c) + 360).otherwise(F.col(c))
    only = lambda c: F.when(placed, c)
    sums = files.groupBy(key).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.min(only(F.col("west"))).alias("w"), F.max(only(F.col("east"))).alias("e"),
        F.min(only(F.least(F.col("west"), F.col("east")))).alias("low"), F.max(only(F.greatest(F.col("west"), F.col("east")))).alias("high"), F.min(only(F.least(up("west"), up("east")))).alias("up_low"), F.max(only(F.greatest(up("west"), up("east")))).alias("up_high"),
        F.min(only(up("west"))).alias("up_w"), F.max(only(up("east"))).alias("up_e"), F.min(only(F.col("south"))).alias("south"), F.max(only(F.col("north"))).alias("north"), F.min("pixel_deg").alias("pixel_deg"), F.count_distinct("epsg").alias("systems"),
        F.max(F.exists("warnings", lambda x: x.isin("no_georeference", "unknown_crs", "header_unreadable"))).alias("unusable"),
    )
    wraps = (F.col("high") - F.col("low") > 180) & (F.col("up_high") - F.col("up_low") <= 180)
    warned = F.array_compact(F.array(F.when(wraps, "antimeridian"), F.when(F.col("systems") > 1, "mixed_crs"), F.when(F.col("unusable"), "some_unusable")))
    return sums.select(key, "files", "total_size", F.when(wraps, F.col("up_w")).otherwise(F.col("w")).alias("west"), "south", F.when(wraps, F.col("up_e")).otherwise(F.col("e")).alias("east"), "north", "pixel_deg", grid.level_by_quality(F.col("pixel_deg")).alias("max_level"), warned.alias("warnings"))


def tile_counts(boxes: DataFrame, key: str, last: int = 21) -> DataFrame:
    """Geographic tiles of each level that a box (west, south, east, north; east beyond 180: across the antimeridian) meets."""
    parts = F.when(F.col("east") > 180, F.array(F.struct(F.col("west").alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), (F.col("east") - 360).alias("e")))).otherwise(F.array(F.struct(F.col("west").alias("w"), F.col("east").alias("e"))))
    rows = boxes.select(key, "south", "north", F.inline(parts)).select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level"))
    x = grid.axis_range(F.col("w"), F.col("e"), grid.tiles_across(F.col("level") + 1), 360.0, -180.0)
    y = grid.axis_range(F.col("south"), F.col("north"), grid.tiles_across(F.col("level")), 180.0, -90.0)
    return rows.groupBy(key, "level").agg(F.sum((x.i1 - x.i0 + 1) * (y.i1 - y.i0 + 1)).alias("tiles"))
