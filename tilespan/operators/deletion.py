"""What deleting tasks may remove from the tile cache: tiles that no surviving task refers to, and the files that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespan.functions.addresses import let
from tilespan.operators import cache, polygons, spans

#: Fixed value: a cached tile's path is namespace/zoom/x/y.png; files being written have more after that and are left alone.
TILE_PATH = r"(?:^|/)([^/]+)/([0-9]+)/([0-9]+)/([0-9]+)\.png$"


def listed_tiles(listing: DataFrame) -> DataFrame:
    """namespace, zoom, x, y, bytes of the cached tiles in a listing (path, bytes); other files are left out."""
    part = lambda parts, k: F.try_element_at(parts, F.lit(k))

    def tile(p: Column) -> Column:
        y = F.substring_index(part(p, -1), ".", 1)
        return F.array(F.struct(part(p, -4).alias("namespace"), part(p, -3).try_cast("int").alias("zoom"), part(p, -2).try_cast("long").alias("x"), y.try_cast("long").alias("y")))

    # A path is made, matched and split once for each row, whatever its parts are used for.
    read = let(F.col("path"), lambda path: F.when(path.rlike(TILE_PATH), let(F.split(path, "/"), tile)))
    found = listing.select(F.inline(read), F.col("bytes").cast("long").alias("bytes"))
    return found.where("zoom is not null and x is not null and y is not null")


def survivors(at_delete: DataFrame, now: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Tasks that must keep their tiles: those there were when the row was deleted, and those that have come since.

    Of a task in both, the earlier row counts. One that has gone since still counts: too little may go, never too much.
    """
    came = now.join(at_delete.select(key), key, "left_anti")
    return at_delete.unionByName(came.select(*at_delete.columns)).join(deleted.select(key), key, "left_anti")


def referenced(tasks: DataFrame, key: str = "id") -> DataFrame:
    """key, namespace, zoom, y, x0, x1: spans that tasks refer to, those of a task may overlap. tasks: key, namespace, north, south, east, west, zoom_min, zoom_max and rings.

    Where rings is null or has no ring of four points, the box counts: it covers more, and more is kept. Tasks without a namespace
    or usable numbers refer to nothing.
    """
    known = tasks.where("namespace is not null and zoom_min <= zoom_max and zoom_min >= 0")
    drawn = F.coalesce(F.exists("rings", lambda r: F.size(r) > 3), F.lit(False))
    boxed = known.where(~drawn).where(_finite("north", "south", "east", "west"))
    boxes = spans.box_rows(boxed.select(key, "namespace", "north", "south", "west", F.when(F.col("east") < F.col("west"), F.col("east") + 360.0).otherwise(F.col("east")).alias("east"), "zoom_min", "zoom_max")).select(key, "namespace", "zoom", "y", "x0", "x1")
    shapes = known.where(drawn)
    limits = shapes.select(F.col(key).cast("long").alias(key), "namespace", "zoom_min", "zoom_max")
    least, most = limits.agg(F.min("zoom_min"), F.max("zoom_max")).first()
    if least is None:
        return boxes
    found = polygons.polygon_spans(shapes, key, least, most).join(limits, key).where(F.col("zoom").between(F.col("zoom_min"), F.col("zoom_max")))
    return boxes.unionByName(found.select(*boxes.columns))


def _finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.abs(F.col(n)) < float("inf"), F.lit(False))
    return out


def exclusive(deleted: DataFrame, kept: DataFrame) -> DataFrame:
    """namespace, zoom, y, x0, x1 that deleted tasks' spans hold and no kept one's do."""
    keys = ["namespace", "zoom", "y"]
    return spans.subtract(deleted.select(*keys, "x0", "x1"), kept.select(*keys, "x0", "x1"), keys)


def removable(files: DataFrame, runs: DataFrame) -> DataFrame:
    """The files (namespace, zoom, x, y, bytes) that lie in runs of their namespace."""
    return cache.points_in_spans(files, runs, ["namespace"])


def freed(files: DataFrame) -> DataFrame:
    """namespace, removed_files, removed_bytes."""
    return files.groupBy("namespace").agg(F.count("*").alias("removed_files"), F.sum("bytes").alias("removed_bytes"))


def buried(tasks: DataFrame, deleted: DataFrame, at: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """tasks without the deleted ones, and their tombstones (key, was, deleted_at): active ones are to be stopped before their files go."""
    gone = tasks.join(deleted.select(key), key, "left_semi")
    return tasks.join(deleted.select(key), key, "left_anti"), gone.select(key, F.col("status").alias("was"), at.alias("deleted_at"))
