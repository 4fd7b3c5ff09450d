"""Cache ownership, usage, eviction and disk estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespan.schemas import ACTIVE_STATES

#: Mean bytes of a tile by class, up to a zoom each; compression of a mosaic by class; bytes of an uncompressed tile.
TILE_BYTES = {
    "imagery": ((6, 20480), (10, 35840), (13, 56320), (16, 76800), (21, 97280)),
    "vector": ((6, 8192), (10, 12288), (13, 15360), (16, 18432), (21, 20480)),
    "terrain": ((6, 15360), (10, 25600), (13, 35840), (16, 46080), (21, 56320)),
}
COMPRESSION = {"imagery": 0.90, "vector": 0.35, "terrain": 0.60}
TILE_CLASSES = {"m": "vector", "s": "imagery", "y": "imagery", "t": "terrain"}
MOSAIC_BYTES = 196608
STITCHED_FORMATS = ("both", "image_only", "png", "jpg")
LOOSE_FORMATS = (*STITCHED_FORMATS, "tiles_only")


def exclusive_runs(rows: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Runs (x0, x1) of each key that one owner alone holds, as owner, keys, x0, x1.

    Each owner's runs must be disjoint within a key. Ends are swept with running counts; where one owner is open,
    the running sum of owners is its id, so owners are never compared pair by pair.
    """
    opened = rows.select(*keys, F.col("x0").alias("at"), F.lit(1).alias("n"), F.col(owner).cast("long").alias("who"))
    closed = rows.select(*keys, (F.col("x1") + 1).alias("at"), F.lit(-1).alias("n"), (-F.col(owner)).cast("long").alias("who"))
    ends = opened.union(closed).groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("who").alias("who"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    held = ends.select(*keys, F.col("at").alias("x0"), (F.lead("at").over(w) - 1).alias("x1"), F.sum("n").over(run).alias("open"), F.sum("who").over(run).alias(owner))
    return held.where("open = 1").select(owner, *keys, "x0", "x1")


def points_in_spans(points: DataFrame, spans: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Points (zoom, x, y) inside any span of their row; within: columns that both must share besides.

    Distinct cells are probed, cut into blocks of columns of their row (512 to a row at most); the spans of rows that hold
    any are cut at the blocks' borders, so that a row with many points is many groups. In a block the span that begins
    last before x decides. Of low zooms, the few cells are met by all points: these are dealt over 4096 shares of each zoom.
    """
    row = [*(within or []), "zoom", "y"]
    cells = points.select(*row, "x").distinct()
    block = F.greatest(F.lit(64), F.expr("shiftleft(1L, greatest(zoom - 9, 0))"))
    at = lambda c: F.floor(F.col(c) / block).cast("long")
    wanted = cells.select(*row, at("x").alias("b")).distinct()
    held = spans.join(cells.select(*row).distinct(), row, "left_semi")
    cut = held.select(*row, "x0", "x1", F.explode(F.sequence(at("x0"), at("x1"))).alias("b")).join(wanted, [*row, "b"], "left_semi")
    starts = cut.select(*row, "b", F.greatest("x0", F.col("b") * block).alias("x"), F.lit(0).alias("kind"), F.col("x1").alias("end"))
    probes = cells.select(*row, at("x").alias("b"), "x", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"))
    w = Window.partitionBy(*row, "b").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = starts.union(probes).withColumn("reach", F.max("end").over(w)).where("kind = 1 and reach >= x").select(*row, "x")
    shares = F.expr("shiftleft(1, 2 * greatest(6 - zoom, 0))")
    dealt = points.withColumn("_share", F.pmod(F.xxhash64(*points.columns), shares).cast("int"))
    spread = inside.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.join(spread, [*row, "x", "_share"], "left_semi").drop("_share")


def usage(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Bytes, files, number of tasks and whether one is active, by namespace."""
    sizes = files.groupBy("namespace").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    used = tasks.groupBy("namespace").agg(F.countDistinct("id").alias("tasks"), F.max(F.col("status").isin(*ACTIVE_STATES)).alias("active"))
    return sizes.join(used, "namespace", "left").select("namespace", "bytes", "files", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("active", F.lit(False)).alias("active"))


def orphan_namespaces(files: DataFrame, tasks: DataFrame, protected: DataFrame) -> DataFrame:
    """Namespaces that no task refers to and nothing protects."""
    names = lambda rows: rows.select("namespace").distinct()
    return names(files).join(names(tasks), "namespace", "left_anti").join(names(protected), "namespace", "left_anti")


def eviction(used: DataFrame, limit: int, protected: list[str] | None = None) -> DataFrame:
    """What to delete for the total to fall to the limit: namespaces without tasks first, then the largest.

    used has a row for each namespace, not for each file, so the running sum is over a short list.
    """
    total = used.agg(F.sum("bytes")).scalar()
    able = used.where(~F.col("active") & ~F.col("namespace").isin(*(protected or [""])))
    first = F.when(F.col("tasks") == 0, 0).otherwise(1)
    w = Window.partitionBy(F.lit(0)).orderBy(first, F.desc("bytes"), "namespace").rowsBetween(Window.unboundedPreceding, -1)
    ranked = able.withColumn("freed_before", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    return ranked.where(total - F.col("freed_before") > limit).select("namespace", "bytes", "freed_before")


def tile_class(style: Column) -> Column:
    out = F.when(style.isNull(), "imagery")
    for code, kind in TILE_CLASSES.items():
        out = out.when(style == code, kind)
    return out.otherwise("imagery")


def tile_bytes(style: Column, zoom: Column) -> Column:
    """Mean bytes of a tile of a style at a zoom."""
    kind, out = tile_class(style), None
    for name, bands in TILE_BYTES.items():
        for top, size in bands:
            rule = (kind == name) & (zoom <= top)
            out = F.when(rule, size) if out is None else out.when(rule, size)
    return out.cast("long")


def estimate(zooms: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of tasks from rows (keys, style, output_format, zoom, tiles, cached share, mbtiles): network, output, temp and peak."""
    mean = tile_bytes(F.col("style"), F.col("zoom"))
    ratio = F.lit(None).cast("double")
    for name, share in COMPRESSION.items():
        ratio = F.when(tile_class(F.col("style")) == name, share).otherwise(ratio)
    sums = zooms.groupBy(*keys, "style", "output_format", "mbtiles", "cached_share").agg(
        F.sum("tiles").alias("tiles"), F.sum(F.col("tiles") * mean).alias("raw"), F.sum(F.floor(F.col("tiles") * MOSAIC_BYTES * ratio).cast("long")).alias("mosaic"), F.max("tiles").alias("most")
    )
    known = F.coalesce(F.col("output_format").isin(*LOOSE_FORMATS, *STITCHED_FORMATS), F.lit(False))
    stitched = F.col("output_format").isin(*STITCHED_FORMATS) | ~known  # an unknown format costs what the dearest does
    network = F.floor(F.col("raw") * (1 - F.col("cached_share"))).cast("long")
    mirror = F.when(F.col("output_format").isin(*LOOSE_FORMATS) | ~known, F.col("raw")).otherwise(0)
    container = F.when(F.col("mbtiles"), F.floor(F.col("raw") * 1.05).cast("long")).otherwise(0)
    output = mirror + F.when(stitched, F.col("mosaic")).otherwise(0) + container
    temp = F.when(stitched, F.col("most") * MOSAIC_BYTES).otherwise(0)
    made = sums.select(*keys, "tiles", network.alias("network_bytes"), output.cast("long").alias("output_bytes"), temp.cast("long").alias("temp_bytes"))
    return made.withColumn("peak_bytes", F.col("network_bytes") + F.col("output_bytes") + F.col("temp_bytes"))


def verdict(peak: Column, free: Column, reserved: Column, factor: float = 1.15, reserve_mb: int = 2048) -> Column:
    """struct<required, shortfall>: what a task needs with a margin, and what is missing for it."""
    required = F.floor(peak * factor).cast("long")
    left = F.greatest(F.lit(0).cast("long"), free - reserved)
    return F.struct(required.alias("required"), F.greatest(F.lit(0).cast("long"), required + (reserve_mb << 20) - left).alias("shortfall"))


#: Bytes of a DEM granule by dataset, and of a contour tile.
GRANULE_BYTES = {"COP-DEM-GLO-30": 47185920, "ASTGTM.003": 26214400}
CONTOUR_TILE_BYTES = 49152


def _bytes(value: Column) -> Column:
    return F.floor(value).cast("long")


def dem_estimate(granules: Column, dataset: Column) -> Column:
    """struct<output, peak>: granules lie in the cache and in the output at once."""
    each = F.when(dataset == "ASTGTM.003", GRANULE_BYTES["ASTGTM.003"]).otherwise(GRANULE_BYTES["COP-DEM-GLO-30"])
    total = (granules * each).cast("long")
    return F.struct(total.alias("output"), (total * 2).alias("peak"))


def terrain_estimate(source: Column, float_source: Column, materialise: Column) -> Column:
    """struct<temp, output, peak> of tiling: several inputs are first made one raster."""
    temp = F.when(materialise, _bytes(source * F.when(float_source, 1.9).otherwise(0.78))).otherwise(0).cast("long")
    output = _bytes(source * 0.45)
    return F.struct(temp.alias("temp"), output.alias("output"), (temp + output).alias("peak"))


def contour_estimate(source: Column, tiles: Column) -> Column:
    """struct<temp, output, peak>: the reprojected raster with its overviews, and the tiles."""
    temp, output = _bytes(source * 1.2 * (4.0 / 3.0)), (tiles * CONTOUR_TILE_BYTES).cast("long")
    return F.struct(temp.alias("temp"), output.alias("output"), (temp + output).alias("peak"))


def remaining(raw: Column, mirror: Column, container: Column, mosaic: Column, temp: Column, total: Column, done: Column) -> Column:
    """struct<network, output, peak> of what a running task has still to do; stitching comes last and stays whole."""
    left = F.when(total > 0, (total - F.greatest(F.lit(0), F.least(done, total))) / total).otherwise(0.0)
    network, output = _bytes(raw * left), _bytes((mirror + container) * left) + mosaic
    return F.struct(network.alias("network"), output.alias("output"), (network + output + temp).alias("peak"))


def by_category(files: DataFrame, path: str = "path") -> DataFrame:
    """Bytes and files by the first folder of a path ("" for files at the root), and in all (category null)."""
    top = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")
    return files.withColumn("category", top).rollup("category").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def preflight(ranges: DataFrame, keys: list[str], vertices: Column, most_vertices: int = 1_000_000, most_tiles: int = 50_000_000, most_work: int = 20_000_000) -> DataFrame:
    """Upper bounds of a count's cost from box ranges by zoom, and why it is refused (null: it is not)."""
    rows = F.col("y1") - F.col("y0") + 1
    sums = ranges.groupBy(*keys).agg(F.sum(rows * (F.col("x1") - F.col("x0") + 1)).alias("box_tiles"), F.sum(rows).alias("scan_rows"))
    reason = F.when(vertices > most_vertices, "vertices").when(F.col("box_tiles") > most_tiles, "tiles").when(vertices * F.col("scan_rows") > most_work, "work")
    return sums.withColumn("refused", reason)


def mosaic_complete(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each key's tiles fill the box they span."""
    sums = tiles.select(*keys, "x", "y").distinct().groupBy(*keys).agg(F.count("*").alias("tiles"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("needed"))
    return sums.withColumn("complete", F.col("tiles") == F.col("needed"))
