"""Terrain pyramids: tables of raster blocks to gzipped quantized-mesh tiles of every level, and their layer document.

A level samples one overview of the raster: the one whose pixels are at most as wide as the level's vertices are apart.
That depends on the level alone, so neighbouring tiles get the same heights on their common edge. Blocks are cut into
the windows that tiles need, and a window is what is shuffled; a tile's pieces meet in one task, where it is sampled,
meshed, encoded and compressed. Full grids are encoded for many tiles at once: what does not change with the heights is
made once a grid size.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespan.functions import grid
from tilespan.operators import blocks as B
from tilespan.operators import spans, terrain
from tilespan.schemas import METRES_PER_DEGREE

#: Fixed value: up to this level the whole earth has tiles, where a pyramid begins at 0.
WHOLE_LEVELS = 4
#: Fixed value: the share of the distance between vertices that a triangulation may be off.
ERROR_SHARE = 0.15
_TILE = "raster long, level int, x long, y long, tile binary, low double, high double, backend string, vertices long, triangles long"
_NAMES = [f.split()[0] for f in _TILE.split(", ")]
_AT_ONCE = 64
#: Tiles of one task: they cost far more time than bytes, so bytes must not say how many tasks there are.
TILES_A_TASK = 128


def overview_of(level: int, n: int, pixel: float) -> int:
    """The overview that a level of n x n vertices samples: 2^k source pixels are at most one step of it."""
    step = 180.0 / (1 << level) / (n - 1) / pixel
    return int(math.floor(math.log2(step))) if step > 1 else 0


def error_of(level: int, n: int, share: float = ERROR_SHARE) -> float:
    """Metres that a level's triangulation may be off."""
    return share * 180.0 / (1 << level) / max(1, n - 1) * METRES_PER_DEGREE


def tiles_of(rasters: DataFrame, min_level: int, max_level: int) -> DataFrame:
    """raster, level, x0, x1, y0, y1: the tiles that rasters (raster, west, north, pixel, rows, cols) share area with; all of the lowest levels."""
    at = spans.by_zoom(rasters, min_level, max_level).withColumnRenamed("zoom", "level")
    high, wide = F.expr("shiftleft(1L, level)"), F.expr("shiftleft(2L, level)")
    x = grid.axis_range(F.col("west"), F.col("west") + F.col("cols") * F.col("pixel"), wide, 360.0, -180.0)
    y = grid.axis_range(F.col("north") - F.col("rows") * F.col("pixel"), F.col("north"), high, 180.0, -90.0)
    whole = F.lit(min_level == 0) & (F.col("level") <= WHOLE_LEVELS)
    pick = lambda a, b: F.when(whole, a).otherwise(b).cast("long")
    found = at.select("*", x.alias("xs"), y.alias("ys"))
    return found.select("raster", "level", pick(F.lit(0), F.col("xs.i0")).alias("x0"), pick(wide - 1, F.col("xs.i1")).alias("x1"), pick(F.lit(0), F.col("ys.i0")).alias("y0"), pick(high - 1, F.col("ys.i1")).alias("y1"))


def _window(low: np.ndarray, high: np.ndarray, pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last pixel centre that a bilinear sample between two places (in pixels from the first centre) looks at."""
    first = np.clip(np.floor(low).astype(np.int64), 0, max(0, pixels - 2))
    return first, np.minimum(np.clip(np.floor(high).astype(np.int64), 0, max(0, pixels - 2)) + 1, pixels - 1)


def _sampled(window: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bilinear heights at places in the window (pixels from its first centre), clamped to it; next to no data: 0."""
    h, w = window.shape
    r, c = (np.clip(np.floor(v).astype(np.int64), 0, max(0, k - 2)) for v, k in ((rows, h), (cols, w)))
    fy, fx = np.clip(rows - r, 0, 1)[:, None], np.clip(cols - c, 0, 1)[None, :]
    r2, c2 = np.minimum(r + 1, h - 1), np.minimum(c + 1, w - 1)
    one, two = window[r], window[r2]
    upper = one[:, c] * (1 - fx) + one[:, c2] * fx
    lower = two[:, c] * (1 - fx) + two[:, c2] * fx
    return np.nan_to_num(upper * (1 - fy) + lower * fy)


def pyramid(blocks: DataFrame, rasters: DataFrame, side: int, min_level: int, max_level: int, n: int = 65, triangulator: str = "grid", share: float = ERROR_SHARE, normals: bool = False) -> DataFrame:
    """raster, level, x, y, tile (gzipped), low, high, backend, vertices, triangles of every tile from min_level to max_level.

    rasters: raster, west, north, pixel (degrees), rows, cols. x counts from the west, y from the south. triangulator: grid;
    mesh, by the level's error, where n is 2^k + 1; or auto, the smaller of both when compressed (mesh if equal). normals come
    from a grid with a ring of the neighbours' heights. Places off the raster take its border's height; no data is 0.
    """
    if triangulator not in ("grid", "mesh", "auto") or triangulator != "grid" and (n < 3 or (n - 1) & (n - 2)):
        raise ValueError("triangulator is grid, mesh or auto; the latter two need 2^k + 1 vertices a side")
    facts = rasters.select(F.col("raster").cast("long").alias("raster"), *(F.col(c).cast("double").alias(c) for c in ("west", "north", "pixel")), *(F.col(c).cast("int").alias(c) for c in ("rows", "cols")))
    ring = 1 if normals else 0
    levels = range(min_level, max_level + 1)
    piece = "raster long, level int, x long, y long, west double, north double, pixel double, rows int, cols int, up int, across int, high int, wide int, data array<double>"
    names = [f.split()[0] for f in piece.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *[pa.int32()] * 6, pa.list_(pa.float64())]

    def places(level: int, index: np.ndarray, corner: float, pixel: float, k: int, down: bool) -> np.ndarray:
        """Of tiles along an axis, the places of their vertices (and ring), in pixels of overview k from its first centre."""
        step = 180.0 / (1 << level)
        at = (-90.0 if down else -180.0) + np.asarray(index)[..., None] * step + np.arange(-ring, n + ring) * (step / (n - 1))
        return ((corner - at[..., ::-1]) if down else (at - corner)) / pixel / (1 << k) - 0.5

    def used(level: int, rows: int, cols: int, pixel: float) -> int:
        """The overview a level samples; the last one there is, if that is less."""
        return min(overview_of(level, n, pixel), max(rows, cols).bit_length() - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = B._grid(batch.column("data"), side)
            made: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("raster", "brow", "bcol", "k", "west", "north", "pixel", "rows", "cols")]
            for at, (raster, brow, bcol, k, west, north, pixel, rows, cols) in enumerate(zip(*columns, strict=True)):
                for level in levels:
                    if used(level, rows, cols, pixel) != k:
                        continue
                    step, own = 180.0 / (1 << level), pixel * (1 << k)
                    size = (-(-rows // (1 << k)), -(-cols // (1 << k)))
                    cuts = []
                    for first, corner, down, pixels, count in ((bcol * side, west, False, size[1], 2 << level), (brow * side, north, True, size[0], 1 << level)):
                        # Tiles near the block, by the degrees it covers; those that look at its pixels stay.
                        ends = (corner - (first + side + 2) * own, corner - (first - 2) * own) if down else (corner + (first - 2) * own, corner + (first + side + 2) * own)
                        origin, margin = (-90.0 if down else -180.0), step / (n - 1) * ring
                        near = np.arange(max(0, math.floor((ends[0] - margin - origin) / step)), min(count - 1, math.floor((ends[1] + margin - origin) / step)) + 1)
                        p = places(level, near, corner, pixel, k, down)
                        a, b = _window(p[:, 0], p[:, -1], pixels)
                        lo, hi = np.maximum(a, first), np.minimum(b, first + side - 1)
                        cuts.append([(t, i - first, j - first + 1, i - s) for t, i, j, s in zip(near.tolist(), lo.tolist(), hi.tolist(), a.tolist(), strict=True) if i <= j])
                    for x, a, b, across in cuts[0]:
                        for y, c, d, up in cuts[1]:
                            made.append((raster, level, x, y, west, north, pixel, rows, cols, up, across, d - c, b - a, z[at, c:d, a:b].ravel()))
                if len(made) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names)
                    made = []
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names)

    def heights_of(key: tuple, pieces: list[tuple]) -> np.ndarray:
        """Heights of a tile's vertices (and ring), the north first."""
        _, level, x, y, west, north, pixel, rows, cols = key
        k = used(level, rows, cols, pixel)
        size = (-(-rows // (1 << k)), -(-cols // (1 << k)))
        r, c = places(level, np.array([y]), north, pixel, k, True)[0], places(level, np.array([x]), west, pixel, k, False)[0]
        (top,), (bottom,) = _window(r[:1], r[-1:], size[0])
        (left,), (right,) = _window(c[:1], c[-1:], size[1])
        window = np.full((bottom - top + 1, right - left + 1), np.nan)
        for up, across, high, wide, data in pieces:
            if high:
                window[up : up + high, across : across + wide] = data.reshape(high, wide)
        return _sampled(window, r - top, c - left)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        keys = [key for key, _ in done]
        every = np.stack([heights_of(*tile) for tile in done])
        inner = every[:, ring : ring + n, ring : ring + n]
        level, x, y = (np.array([key[i] for key in keys], dtype=np.int64) for i in (1, 2, 3))
        step = 180.0 / (1 << level)
        bounds = np.stack([-180 + x * step, -90 + y * step, -180 + (x + 1) * step, -90 + (y + 1) * step], axis=1)
        full = terrain.encode_grids(bounds, inner) if triangulator != "mesh" and not normals else None
        out = []
        for t, key in enumerate(keys):
            turned = None
            if normals:
                around = step[t] / (n - 1)
                w, s, e, u = bounds[t]
                turned = terrain.vertex_normals((w - around, s - around, e + around, u + around), every[t])[1:-1, 1:-1]
            best = None
            for backend in ("mesh", "grid") if triangulator == "auto" else (triangulator,):
                vertices, triangles = terrain.mesh(terrain.mesh_errors(inner[t]), error_of(key[1], n, share)) if backend == "mesh" else terrain.grid_mesh(n)
                plain = full[t] if backend == "grid" and full is not None else terrain.encode(tuple(bounds[t]), inner[t], vertices, triangles, turned)
                data = gzip.compress(plain, 6, mtime=0)
                if best is None or terrain.smaller(best[0], data) is data:
                    best = (data, backend, len(vertices), len(triangles))
            out.append((key[0], key[1], key[2], key[3], best[0], float(inner[t].min()), float(inner[t].max()), *best[1:]))
        kinds_ = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds_)], _NAMES)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, pieces = [], None, []
        for batch in batches:
            data = batch.column("data")
            flat = data.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
            ends = data.offsets.to_numpy() - data.offsets[0].as_py()
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names[:-1]), strict=True)):
                if row[:9] != key:
                    if key is not None:
                        done.append((key, pieces))
                        if len(done) == _AT_ONCE:
                            yield packed(done)
                            done = []
                    key, pieces = row[:9], []
                pieces.append((*row[9:], flat[ends[i] : ends[i + 1]]))
        if key is not None:
            yield packed([*done, (key, pieces)])

    over = B.ladder(blocks, side, least=1).withColumnRenamed("level", "k")
    rows = blocks.select(F.lit(0).alias("k"), *B.KEYS, "data").unionByName(over).join(facts, "raster")
    # A row of no height for each tile, so that tiles without a pixel are made too.
    ranges = tiles_of(facts, min_level, max_level).withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).join(facts, "raster")
    blank = ranges.select("raster", "level", "x", "y", "west", "north", "pixel", "rows", "cols", *(F.lit(0).alias(c) for c in ("up", "across", "high", "wide")), F.array().cast("array<double>").alias("data"))
    wanted = tiles_of(facts, min_level, max_level)
    pieces = rows.mapInArrow(cut, piece).join(wanted, ["raster", "level"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select(*names)
    keys = ["raster", "level", "x", "y"]
    total = wanted.agg(F.sum((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))).first()[0] or 0
    return blank.unionByName(pieces).repartition(max(1, -(-total // TILES_A_TASK)), *(F.col(k) for k in keys)).sortWithinPartitions(*keys).mapInArrow(built, _TILE)


def decoded(tiles: DataFrame, n: int) -> DataFrame:
    """raster, level, x, y, q: the quantised heights of tiles that are full n x n grids, by rows from the north."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = []
            for data in batch.column("tile").to_pylist():
                out = terrain.decode(gzip.decompress(data))
                q = np.full((n, n), -1, dtype=np.int32)
                q[np.round((1 - out["v"] / 32767) * (n - 1)).astype(int), np.round(out["u"] / 32767 * (n - 1)).astype(int)] = out["h"]
                grids.append(q.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES[:4]), pa.array(grids, pa.list_(pa.int32()))], [*_NAMES[:4], "q"])

    return tiles.select(*_NAMES[:4], "tile").mapInArrow(run, "raster long, level int, x long, y long, q array<int>")


def layers(tiles: DataFrame, rasters: DataFrame, min_level: int, max_level: int, normals: bool = False) -> DataFrame:
    """raster and its layer document (layer, JSON) and summary (meta, JSON) from the tiles made."""
    runs = terrain.layer_availability(tiles.select(F.struct("raster", "level").alias("level"), "x", "y"))
    by_level = runs.select("level.raster", "level.level", "ranges").groupBy("raster").agg(F.map_from_entries(F.collect_list(F.struct("level", "ranges"))).alias("m"))
    heights = tiles.groupBy("raster").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    none = F.array().cast("array<struct<startX:bigint,startY:bigint,endX:bigint,endY:bigint>>")
    available = F.transform(F.sequence(F.lit(min_level), F.lit(max_level)), lambda z: F.coalesce(F.try_element_at("m", z), none))
    valid = F.array(F.col("west"), F.col("north") - F.col("rows") * F.col("pixel"), F.col("west") + F.col("cols") * F.col("pixel"), F.col("north"))
    text = lambda v: F.lit(v)
    document = F.to_json(
        F.struct(
            text("1.0").alias("tilejson"), F.col("raster").cast("string").alias("name"), text("1.0.0").alias("version"), text("quantized-mesh-1.0").alias("format"), text("tms").alias("scheme"), F.array(text("{z}/{x}/{y}.terrain")).alias("tiles"), text("EPSG:4326").alias("projection"),
            F.array(*(F.lit(v) for v in (-180, -90, 180, 90))).alias("bounds"), valid.alias("valid_bounds"), F.lit(min_level).alias("minzoom"), F.lit(max_level).alias("maxzoom"), available.alias("available"), F.array(*([text("octvertexnormals")] if normals else [])).cast("array<string>").alias("extensions"),
        )
    )
    meta = F.to_json(F.struct(F.lit(min_level).alias("minLevel"), F.lit(max_level).alias("maxLevel"), F.col("low").alias("minHeight"), F.col("high").alias("maxHeight"), valid.alias("bounds"), text("EPSG:4326").alias("scheme")))
    return rasters.join(by_level, "raster").join(heights, "raster").select("raster", document.alias("layer"), meta.alias("meta"))


def with_base(task: DataFrame, base: DataFrame) -> DataFrame:
    """level and ranges of a task's and its base's availability together, from level 0: of one level, the base's ranges, then those of the task that differ."""
    both = base.select("level", F.lit(0).alias("place"), "ranges").unionByName(task.select("level", F.lit(1).alias("place"), "ranges"))
    pick = lambda k: F.coalesce(F.first(F.when(F.col("place") == k, F.col("ranges")), ignorenulls=True), F.array().cast(task.schema["ranges"].dataType))
    found = both.groupBy("level").agg(pick(0).alias("b"), pick(1).alias("t"))
    joined = found.select("level", F.concat("b", F.array_except("t", "b")).alias("ranges"))
    # The levels between that neither has are empty.
    deepest = joined.agg(F.max("level").alias("deepest"))
    every = deepest.select(F.explode(F.sequence(F.lit(0), F.col("deepest"))).alias("level"))
    return every.join(joined, "level", "left").select("level", F.coalesce("ranges", F.array().cast(task.schema["ranges"].dataType)).alias("ranges"))
