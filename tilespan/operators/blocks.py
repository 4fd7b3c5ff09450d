"""Rasters as tables of square blocks: (raster, brow, bcol, data), data a row-major array of side x side heights.

A height that is null or NaN is no data; blocks at a raster's border are padded with it. Blocks are the unit of work and
of movement: what a kernel needs from its neighbours comes as strips one pixel wide, not as blocks. Kernels run with
numpy on Arrow batches; a task holds a batch of blocks, never a raster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["raster", "brow", "bcol"]
_SHAPE = "raster long, brow int, bcol int"
#: Neighbours in reading order; the block itself is the one in the middle.
_AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def from_pixels(pixels: DataFrame, side: int) -> DataFrame:
    """Blocks of a pixel table (raster, row, col, elev); pixels that are not there are no data, of repeated ones the largest counts."""
    cell = F.map_from_entries(F.collect_list(F.struct("at", "elev")))
    placed = pixels.select(F.col("raster").cast("long").alias("raster"), F.floor(F.col("row") / side).cast("int").alias("brow"), F.floor(F.col("col") / side).cast("int").alias("bcol"), (F.pmod("row", F.lit(side)) * side + F.pmod("col", F.lit(side))).cast("int").alias("at"), F.col("elev").cast("double").alias("elev"))
    held = placed.groupBy(*KEYS, "at").agg(F.max("elev").alias("elev")).groupBy(*KEYS).agg(cell.alias("m"))
    return held.select(*KEYS, F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float("nan")))).alias("data"))


def to_pixels(blocks: DataFrame, side: int, value: str = "data", name: str = "elev") -> DataFrame:
    """raster, row, col and the value of each pixel that has data."""
    flat = blocks.select(*KEYS, F.posexplode(value).alias("at", name)).where(F.col(name).isNotNull() & ~F.isnan(name))
    place = lambda b, inner: (F.col(b) * side + inner).cast("int")
    return flat.select("raster", place("brow", F.floor(F.col("at") / side)).alias("row"), place("bcol", F.col("at") % side).alias("col"), name)


def _grid(column: pa.Array, side: int) -> np.ndarray:
    """A list column as (rows, side, side)."""
    return column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), side, side)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n = len(values)
    each = values.reshape(n, -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each.shape[1]), pa.array(each.ravel(), kind))


def with_neighbours(blocks: DataFrame, side: int) -> DataFrame:
    """raster, brow, bcol, data and n0..n8: the neighbours' strips next to the block in reading order (n4: null), null where there is none."""
    row = lambda r: F.slice("data", r * side + 1, side)
    col = lambda c: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.get("data", i * side + c))
    last = side - 1

    def strip(dr: int, dc: int):
        """What the neighbour at (dr, dc) of a block is to get of it."""
        if not dr and not dc:
            return F.col("data")
        if not dc:
            return row(0 if dr < 0 else last)
        if not dr:
            return col(0 if dc < 0 else last)
        return F.slice("data", (0 if dr < 0 else last) * side + (0 if dc < 0 else last) + 1, 1)

    # To the neighbour at (dr, dc) a block is the one at (-dr, -dc).
    sent = F.array(*(F.struct((F.col("brow") + dr).alias("brow"), (F.col("bcol") + dc).alias("bcol"), F.lit(8 - k).alias("place"), strip(dr, dc).alias("part")) for k, (dr, dc) in enumerate(_AROUND)))
    parts = blocks.select("raster", F.inline(sent))
    held = parts.groupBy(*KEYS).agg(*(F.first(F.when(F.col("place") == k, F.col("part")), ignorenulls=True).alias(f"n{k}") for k in range(9)))
    return held.where("n4 is not null").select(*KEYS, F.col("n4").alias("data"), *(F.lit(None).cast("array<double>").alias("n4") if k == 4 else F.col(f"n{k}") for k in range(9)))


def ringed(batch: pa.RecordBatch, side: int) -> np.ndarray:
    """Blocks with a pixel of their neighbours around them: (rows, side + 2, side + 2), NaN where there is none."""
    out = np.full((batch.num_rows, side + 2, side + 2), np.nan)
    out[:, 1:-1, 1:-1] = _grid(batch.column("data"), side)
    spans = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
    for k, (dr, dc) in enumerate(_AROUND):
        column = batch.column(f"n{k}")
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)) if k != 4 else ()
        if len(there):
            values = column.drop_null().flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
            out[there, spans[dr], spans[dc]] = values.reshape(len(there), side if dr == 0 else 1, side if dc == 0 else 1)
    return out


def mapped(blocks: DataFrame, kernel: Callable[[pa.RecordBatch], list[pa.Array]], fields: str) -> DataFrame:
    """KEYS and the columns that a kernel makes of a batch of blocks, one row each."""
    names = [*KEYS, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), *kernel(batch)], names)

    return blocks.mapInArrow(run, f"{_SHAPE}, {fields}")


def _slope(z: np.ndarray, axis: int, spacing: float) -> np.ndarray:
    """Central differences of the inner part of ringed blocks, one-sided beside no data, 0 where both sides are."""
    cut = (slice(None), slice(1, -1), slice(1, -1))
    here = z[cut]
    before, after = (np.roll(z, s, axis)[cut] for s in (1, -1))
    lone, first, last = np.isnan(before) & np.isnan(after), np.isnan(before), np.isnan(after)
    return np.where(lone, 0.0, np.where(first, (after - here) / spacing, np.where(last, (here - before) / spacing, (after - before) / (2 * spacing))))


def shade_of(z: np.ndarray, azimuth: float, altitude: float, exaggeration: float, dx: float, dy: float) -> np.ndarray:
    """Relief of ringed blocks from 0 to 1; flat ground is 0.5 whatever the raster, no data NaN."""
    az, alt = np.radians(90 - azimuth), np.radians(altitude)
    gx, gy = _slope(z, 2, dx) * exaggeration, _slope(z, 1, -dy) * exaggeration
    lit = (-gx * np.cos(az) * np.cos(alt) - gy * np.sin(az) * np.cos(alt) + np.sin(alt)) / np.sqrt(gx * gx + gy * gy + 1)
    return np.where(np.isnan(z[:, 1:-1, 1:-1]), np.nan, np.clip(lit - np.sin(alt) + 0.5, 0.0, 1.0))


def relief(blocks: DataFrame, side: int, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Blocks of relief (shade), seamless across blocks: one shuffle, whatever the raster's size."""
    return mapped(with_neighbours(blocks, side), lambda b: [_lists(shade_of(ringed(b, side), azimuth, altitude, exaggeration, dx, dy), pa.float64())], "shade array<double>")


def painted(blocks: DataFrame, side: int, breaks: list[float], colours: list[tuple[int, int, int]], blend: str = "soft", water: DataFrame | None = None, ocean: tuple[int, int, int, int] = (0, 0, 255, 255), inland: tuple[int, int, int, int] = (0, 128, 255, 255), **light: float) -> DataFrame:
    """Blocks of colour (rgba: four bytes a pixel): height tints under relief, water over both; no data is clear.

    breaks rise, and there is one colour more than breaks. blend: overlay, or anything else for soft light. water: blocks
    of classes on the same grid (1: ocean, 2 and 3: inland, others dry); a block without one is dry.
    """
    shades, edges = np.array(colours, dtype=np.float64) / 255, np.array(breaks, dtype=np.float64)
    options = {"azimuth": 315.0, "altitude": 45.0, "exaggeration": 1.0, "dx": 1.0, "dy": 1.0} | light
    rows = with_neighbours(blocks, side)
    rows = rows.join(water.select(*KEYS, F.col("data").alias("wet")), KEYS, "left") if water is not None else rows.withColumn("wet", F.lit(None).cast("array<double>"))

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        z = ringed(batch, side)
        inner = z[:, 1:-1, 1:-1]
        none = np.isnan(inner)
        light_ = np.where(none, 0.5, shade_of(z, **options))[..., None]
        rgb = shades[np.searchsorted(edges, np.where(none, -np.inf, inner), side="right")]
        if blend == "overlay":
            mixed = np.where(rgb <= 0.5, 2 * light_ * rgb, 1 - 2 * (1 - light_) * (1 - rgb))
        else:
            mixed = 2 * light_ * rgb + (1 - 2 * light_) * rgb**2
        out = np.zeros((*inner.shape, 4), dtype=np.uint8)
        out[..., :3] = np.floor(np.clip(mixed, 0, 1) * 255 + 0.5)
        out[..., 3] = 255
        out[none] = 0
        wet = batch.column("wet")
        there = np.flatnonzero(wet.is_valid().to_numpy(zero_copy_only=False))
        if len(there):
            kinds = np.zeros(inner.shape)
            kinds[there] = _grid(wet.drop_null(), side)
            out[kinds == 1] = ocean
            out[(kinds == 2) | (kinds == 3)] = inland
        return [pa.array([o.tobytes() for o in out], pa.binary())]

    return mapped(rows, kernel, "rgba binary")


def mosaic(blocks: DataFrame, placing: DataFrame, side: int) -> DataFrame:
    """Blocks of mosaics: rasters laid over each other on one grid; where several have data, the least rank wins, then the least raster.

    placing: raster, mosaic, top, left (pixels of the raster's corner on the mosaic's grid), rank. A raster may lie at any
    pixel, also before the grid's origin. Blocks are cut at the borders of the mosaic's blocks, so each pixel moves once;
    the pieces of a block are laid from the highest rank down, one at a time.
    """
    kept = placing.select(F.col("raster").cast("long").alias("raster"), F.col("mosaic").cast("long").alias("mosaic"), F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), F.col("rank").cast("long").alias("rank"))
    piece = "raster long, brow int, bcol int, rank long, source long, up int, across int, high int, wide int, data array<double>"
    names = [f.split()[0] for f in piece.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _grid(batch.column("data"), side)
            made = []
            for at, (m, k, source, top, left) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("mosaic", "rank", "raster", "y", "x")), strict=True)):
                for r in range(top // side, (top + side - 1) // side + 1):
                    for c in range(left // side, (left + side - 1) // side + 1):
                        a, b = max(0, r * side - top), min(side, (r + 1) * side - top)
                        d, e = max(0, c * side - left), min(side, (c + 1) * side - left)
                        part = z[at, a:b, d:e]
                        if not np.isnan(part).all():
                            made.append((m, r, c, k, source, top + a - r * side, left + d - c * side, b - a, e - d, part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in made], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.float64())])], names)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([d[0][i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))), _lists(np.array([d[1] for d in done]).reshape(len(done), side * side), pa.float64())], [*KEYS, "data"])

        for batch in batches:
            done = []
            for row in zip(*(batch.column(n).to_pylist() for n in ("raster", "brow", "bcol", "up", "across", "high", "wide", "data")), strict=True):
                if row[:3] != at:
                    if at is not None:
                        done.append((at, held))
                    at, held = row[:3], np.full((side, side), np.nan)
                up, across, high, wide = row[3:7]
                part = np.array([np.nan if v is None else v for v in row[7]]).reshape(high, wide)
                into = held[up : up + high, across : across + wide]
                np.copyto(into, part, where=~np.isnan(part))
            if done:
                yield out(done)
        if at is not None:
            yield out([(at, held)])

    placed = blocks.join(kept, "raster").withColumns({"y": F.col("top") + F.col("brow") * side, "x": F.col("left") + F.col("bcol") * side}).select("raster", "mosaic", "rank", "y", "x", "data")
    pieces = placed.mapInArrow(cut, piece).repartition(*(F.col(k) for k in KEYS)).sortWithinPartitions(*KEYS, F.desc("rank"), F.desc("source"))
    return pieces.mapInArrow(laid, f"{_SHAPE}, data array<double>")


def ladder(blocks: DataFrame, side: int, least: int = 256) -> DataFrame:
    """level and blocks of each raster's overviews: means over 2^level x 2^level pixels with data, as long as the longer side keeps `least` pixels.

    All levels come from one pass: a block gives each level its sums and counts, and these are added where they meet.
    """
    sizes = blocks.groupBy("raster").agg(((F.greatest(F.max("brow"), F.max("bcol")) + 1) * side).alias("longest"))
    longest = sizes.agg(F.max("longest")).first()[0] or 0
    levels = [k for k in range(1, 32) if longest >> k >= least]
    names = [*KEYS, "level", "up", "across", "high", "total", "n"]

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _grid(batch.column("data"), side)
            total, n = np.nan_to_num(z), (~np.isnan(z)).astype(np.int64)
            raster, brow, bcol = (batch.column(k).to_numpy().astype(np.int64) for k in KEYS)
            for k in levels:
                size = total.shape[1]
                if size > 1:
                    total, n = (v.reshape(len(v), size // 2, 2, size // 2, 2).sum(axis=(2, 4)) for v in (total, n))
                size = total.shape[1]
                # The block's corner on the level's grid; beyond one pixel a block is a part of one.
                top, left = (brow * side) >> k, (bcol * side) >> k
                columns = [pa.array(raster), pa.array((top // side).astype(np.int32)), pa.array((left // side).astype(np.int32)), pa.array(np.full(len(z), k, np.int32)), pa.array((top % side).astype(np.int32)), pa.array((left % side).astype(np.int32)), pa.array(np.full(len(z), size, np.int32)), _lists(total, pa.float64()), _lists(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = total = n = None

        def out(done: list[tuple]) -> pa.RecordBatch:
            with np.errstate(invalid="ignore", divide="ignore"):
                means = [np.where(c > 0, t / c, np.nan).ravel() for _, t, c in done]
            return pa.RecordBatch.from_arrays([*(pa.array([d[0][i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))), _lists(np.array(means), pa.float64())], [*KEYS, "level", "data"])

        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:4] != at:
                    if at is not None:
                        done.append((at, total, n))
                    at, total, n = row[:4], np.zeros((side, side)), np.zeros((side, side), dtype=np.int64)
                cut = (slice(row[4], row[4] + row[6]), slice(row[5], row[5] + row[6]))
                total[cut] += np.array(row[7]).reshape(row[6], row[6])
                n[cut] += np.array(row[8]).reshape(row[6], row[6])
            if done:
                yield out(done)
        if at is not None:
            yield out([(at, total, n)])

    parts = blocks.select(*KEYS, "data").mapInArrow(halved, f"{_SHAPE}, level int, up int, across int, high int, total array<double>, n array<long>")
    order = [*KEYS, "level"]
    summed = parts.repartition(*(F.col(k) for k in order)).sortWithinPartitions(*order).mapInArrow(added, f"{_SHAPE}, level int, data array<double>")
    return summed.join(sizes, "raster").where(F.expr("shiftright(longest, level)") >= least).select("level", *KEYS, "data")
