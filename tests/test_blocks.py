from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilespan.operators import blocks, contours
from tilespan.plans import rasters
from tilespan.plans.catalogue import ORACLES

SIDE = 8


def _table(spark, rasters):
    """Blocks of {raster: 2-d array}; padded with no data."""
    rows = []
    for k, z in rasters.items():
        h, w = (-(-n // SIDE) for n in z.shape)
        full = np.full((h * SIDE, w * SIDE), np.nan)
        full[: z.shape[0], : z.shape[1]] = z
        rows += [(k, r, c, full[r * SIDE : (r + 1) * SIDE, c * SIDE : (c + 1) * SIDE].ravel().tolist()) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "raster long, brow int, bcol int, data array<double>").repartition(3)


def _whole(frame, shape, value="data", dtype=float):
    out = np.full(shape, np.nan if dtype is float else 0, dtype=dtype)
    for r in frame.collect():
        out[r.brow * SIDE : (r.brow + 1) * SIDE, r.bcol * SIDE : (r.bcol + 1) * SIDE] = np.array([np.nan if v is None else v for v in r[value]]).reshape(SIDE, SIDE)
    return out


def _hills(seed=0, shape=(40, 32), holes=True):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: shape[0], : shape[1]]
    z = 100 * np.sin(x / 5.0 + seed) * np.cos(y / 7.0) + rng.normal(0, 3, shape)
    if holes:
        z[5:7, 9:12] = np.nan
        z[20:21, 15:17] = np.nan
    return z


def _plain_shade(z, dx=30.0, dy=30.0):
    gx, gy = np.zeros_like(z), np.zeros_like(z)
    at = lambda r, c: z[r, c] if 0 <= r < z.shape[0] and 0 <= c < z.shape[1] else np.nan
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            for g, (a, b), d in ((gx, (at(r, c - 1), at(r, c + 1)), dx), (gy, (at(r - 1, c), at(r + 1, c)), -dy)):
                here = z[r, c]
                g[r, c] = 0 if np.isnan(a) and np.isnan(b) else (b - here) / d if np.isnan(a) else (here - a) / d if np.isnan(b) else (b - a) / (2 * d)
    az, alt = np.radians(90 - 315), np.radians(45)
    lit = (-gx * np.cos(az) * np.cos(alt) - gy * np.sin(az) * np.cos(alt) + np.sin(alt)) / np.sqrt(gx**2 + gy**2 + 1)
    return np.where(np.isnan(z), np.nan, np.clip(lit - np.sin(alt) + 0.5, 0, 1))


def test_relief_has_no_seams(spark):
    z = _hills()
    found = _whole(blocks.relief(_table(spark, {1: z}), SIDE, dx=30.0, dy=30.0), z.shape, "shade")
    assert np.allclose(found, _plain_shade(z), equal_nan=True)


def test_pixels_there_and_back(spark):
    z = _hills(2, (13, 20))
    pixels = [(7, r, c, float(z[r, c])) for r in range(13) for c in range(20) if not np.isnan(z[r, c])]
    frame = spark.createDataFrame([*pixels, pixels[0]], "raster long, row int, col int, elev double")
    again = blocks.to_pixels(blocks.from_pixels(frame, SIDE), SIDE)
    assert sorted(map(tuple, again.collect())) == sorted(pixels)


@pytest.mark.parametrize("blend", ["soft", "overlay"])
def test_painted(spark, blend):
    z = _hills(3, (16, 16))
    wet = np.zeros((16, 16))
    wet[3:5] = 1
    wet[12, 2:9] = [2, 3, 2, 3, 0, 5, 2]
    breaks, colours = [-50.0, 0.0, 50.0], [(0, 60, 200), (10, 160, 40), (200, 180, 20), (250, 250, 250)]
    water = _table(spark, {1: wet}).where("bcol = 0")
    found = blocks.painted(_table(spark, {1: z}), SIDE, breaks, colours, blend, water, dx=30.0, dy=30.0)
    wet[:, 8:] = 0
    got = np.zeros((16, 16, 4), dtype=int)
    for r in found.collect():
        got[r.brow * 8 : r.brow * 8 + 8, r.bcol * 8 : r.bcol * 8 + 8] = np.frombuffer(r.rgba, np.uint8).reshape(8, 8, 4)
    shade = _plain_shade(z)
    for r in range(16):
        for c in range(16):
            if wet[r, c] == 1:
                want = (0, 0, 255, 255)
            elif wet[r, c] in (2, 3):
                want = (0, 128, 255, 255)
            elif np.isnan(z[r, c]):
                want = (0, 0, 0, 0)
            else:
                rgb, i = np.array(colours[sum(z[r, c] >= b for b in breaks)]) / 255, shade[r, c]
                mixed = np.where(rgb <= 0.5, 2 * i * rgb, 1 - 2 * (1 - i) * (1 - rgb)) if blend == "overlay" else 2 * i * rgb + (1 - 2 * i) * rgb**2
                want = (*np.floor(np.clip(mixed, 0, 1) * 255 + 0.5).astype(int), 255)
            assert np.abs(got[r, c] - want).max() <= (1 if wet[r, c] == 0 else 0), (r, c)


def test_mosaic_lays_the_least_rank_on_top(spark):
    rasters = {1: _hills(1, (20, 20)), 2: _hills(2, (16, 30)), 3: _hills(3, (9, 9), False), 4: _hills(4, (8, 8), False)}
    placing = {1: (0, 0, 5), 2: (7, 3, 2), 3: (-4, 11, 2), 4: (60, 60, 0)}
    table = spark.createDataFrame([(k, 9, *p) for k, p in placing.items()], "raster long, mosaic int, top int, left int, rank int")
    found = blocks.to_pixels(blocks.mosaic(_table(spark, rasters), table, SIDE), SIDE)
    want = {}
    for k in sorted(rasters, key=lambda k: (-placing[k][2], -k)):
        for (r, c), v in np.ndenumerate(rasters[k]):
            if not np.isnan(v):
                want[placing[k][0] + r, placing[k][1] + c] = v
    assert {(r.row, r.col): r.elev for r in found.collect()} == want
    assert {r.raster for r in found.select("raster").distinct().collect()} == {9}


def test_ladder(spark):
    rasters = {1: _hills(5, (40, 72)), 2: _hills(6, (8, 8), False), 3: np.full((16, 8), np.nan)}
    found = blocks.ladder(_table(spark, rasters), SIDE, least=2)
    got = {(r.level, r.raster): set() for r in found.collect()}
    assert {k for k in got if k[1] == 2} == {(1, 2), (2, 2)} and max(k[0] for k in got if k[1] == 1) == 5
    for k, z in rasters.items():
        full = np.full(tuple(-(-n // 64) * 64 for n in z.shape), np.nan)
        full[: z.shape[0], : z.shape[1]] = z
        for level in range(1, 6):
            n = 2**level
            part = full.reshape(full.shape[0] // n, n, full.shape[1] // n, n)
            count = (~np.isnan(part)).sum(axis=(1, 3))
            want = {(r, c): v for (r, c), v in np.ndenumerate(np.where(count > 0, np.nansum(part, axis=(1, 3)) / np.maximum(count, 1), np.nan)) if not np.isnan(v)}
            have = {(r.row, r.col): r.elev for r in blocks.to_pixels(found.where((F.col("level") == level) & (F.col("raster") == k)), SIDE).collect()}
            if (level, k) in got:
                assert have.keys() == want.keys() and all(abs(have[p] - want[p]) < 1e-9 for p in want)
            else:
                assert not have


def _crossings(z, level):
    out = set()
    known = ~np.isnan(z)
    full = known[:-1, :-1] & known[:-1, 1:] & known[1:, :-1] & known[1:, 1:]
    for r in range(z.shape[0] - 1):
        for c in range(z.shape[1] - 1):
            if full[r, c]:
                for p, q in (((r, c), (r, c + 1)), ((r, c), (r + 1, c)), ((r + 1, c), (r + 1, c + 1)), ((r, c + 1), (r + 1, c + 1))):
                    a, b = z[p], z[q]
                    if (a > level) != (b > level):
                        t = (level - a) / (b - a)
                        out.add((round(p[1] + 0.5 + t * (q[1] - p[1]), 9), round(p[0] + 0.5 + t * (q[0] - p[0]), 9)))
    return out


def test_contours_pass_where_heights_cross_the_level(spark):
    z = _hills(7)
    found = contours.contours(_table(spark, {1: z}), SIDE, 25.0, 4).collect()
    levels = {r.level for r in found}
    assert levels == {25.0 * k for k in range(-5, 6)} & levels and len(levels) > 6
    for level in levels:
        got = {(round(x, 9), round(y, 9)) for r in found if r.level == level for x, y in zip(r.xs, r.ys, strict=True)}
        assert got == _crossings(z, level)
    assert all(r.is_index == (r.level % 100 == 0) for r in found)
    # Each step of a line stays within a cell.
    for r in found:
        steps = np.abs(np.diff(r.xs)), np.abs(np.diff(r.ys))
        assert max(s.max() for s in steps) <= 1 and r.closed == ((r.xs[0], r.ys[0]) == (r.xs[-1], r.ys[-1]))


def test_contour_points_at_one_place_count_by_side(spark, tmp_path):
    # A pixel on the level amid higher ones: its four sides are all crossed at the pixel itself.
    z = np.full(64, 100.0)
    z[20] = 75.0
    rows = [(0, [v / 1000 for v in z.tolist()])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = [tuple(r) for r in rasters.contour_points(spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(found) == sorted(db.sql(ORACLES["contour_points"]).fetchall())
    assert len(set(found)) < len(found)


def test_points_are_sent_on_before_a_batch_of_blocks_is_done(monkeypatch):
    monkeypatch.setattr(contours.B, "with_neighbours", lambda given, side: SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = contours.contours(None, SIDE, 75.0, 2)
    n, lists = 4000, pa.list_(pa.float64())
    z = np.random.default_rng(3).normal(0, 125, (n, SIDE * SIDE))
    keys = [pa.array(np.arange(n)), *2 * [pa.array(np.zeros(n, dtype=np.int32))]]
    batch = pa.RecordBatch.from_arrays([*keys, pa.array(list(z), lists), *9 * [pa.nulls(n, lists)]], [*blocks.KEYS, "data", *(f"n{k}" for k in range(9))])
    points = [sum(map(len, out.column("nodes").to_pylist())) for out in run(iter([batch]))]
    alone = [sum(map(len, out.column("nodes").to_pylist())) for k in range(4) for out in run(iter([batch.slice(k * 1000, 1000)]))]
    assert sum(points) == sum(alone) > 200_000 and max(points) < 100_000


def test_lines_join_over_blocks(spark):
    y, x = np.mgrid[:48, :48]
    cone = 100 - np.hypot(x - 23.3, y - 24.1) * 3
    ramp = x * 2.0 + 1
    found = contours.lines(contours.contours(_table(spark, {1: cone, 2: ramp}), SIDE, 20.0)).collect()
    rings = {r.level: r for r in found if r.raster == 1 and r.level >= 40}
    assert set(rings) == {40.0, 60.0, 80.0} and all(r.closed for r in rings.values())
    for level, r in rings.items():
        assert abs(r.length - 2 * np.pi * (100 - level) / 3) < 0.5 and r.points == len(_crossings(cone, level))
    straight = {r.level: r for r in found if r.raster == 2}
    assert set(straight) == {20.0, 40.0, 60.0, 80.0} and not any(r.closed for r in straight.values())
    assert all(abs(r.length - 47) < 1e-9 and r.points == 48 and r.pieces == 6 for r in straight.values())
    assert len({(r.raster, r.level, r.line) for r in found}) == len(found)


def test_flat_steep_and_empty_rasters(spark):
    flat = _table(spark, {1: np.full((16, 16), 7.0), 2: np.full((8, 8), np.nan), 3: np.arange(64).reshape(8, 8) * 1000.0})
    assert contours.contours(flat, SIDE, 1.0).collect() == []
    none = spark.createDataFrame([], "raster long, brow int, bcol int, data array<double>")
    assert contours.lines(contours.contours(none, SIDE, 1.0)).collect() == [] and blocks.relief(none, SIDE).collect() == [] and blocks.ladder(none, SIDE).collect() == []


def test_segments_of_stacked_blocks_are_those_of_each():
    rng = np.random.default_rng(5)
    z = rng.integers(0, 6, (7, 5, 6)).astype(float)
    z[2, 1, 1] = np.nan
    z[3] = 2.0  # flat: nothing is crossed
    levels = np.array([1.0, 2.0, 3.0, 2.0, 4.0, 2.5, 2.0])
    of, found = contours._segments(z, levels)
    assert (np.diff(of) >= 0).all() and 3 not in of and len(found)
    for k in range(len(z)):
        alone, pairs = contours._segments(z[k : k + 1], levels[k : k + 1])
        assert not alone.any() and (pairs == found[of == k]).all()
