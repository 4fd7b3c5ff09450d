import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import SIDE, _hills, _table
from tilespan.operators import pyramid, terrain

RASTERS = "raster long, west double, north double, pixel double, rows int, cols int"


def _mean(z, k):
    n = 1 << k
    full = np.full(tuple(-(-s // n) * n for s in z.shape), np.nan)
    full[: z.shape[0], : z.shape[1]] = z
    part = full.reshape(full.shape[0] // n, n, full.shape[1] // n, n)
    count = (~np.isnan(part)).sum(axis=(1, 3))
    return np.where(count > 0, np.nansum(part, axis=(1, 3)) / np.maximum(count, 1), np.nan)


def _plain_heights(z, west, north, pixel, level, x, y, n, ring=0):
    k = min(pyramid.overview_of(level, n, pixel), max(z.shape).bit_length() - 1)
    z, step = _mean(z, k), 180 / 2**level
    out = np.zeros((n + 2 * ring, n + 2 * ring))
    for i in range(n + 2 * ring):
        for j in range(n + 2 * ring):
            lat, lon = -90 + (y + 1) * step - (i - ring) * step / (n - 1), -180 + x * step + (j - ring) * step / (n - 1)
            r, c = (north - lat) / pixel / 2**k - 0.5, (lon - west) / pixel / 2**k - 0.5
            a, b = (min(max(math.floor(v), 0), max(0, s - 2)) for v, s in ((r, z.shape[0]), (c, z.shape[1])))
            fy, fx = min(max(r - a, 0), 1), min(max(c - b, 0), 1)
            a2, b2 = min(a + 1, z.shape[0] - 1), min(b + 1, z.shape[1] - 1)
            v = (z[a, b] * (1 - fx) + z[a, b2] * fx) * (1 - fy) + (z[a2, b] * (1 - fx) + z[a2, b2] * fx) * fy
            out[i, j] = 0 if np.isnan(v) else v
    return out


def _decoded_heights(tile, n):
    out = terrain.decode(gzip.decompress(tile.tile))
    h = tile.low + out["h"] / 32767 * (tile.high - tile.low)
    grid = np.full((n, n), np.nan)
    grid[np.round((1 - out["v"] / 32767) * (n - 1)).astype(int), np.round(out["u"] / 32767 * (n - 1)).astype(int)] = h
    return grid, out


def _world(spark):
    hills = {1: _hills(1, (40, 72)), 2: _hills(2, (24, 24), False)}
    facts = [(1, 10.013, 47.021, 0.01, 40, 72), (2, -70.004, -30.0071, 0.02, 24, 24)]
    return hills, {f[0]: f[1:4] for f in facts}, spark.createDataFrame(facts, RASTERS)


def test_many_grids_are_encoded_as_one_by_one():
    rng = np.random.default_rng(0)
    for n in (2, 9, 17):
        bounds = np.array([(10.0, 20.0, 11.0, 21.0), (-180.0, -90.0, 0.0, 90.0), (100.0, 60.0, 100.5, 60.5)])
        heights = np.stack([rng.normal(size=(n, n)) * 900, np.zeros((n, n)), rng.normal(size=(n, n))])
        vertices, triangles = terrain.grid_mesh(n)
        for got, b, h in zip(terrain.encode_grids(bounds, heights), bounds, heights, strict=True):
            want = terrain.encode(tuple(b), h, vertices, triangles)
            assert got[88:] == want[88:]
            a, c = terrain.decode(got), terrain.decode(want)
            assert np.allclose(a["centre"], c["centre"]) and (a["low"], a["high"]) == (c["low"], c["high"])
            assert np.allclose(np.frombuffer(got[32:88], "<f8"), np.frombuffer(want[32:88], "<f8"), rtol=1e-9)


def test_tiles_hold_the_sampled_heights_and_meet(spark):
    hills, facts, rasters = _world(spark)
    n = 9
    tiles = pyramid.pyramid(_table(spark, hills), rasters, SIDE, 6, 11, n).collect()
    wanted = {(r.raster, r.level, x, y) for r in pyramid.tiles_of(rasters, 6, 11).collect() for x in range(r.x0, r.x1 + 1) for y in range(r.y0, r.y1 + 1)}
    assert {(t.raster, t.level, t.x, t.y) for t in tiles} == wanted and len(tiles) == len(wanted) > 60
    edges = {}
    for t in tiles:
        west, north, pixel = facts[t.raster]
        want = _plain_heights(hills[t.raster], west, north, pixel, t.level, t.x, t.y, n)
        got, out = _decoded_heights(t, n)
        assert np.abs(got - want).max() <= (want.max() - want.min()) / 32767 + 1e-9 and math.isclose(t.low, want.min(), abs_tol=1e-9)
        assert (t.backend, t.vertices, t.triangles, out["rest"]) == ("grid", n * n, 2 * (n - 1) ** 2, 0)
        edges[t.raster, t.level, t.x, t.y] = got
    met = 0
    for (r, z, x, y), h in edges.items():
        for other, mine, theirs in (((r, z, x + 1, y), h[:, -1], lambda o: o[:, 0]), ((r, z, x, y + 1), h[0], lambda o: o[-1])):
            if other in edges:
                spread = max(np.ptp(h), np.ptp(edges[other])) / 32767
                assert np.abs(mine - theirs(edges[other])).max() <= 2 * spread + 1e-9
                met += 1
    assert met > 50


@pytest.mark.parametrize("triangulator", ["mesh", "auto"])
def test_triangulations_keep_borders_and_error(spark, triangulator):
    hills, facts, rasters = _world(spark)
    n = 17
    tiles = pyramid.pyramid(_table(spark, hills), rasters, SIDE, 9, 10, n, triangulator).collect()
    plain = {(t.raster, t.level, t.x, t.y): t for t in pyramid.pyramid(_table(spark, hills), rasters, SIDE, 9, 10, n).collect()}
    for t in tiles:
        out = terrain.decode(gzip.decompress(t.tile))
        assert [len(e) for e in out["edges"]] == [n] * 4
        if triangulator == "mesh":
            assert t.backend == "mesh"
        else:
            assert len(t.tile) <= len(plain[t.raster, t.level, t.x, t.y].tile)
    assert triangulator == "mesh" or {t.backend for t in tiles} <= {"mesh", "grid"}


def test_normals_agree_at_common_edges(spark):
    hills, facts, rasters = _world(spark)
    n = 9
    found = {}
    for t in pyramid.pyramid(_table(spark, hills), rasters, SIDE, 10, 10, n, normals=True).collect():
        data = gzip.decompress(t.tile)
        out = terrain.decode(data)
        assert out["rest"] == 5 + 2 * n * n
        oct_ = np.frombuffer(data[-2 * n * n :], np.uint8).reshape(-1, 2)
        rows, cols = np.round((1 - out["v"] / 32767) * (n - 1)).astype(int), np.round(out["u"] / 32767 * (n - 1)).astype(int)
        grid = np.zeros((n, n, 2), dtype=int)
        grid[rows, cols] = oct_
        found[t.raster, t.x, t.y] = grid
        west, north, pixel = facts[t.raster]
        step = 180 / 2**10
        ring = _plain_heights(hills[t.raster], west, north, pixel, 10, t.x, t.y, n, 1)
        g = step / (n - 1)
        want = terrain.vertex_normals((-180 + t.x * step - g, -90 + t.y * step - g, -180 + (t.x + 1) * step + g, -90 + (t.y + 1) * step + g), ring)[1:-1, 1:-1]
        assert np.abs(grid.reshape(-1, 2) - terrain.oct_bytes(want.reshape(-1, 3)).astype(int)).max() <= 1
    met = [(np.abs(g[:, -1] - found[r, x + 1, y][:, 0]).max()) for (r, x, y), g in found.items() if (r, x + 1, y) in found]
    assert len(met) > 5 and max(met) <= 1


def test_from_level_zero_the_whole_earth_has_tiles(spark):
    hills, _, rasters = _world(spark)
    tiles = pyramid.pyramid(_table(spark, {2: hills[2]}), rasters.where("raster = 2"), SIDE, 0, 6, 5).collect()
    assert sum(t.level <= 4 for t in tiles) == 2 * (4**5 - 1) // 3 and all(t.raster == 2 for t in tiles)
    made = spark.createDataFrame([tuple(t) for t in tiles], pyramid._TILE)
    row = pyramid.layers(made, rasters, 0, 6).collect()
    layer, meta = json.loads(row[0].layer), json.loads(row[0].meta)
    assert len(row) == 1 and len(layer["available"]) == 7 and layer["available"][2] == [{"startX": 0, "startY": y, "endX": 7, "endY": y} for y in range(4)]
    assert (layer["minzoom"], layer["maxzoom"], layer["extensions"], layer["valid_bounds"][0]) == (0, 6, [], -70.004)
    assert meta["minHeight"] == min(t.low for t in tiles) and meta["maxHeight"] == max(t.high for t in tiles)


def test_base_and_task_levels_are_united(spark):
    kind = "level int, ranges array<struct<startX:bigint,startY:bigint,endX:bigint,endY:bigint>>"
    base = spark.createDataFrame([(0, [(0, 0, 1, 0)]), (1, [(0, 0, 3, 1)]), (2, [])], kind)
    task = spark.createDataFrame([(1, [(0, 0, 3, 1), (1, 1, 1, 1)]), (4, [(5, 5, 6, 6)])], kind)
    found = {r.level: [tuple(x) for x in r.ranges] for r in pyramid.with_base(task, base).collect()}
    assert found == {0: [(0, 0, 1, 0)], 1: [(0, 0, 3, 1), (1, 1, 1, 1)], 2: [], 3: [], 4: [(5, 5, 6, 6)]}


def test_sizes_that_cannot_be_triangulated(spark):
    _, _, rasters = _world(spark)
    with pytest.raises(ValueError):
        pyramid.pyramid(_table(spark, {1: np.zeros((8, 8))}), rasters, SIDE, 5, 6, 10, "mesh")
    none = spark.createDataFrame([], "raster long, brow int, bcol int, data array<double>")
    assert all(t.low == t.high == 0 for t in pyramid.pyramid(none, rasters.where(F.col("raster") == 1), SIDE, 8, 8, 5).collect())
