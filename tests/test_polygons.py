import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_geo import RING_TYPE, SHAPES, inside, rings
from tilespan.operators import polygons


def _frame(spark, shapes):
    return spark.createDataFrame([(k, rings(*p)) for k, p in shapes.items()], RING_TYPE)


def _crosses(a, b):
    side = lambda e, p: (e[1][0] - e[0][0]) * (p[1] - e[0][1]) - (e[1][1] - e[0][1]) * (p[0] - e[0][0])
    apart = lambda p, q: (p > 1e-12 and q < -1e-12) or (p < -1e-12 and q > 1e-12)
    return apart(side(b, a[0]), side(b, a[1])) and apart(side(a, b[0]), side(a, b[1]))


def _meets(parts, north, south, east, west):
    w, e, s, n = west + 1e-9, east - 1e-9, south + 1e-9, north - 1e-9
    if any(inside(p, parts) for p in ((w, s), (e, s), (e, n), (w, n), ((w + e) / 2, (s + n) / 2))):
        return True
    sides = [((w, s), (e, s)), ((e, s), (e, n)), ((e, n), (w, n)), ((w, n), (w, s))]
    for p in parts:
        for a, b in zip(p, [*p[1:], p[0]], strict=True):
            if (w < a[0] < e and s < a[1] < n) or any(_crosses((a, b), q) for q in sides):
                return True
    return False


def _random_shapes(seed, n):
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(n):
        cx, cy, turns = rng.uniform(-170, 185), rng.uniform(-60, 60), np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 12)))
        size = rng.uniform(0.3, 9, len(turns))
        out[k] = [[(float(cx + r * math.cos(t)), float(cy + r * math.sin(t))) for t, r in zip(turns, size, strict=True)]]
        if k % 3 == 0:
            out[k].append([(cx - 1, cy - 1), (cx + 1, cy - 1), (cx + 1, cy + 1), (cx - 1, cy + 1)])
    return out


L_SHAPE = [[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]]
DRAWN = {**SHAPES, 10: L_SHAPE, 11: [[(179, 0), (181, 0), (181, 3), (179, 3)]], 12: [[(0.2, 0.2), (0.4, 0.2), (0.4, 0.4)]], 13: [[(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 1), (1, 2), (2, 2), (2, 1)]]}


@pytest.mark.parametrize("shapes", [DRAWN, _random_shapes(1, 30)])
def test_granules_are_the_cells_that_share_area(spark, shapes):
    want = set()
    for k, parts in shapes.items():
        xs, ys = [x for p in parts for x, _ in p], [y for p in parts for _, y in p]
        for lat in range(math.floor(min(ys)), math.ceil(max(ys)) + 1):
            for x in range(math.floor(min(xs)), math.ceil(max(xs)) + 1):
                if _meets(parts, lat + 1, lat, x + 1, x):
                    want.add((k, lat, x - 360 if x >= 180 else x))
    assert {tuple(r) for r in polygons.granules_in(_frame(spark, shapes), "key").collect()} == want


def test_an_l_shape_loses_its_corner_and_a_hole_its_cell(spark):
    found = {(r.key, r.lat, r.lon) for r in polygons.granules_in(_frame(spark, {k: DRAWN[k] for k in (10, 11, 13)}), "key").collect()}
    assert {x[1:] for x in found if x[0] == 10} == {(0, 0), (0, 1), (1, 0)}
    assert {x[2] for x in found if x[0] == 11} == {179, -180}
    assert (13, 1, 1) not in found and len([x for x in found if x[0] == 13]) == 8


def test_box_predicate(spark):
    rng = np.random.default_rng(3)
    boxes = [(float(n), float(n - h), float(e), float(e - w)) for n, e, h, w in zip(rng.uniform(-3, 34, 80), rng.uniform(-3, 44, 80), rng.uniform(0.01, 12, 80), rng.uniform(0.01, 12, 80), strict=True)]
    boxes += [(10, 10, 20, 10), (20.0, 10.0, 30.0, 10.0), (50.0, -10.0, 60.0, -10.0), (30.0, 20.0, 50.0, 40.0), (5.0, 0.0, 0.0, -5.0)]
    table = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "n double, s double, e double, w double").crossJoin(_frame(spark, SHAPES).where("key < 3"))
    for r in table.withColumn("met", polygons.meets_box(F.col("rings"), F.col("n"), F.col("s"), F.col("e"), F.col("w"))).collect():
        assert r.met == (r.n > r.s and _meets(SHAPES[r.key], r.n, r.s, r.e, r.w)), r
    turned = spark.range(1).select(polygons.meets_box(F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [*p, p[0]])) for p in L_SHAPE)), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("m"))
    assert turned.first().m


def test_cells_tell_inner_ones_from_edges(spark):
    for k, parts in {**SHAPES, **_random_shapes(5, 4)}.items():
        found = polygons.cells(_frame(spark, {k: parts}), "key", 2.0).collect()
        assert len(found) == len({(r.band, r.col) for r in found})
        held = {(r.band, r.col): r.edge for r in found}
        for (band, col), edge in held.items():
            probes = [inside((col * 2 - 180 + dx, band * 2 - 90 + dy), parts) for dx in (0.01, 1, 1.99) for dy in (0.01, 1, 1.99)]
            assert edge or all(probes)
        rng = np.random.default_rng(7)
        for x, y in zip(rng.uniform(-180, 210, 2000), rng.uniform(-60, 60, 2000), strict=True):
            assert not inside((x, y), parts) or (math.floor((y + 90) / 2), math.floor((x + 180) / 2)) in held


RINGS = {
    "bow tie": ([(0, 0), (10, 10), (10, 0), (0, 10)], True),
    "square": ([(0, 0), (10, 0), (10, 10), (0, 10)], False),
    "touching": ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], False),
    "line": ([(0, 0), (1, 1), (2, 2), (3, 3)], False),
    "star": ([(0, 10), (6, -8), (-9.5, 3), (9.5, 3), (-6, -8)], True),
    "late": ([(0, 0), (10, 0), (10, 10), (5, 10), (5, -1), (0, 5)], True),
}


def test_rings_that_cross_themselves(spark):
    shapes = {i: [[(100, 0), (101, 0), (101, 1)], ring] for i, (ring, _) in enumerate(RINGS.values())}
    found = {(r.key, r.ring) for r in polygons.self_crossings(_frame(spark, shapes), "key").collect()}
    assert found == {(i, 1) for i, (_, bad) in enumerate(RINGS.values()) if bad}


def test_random_rings_cross_as_all_pairs_say(spark):
    rng = np.random.default_rng(11)
    shapes = {k: [[tuple(map(float, p)) for p in (rng.uniform(0, 9, (rng.integers(4, 9), 2)) if k % 2 else np.cumsum(rng.normal(0, 1, (30, 2)), axis=0))]] for k in range(60)}
    want = set()
    for k, (ring,) in shapes.items():
        edges = list(zip(ring, [*ring[1:], ring[0]], strict=True))
        if any(_crosses(edges[i], edges[j]) for i in range(len(edges)) for j in range(i + 2, len(edges)) if not (i == 0 and j == len(edges) - 1)):
            want.add(k)
    assert {r.key for r in polygons.self_crossings(_frame(spark, shapes), "key").collect()} == want and 0 < len(want) < 60


def test_long_rings_are_left_out_unless_asked(spark):
    turns = np.linspace(0, 2 * np.pi, 2500, endpoint=False)
    ring = [(float(math.cos(t) * 9), float(math.sin(t) * 9)) for t in turns]
    ring[100], ring[102] = ring[102], ring[100]
    frame = _frame(spark, {1: [ring]})
    assert polygons.self_crossings(frame, "key").collect() == []
    assert len(polygons.self_crossings(frame, "key", None).collect()) == 1


def test_spans_touch_what_a_fine_grid_finds(spark):
    frame = _frame(spark, SHAPES)
    found = polygons.polygon_spans(frame, "key", 3, 6).collect()
    for k, parts in SHAPES.items():
        for zoom in (3, 6):
            n = 1 << zoom
            spans = sorted((r.y, r.x0, r.x1) for r in found if (r.key, r.zoom) == (k, zoom))
            assert all(a[0] < b[0] or a[2] + 1 < b[1] for a, b in zip(spans, spans[1:], strict=False))
            got = {(y, x) for y, x0, x1 in spans for x in range(x0, x1 + 1)}
            steps = np.linspace(0, 1, 12)[1:-1]
            sure = set()
            for y in range(n):
                lats = [math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + s) / n)))) for s in steps]
                for x in range(n + n // 4):
                    lons = [(x + s) / n * 360 - 180 for s in steps]
                    if any(inside((lon, lat), parts) for lon in lons for lat in lats):
                        sure.add((y, x % n))
            assert sure <= got, (k, zoom)
            assert len(got) <= len(sure) + 4 * n  # beyond it, only tiles that the outline touches


def test_wrapped_spans_are_disjoint(spark):
    found = polygons.polygon_spans(_frame(spark, {1: [[(150, -80), (540, -80), (540, 80), (150, 80)]]}), "key", 3, 3).collect()
    assert all((r.x0, r.x1) == (0, 7) for r in found) and len({r.y for r in found}) == len(found)


def test_no_polygons_and_short_rings(spark):
    frame = spark.createDataFrame([(1, []), (2, [[]]), (3, [[{"lon": 1.0, "lat": 1.0}]]), (4, None)], RING_TYPE)
    for f in (lambda: polygons.granules_in(frame, "key"), lambda: polygons.self_crossings(frame, "key"), lambda: polygons.polygon_spans(frame, "key", 0, 3)):
        assert f().collect() == []
