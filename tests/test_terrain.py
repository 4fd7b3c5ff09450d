import gzip

import numpy as np
import pytest

from tilespan.operators import terrain


def triangle_error(heights, vertices, triangles):
    """The largest vertical distance of the grid from the mesh, by brute force; and the area covered."""
    worst, area = 0.0, 0.0
    n = len(heights)
    rr, cc = np.mgrid[0:n, 0:n]
    for t in triangles:
        (r0, c0), (r1, c1), (r2, c2) = vertices[t].tolist()
        d = (c1 - c0) * (r2 - r0) - (c2 - c0) * (r1 - r0)
        area += abs(d) / 2
        a = ((cc - c0) * (r2 - r0) - (c2 - c0) * (rr - r0)) / d
        b = ((c1 - c0) * (rr - r0) - (cc - c0) * (r1 - r0)) / d
        inside = (a >= -1e-9) & (b >= -1e-9) & (a + b <= 1 + 1e-9)
        h = heights[r0, c0] + a * (heights[r1, c1] - heights[r0, c0]) + b * (heights[r2, c2] - heights[r0, c0])
        worst = max(worst, np.abs(h - heights)[inside].max())
    return worst, area


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_mesh(k):
    n = 2**k
    heights = np.random.default_rng(k).normal(size=(n + 1, n + 1)) * 10
    errors = terrain.mesh_errors(heights, pin_border=False)
    vertices, triangles = terrain.mesh(errors, 0.0)
    assert len(triangles) == 2 * n * n and len(vertices) == (n + 1) ** 2
    for limit in (3.0, 8.0, 1e9):
        vertices, triangles = terrain.mesh(errors, limit)
        worst, area = triangle_error(heights, vertices, triangles)
        (r0, c0), (r1, c1), (r2, c2) = (vertices[triangles[:, k]].T for k in range(3))
        assert ((c1 - c0) * (r0 - r2) - (c2 - c0) * (r0 - r1) > 0).all()  # against the clock, seen with the north up
        assert area == n * n
        edges = np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]]), axis=1)
        _, uses = np.unique(edges, axis=0, return_counts=True)
        assert uses.max() <= 2  # no cracks: an inner edge has two triangles
        inner = [e for e, u in zip(np.unique(edges, axis=0), uses, strict=True) if u == 1]
        assert all((vertices[e] == 0).all(axis=0).any() or (vertices[e] == n).all(axis=0).any() for e in inner)
        assert np.array_equal(np.sort(np.unique(triangles.ravel(), return_index=True)[1]), np.unique(triangles.ravel(), return_index=True)[1])
    pinned, _ = terrain.mesh(terrain.mesh_errors(heights), 1e9)
    assert {(0, c) for c in range(n + 1)} | {(r, n) for r in range(n + 1)} <= {tuple(x) for x in pinned.tolist()}


def test_flat_is_two_triangles():
    vertices, triangles = terrain.mesh(terrain.mesh_errors(np.zeros((17, 17)), pin_border=False), 0.0)
    assert len(triangles) == 2 and len(vertices) == 4


@pytest.mark.parametrize("n", [2, 9, 300])
def test_encode(n):
    heights = np.random.default_rng(n).normal(size=(n, n)) * 100
    vertices, triangles = terrain.grid_mesh(n)
    out = terrain.decode(terrain.encode((10.0, 20.0, 11.0, 21.0), heights, vertices, triangles))
    assert np.array_equal(out["triangles"], triangles) and out["rest"] == 0
    assert np.array_equal(out["u"], np.floor(vertices[:, 1] / (n - 1) * 32767 + 0.5))
    low, high = np.float32(heights.min()), np.float32(heights.max())
    assert (out["low"], out["high"]) == (low, high)
    got = heights.min() + out["h"] / 32767 * (heights.max() - heights.min())
    assert np.abs(got - heights[vertices[:, 0], vertices[:, 1]]).max() <= (heights.max() - heights.min()) / 32767
    assert [len(e) for e in out["edges"]] == [n] * 4


def test_tiles(spark):
    rows = [(10, k, 3, [float(k * r + c % 3) if c != r else None for r in range(9) for c in range(9)]) for k in range(3)]
    blocks = spark.createDataFrame(rows, "level int, x long, y long, heights array<double>")
    for limit in (None, 0.5):
        for t in terrain.encode_tiles(blocks, limit, normals=True).collect():
            out = terrain.decode(gzip.decompress(t.tile))
            assert len(out["u"]) == t.vertices and len(out["triangles"]) == t.triangles <= 128
            assert out["rest"] == 5 + 2 * t.vertices  # the normals
            (x, y) = np.array([out["u"], out["v"]])[:, out["triangles"]]
            assert ((x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0]) > 0).all()


def test_normals_point_up_and_lean():
    bounds = (10.0, 40.0, 10.01, 40.01)
    flat = terrain.vertex_normals(bounds, np.zeros((9, 9)))
    up = np.array([np.cos(np.radians(40)) * np.cos(np.radians(10)), np.cos(np.radians(40)) * np.sin(np.radians(10)), np.sin(np.radians(40))])
    assert (flat @ up > 0.9999).all() and np.allclose(np.linalg.norm(flat, axis=2), 1)
    east = np.array([-np.sin(np.radians(10)), np.cos(np.radians(10)), 0])
    rising = terrain.vertex_normals(bounds, np.tile(np.linspace(0, 400, 9), (9, 1)))  # towards the east
    assert (rising @ east < -0.1).all()


def test_layer_availability(spark):
    tiles = spark.createDataFrame([(3, x, y) for y, xs in ((1, (0, 1, 2, 5)), (2, (7,))) for x in xs] + [(3, 1, 1), (4, 9, 9)], "level int, x long, y long")
    found = {r.level: [tuple(b) for b in r.ranges] for r in terrain.layer_availability(tiles).collect()}
    assert found == {3: [(0, 1, 2, 1), (5, 1, 5, 1), (7, 2, 7, 2)], 4: [(9, 9, 9, 9)]}
    assert terrain.smaller(b"aa", b"bb") == b"aa" and terrain.smaller(b"aaa", b"b") == b"b"
