"""Terrain meshes: right-triangulated irregular networks, quantized-mesh tiles, gzip, and their reader."""

from __future__ import annotations

import gzip
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespan.schemas import EARTH_RADIUS, ECCENTRICITY_2

#: Tiles that are encoded together.
_AT_ONCE = 64


def mesh_errors(heights: np.ndarray, pin_border: bool = True) -> np.ndarray:
    """For each vertex of a (2^k + 1) square grid, the largest height error of leaving it and all below it out.

    Scales rise from the finest. At scale s, sides of length 2 s are bisected at points with one coordinate an odd
    multiple of s; squares of side 2 s are bisected at their centres, across the diagonal that meets the centre of
    the square above. Either takes over the errors of the points that can only exist after it.
    """
    n = len(heights) - 1
    if n < 2 or n & (n - 1) or heights.shape != (n + 1, n + 1):
        raise ValueError("a mesh needs 2^k + 1 rows and columns")
    errors = np.zeros(heights.shape)
    s = 1
    while s < n:
        odd, even = np.arange(s, n, 2 * s), np.arange(0, n + 1, 2 * s)
        for rows, cols, dr, dc in ((even, odd, 0, s), (odd, even, s, 0)):
            at = np.ix_(rows, cols)
            own = np.abs(heights[at] - (heights[np.ix_(rows - dr, cols - dc)] + heights[np.ix_(rows + dr, cols + dc)]) / 2)
            if s > 1:
                h = s // 2
                padded = np.pad(errors, h)
                for a in (-h, h):
                    for b in (-h, h):
                        own = np.maximum(own, padded[np.ix_(rows + a + h, cols + b + h)])
            errors[at] = own
        at = np.ix_(odd, odd)
        if 2 * s == n:
            own = np.full((1, 1), abs(heights[s, s] - (heights[0, 0] + heights[n, n]) / 2))
        else:
            above = np.where(odd // (2 * s) % 2 == 1, odd - s, odd + s)  # the neighbour that is an odd multiple of 2 s
            own = np.abs(heights[at] - (heights[np.ix_(above, above)] + heights[np.ix_(2 * odd - above, 2 * odd - above)]) / 2)
        for a, b in ((-s, 0), (s, 0), (0, -s), (0, s)):
            own = np.maximum(own, errors[np.ix_(odd + a, odd + b)])
        errors[at] = own
        s *= 2
    if pin_border:
        errors[0, :] = errors[-1, :] = errors[:, 0] = errors[:, -1] = np.inf
        # What bisects on the way to a pinned vertex must be there too.
        return _raised(errors)
    return errors


def _raised(errors: np.ndarray) -> np.ndarray:
    n, s = len(errors) - 1, 1
    out = errors.copy()
    while s < n:
        odd, even = np.arange(s, n, 2 * s), np.arange(0, n + 1, 2 * s)
        if s > 1:
            h = s // 2
            for rows, cols in ((even, odd), (odd, even)):
                padded = np.pad(out, h)
                own = out[np.ix_(rows, cols)]
                for a in (-h, h):
                    for b in (-h, h):
                        own = np.maximum(own, padded[np.ix_(rows + a + h, cols + b + h)])
                out[np.ix_(rows, cols)] = own
        own = out[np.ix_(odd, odd)]
        for a, b in ((-s, 0), (s, 0), (0, -s), (0, s)):
            own = np.maximum(own, out[np.ix_(odd + a, odd + b)])
        out[np.ix_(odd, odd)] = own
        s *= 2
    return out


def mesh(errors: np.ndarray, max_error: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (row, col) in order of first use, and triangles of vertex numbers against the clock, all splits with a larger error done.

    Level by level: a triangle (a, b, c) with its right angle at c splits at the middle of ab.
    """
    n = len(errors) - 1
    todo = np.array([[[0, 0], [n, n], [n, 0]], [[n, n], [0, 0], [0, n]]])
    done = []
    while len(todo):
        a, b, c = todo[:, 0], todo[:, 1], todo[:, 2]
        middle = (a + b) // 2
        able = np.abs(a - c).sum(axis=1) > 1
        split = able & (errors[middle[:, 0], middle[:, 1]] > max_error)
        done.append(todo[~split])
        a, b, c, middle = a[split], b[split], c[split], middle[split]
        todo = np.concatenate([np.stack([c, a, middle], axis=1), np.stack([b, c, middle], axis=1)])
    corners = np.concatenate(done)[:, [0, 2, 1]].reshape(-1, 2)  # with row 0 in the north, (a, b, c) goes with the clock
    codes = corners[:, 0] * (n + 1) + corners[:, 1]
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    return corners[np.sort(first)], rank[inverse].reshape(-1, 3)


@lru_cache(maxsize=8)
def grid_mesh(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a full n x n grid."""
    rows, cols = np.divmod(np.arange(n * n), n)
    at = (np.arange(n - 1)[:, None] * n + np.arange(n - 1)[None, :]).ravel()
    triangles = np.stack([at, at + n, at + 1, at + 1, at + n, at + n + 1], axis=1).reshape(-1, 3)
    order = _first_use(triangles)
    return np.stack([rows, cols], axis=1)[order], np.argsort(order)[triangles]


def _first_use(triangles: np.ndarray) -> np.ndarray:
    used, first = np.unique(triangles.ravel(), return_index=True)
    return used[np.argsort(first)]


def _ecef(lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> np.ndarray:
    lam, phi = np.radians(lon), np.radians(lat)
    r = EARTH_RADIUS / np.sqrt(1 - ECCENTRICITY_2 * np.sin(phi) ** 2)
    return np.stack([(r + h) * np.cos(phi) * np.cos(lam), (r + h) * np.cos(phi) * np.sin(lam), (r * (1 - ECCENTRICITY_2) + h) * np.sin(phi)], axis=-1)


def _deltas(values: np.ndarray) -> bytes:
    d = np.diff(values.astype(np.int32), prepend=0)
    return ((d << 1) ^ (d >> 31)).astype("<u2").tobytes()


def vertex_normals(bounds: tuple[float, float, float, float], heights: np.ndarray) -> np.ndarray:
    """Unit normals (rows, cols, 3) of a grid, each the sum of its triangles' normals by their area; heights may be a tile's with a ring around."""
    west, south, east, north = bounds
    n = len(heights)
    lon, lat = np.meshgrid(np.linspace(west, east, n), np.linspace(north, south, n))
    at = _ecef(lon, lat, heights.astype(np.float64))
    down, across = at[1:] - at[:-1], at[:, 1:] - at[:, :-1]
    first = np.cross(down[:, :-1], across[:-1])  # of each cell, the triangle at its north-west corner
    second = np.cross(down[:, 1:], across[1:])  # and the one at its south-east corner
    out = np.zeros_like(at)
    for dr, dc, parts in ((0, 0, (first,)), (0, 1, (first, second)), (1, 0, (first, second)), (1, 1, (second,))):
        for part in parts:
            out[dr : n - 1 + dr, dc : n - 1 + dc] += part
    up = at / np.linalg.norm(at, axis=2, keepdims=True)
    out *= np.where((out * up).sum(axis=2, keepdims=True) < 0, -1.0, 1.0)
    size = np.linalg.norm(out, axis=2, keepdims=True)
    return np.where(size > 0, out / np.maximum(size, 1e-300), up)


def oct_bytes(normals: np.ndarray) -> np.ndarray:
    """Unit vectors as two bytes each on the octahedron, halves rounded up."""
    flat = normals / np.maximum(np.abs(normals).sum(axis=1, keepdims=True), 1e-300)
    folded = (1 - np.abs(flat[:, 1::-1])) * np.where(flat[:, :2] >= 0, 1.0, -1.0)
    on = np.where(flat[:, 2:] < 0, folded, flat[:, :2])
    return np.floor((np.clip(on, -1, 1) * 0.5 + 0.5) * 255 + 0.5).astype(np.uint8)


def encode(bounds: tuple[float, float, float, float], heights: np.ndarray, vertices: np.ndarray, triangles: np.ndarray, normals: np.ndarray | None = None) -> bytes:
    """A quantized-mesh 1.0 tile; bounds: west, south, east, north; row 0 of heights is the north; normals: of the grid, for the extension 1."""
    west, south, east, north = bounds
    n = len(heights) - 1
    h = heights[vertices[:, 0], vertices[:, 1]].astype(np.float64)
    u, v = vertices[:, 1] / n, 1 - vertices[:, 0] / n
    low, high = float(h.min()), float(h.max())
    at = _ecef(west + u * (east - west), south + v * (north - south), h)
    centre = (at.min(axis=0) + at.max(axis=0)) / 2
    radius = float(np.linalg.norm(at - centre, axis=1).max())
    # The horizon point: along the centre's direction, the least height from which every vertex is seen over the ellipsoid.
    axes = np.array([EARTH_RADIUS, EARTH_RADIUS, EARTH_RADIUS * math.sqrt(1 - ECCENTRICITY_2)])
    scaled, way = at / axes, centre / axes
    way = way / np.linalg.norm(way)
    size = np.maximum(1.0, np.linalg.norm(scaled, axis=1))
    cos_a = np.clip(scaled @ way / np.linalg.norm(scaled, axis=1), -1, 1)
    sin_a, cos_b = np.sqrt(1 - cos_a**2), 1 / size
    sin_b = np.sqrt(np.maximum(0, size**2 - 1)) * cos_b
    horizon = way * float((1 / np.maximum(1e-9, cos_a * cos_b - sin_a * sin_b)).max())
    unit = lambda x: np.floor(x * 32767 + 0.5).astype(np.int32)
    qu, qv, qh = unit(u), unit(v), unit((h - low) / (high - low) if high > low else np.zeros(len(h)))
    out = struct.pack("<ddd ff ddd d ddd".replace(" ", ""), *centre, low, high, *centre, radius, *horizon) + struct.pack("<I", len(h)) + _deltas(qu) + _deltas(qv) + _deltas(qh)
    wide = "<u4" if len(h) > 65536 else "<u2"
    size_of = int(wide[-1])
    out += b"\0" * (-len(out) % size_of)
    flat = triangles.ravel()
    before = np.maximum.accumulate(np.r_[-1, flat])[:-1] + 1
    out += struct.pack("<I", len(triangles)) + (before - flat).astype(wide).tobytes()
    for edge in (qu == 0, qv == 0, qu == 32767, qv == 32767):
        found = np.flatnonzero(edge)
        out += struct.pack("<I", len(found)) + found.astype(wide).tobytes()
    if normals is not None:
        made = oct_bytes(normals[vertices[:, 0], vertices[:, 1]]).tobytes()
        out += struct.pack("<BI", 1, len(made)) + made
    return out


@lru_cache(maxsize=8)
def _fixed(n: int) -> tuple[np.ndarray, np.ndarray, bytes, bytes]:
    """Rows and columns of the vertices in file order, and the bytes before and after the heights."""
    vertices, triangles = grid_mesh(n)
    flat = encode((0.0, 0.0, 1.0, 1.0), np.zeros((n, n)), vertices, triangles)
    at = 92 + 2 * 2 * n * n
    return vertices[:, 0], vertices[:, 1], flat[88:at], flat[at + 2 * n * n :]


def encode_grids(bounds: np.ndarray, heights: np.ndarray) -> list[bytes]:
    """encode() of many full grids: bounds (tiles, 4: west, south, east, north), heights (tiles, n, n) with the north first."""
    n = heights.shape[1]
    rows, cols, before, after = _fixed(n)
    west, south, east, north = (bounds[:, i, None] for i in range(4))
    share = np.arange(n) / (n - 1)
    lon, lat = np.radians(west + share * (east - west)), np.radians(south + (1 - share) * (north - south))
    h = heights.astype(np.float64)
    radius = EARTH_RADIUS / np.sqrt(1 - ECCENTRICITY_2 * np.sin(lat) ** 2)
    count = len(h)
    level = ((radius[:, :, None] + h) * np.cos(lat)[:, :, None]).reshape(count, n, n)
    at = [(level * np.cos(lon)[:, None, :]).reshape(count, -1), (level * np.sin(lon)[:, None, :]).reshape(count, -1), ((radius * (1 - ECCENTRICITY_2) * np.sin(lat))[:, :, None] + h * np.sin(lat)[:, :, None]).reshape(count, -1)]
    centre = np.stack([(v.min(axis=1) + v.max(axis=1)) / 2 for v in at], axis=1)
    reach = np.sqrt(sum((v - centre[:, i, None]) ** 2 for i, v in enumerate(at)).max(axis=1))
    axes = (EARTH_RADIUS, EARTH_RADIUS, EARTH_RADIUS * math.sqrt(1 - ECCENTRICITY_2))
    way = centre / axes
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    square = sum((v / r) ** 2 for v, r in zip(at, axes, strict=True))
    along = sum(v * (way[:, i, None] / r) for i, (v, r) in enumerate(zip(at, axes, strict=True)))
    cos_a = np.clip(along / np.sqrt(square), -1, 1)
    square = np.maximum(1.0, square)
    # cos a cos b - sin a sin b, with cos b = 1 / size.
    seen = (cos_a - np.sqrt((1 - cos_a * cos_a) * (square - 1))) / np.sqrt(square)
    horizon = way / np.maximum(1e-9, seen.min(axis=1))[:, None]
    low, high = h.min(axis=(1, 2)), h.max(axis=(1, 2))
    spread = np.where(high > low, high - low, 1.0)
    q = np.floor((h[:, rows, cols] - low[:, None]) / spread[:, None] * 32767 + 0.5).astype(np.int32)
    d = np.diff(q, axis=1, prepend=0)
    coded = ((d << 1) ^ (d >> 31)).astype("<u2")
    return [struct.pack("<dddffddddddd", *centre[t], low[t], high[t], *centre[t], reach[t], *horizon[t]) + before + coded[t].tobytes() + after for t in range(len(h))]


def decode(data: bytes) -> dict:
    """The header, vertices (u, v and height fractions of 32767), triangles and edges of a tile."""
    head = struct.unpack_from("<dddffddddddd", data)
    n = struct.unpack_from("<I", data, 88)[0]
    at, columns = 92, []
    for _ in range(3):
        z = np.frombuffer(data, "<u2", n, at).astype(np.int32)
        columns.append(np.cumsum((z >> 1) ^ -(z & 1)))
        at += 2 * n
    wide = "<u4" if n > 65536 else "<u2"
    at += -at % int(wide[-1])
    count = struct.unpack_from("<I", data, at)[0]
    codes = np.frombuffer(data, wide, 3 * count, at + 4).astype(np.int64)
    at += 4 + 3 * count * int(wide[-1])
    indices = np.cumsum(codes == 0) - (codes == 0) - codes  # from the next unused number back
    edges = []
    for _ in range(4):
        k = struct.unpack_from("<I", data, at)[0]
        edges.append(np.frombuffer(data, wide, k, at + 4))
        at += 4 + k * int(wide[-1])
    return {"centre": head[:3], "low": head[3], "high": head[4], "u": columns[0], "v": columns[1], "h": columns[2], "triangles": indices.reshape(-1, 3), "edges": edges, "rest": len(data) - at}


def smaller(one: bytes, other: bytes) -> bytes:
    """The smaller of two tiles; of equal ones, the first."""
    return one if len(one) <= len(other) else other


def encode_tiles(blocks: DataFrame, max_error: float | None = None, normals: bool = False) -> DataFrame:
    """Blocks (level, x, y, heights: array<double> by rows from the north, of a square) to gzipped tiles.

    level, x, y, tile, low, high, vertices, triangles; x and y count geographic tiles from the west and the south.
    max_error: a triangulation of that error where a block has 2^k + 1 rows; else the full grid. Null heights are 0.
    A block is one row, so tiles are made where their rows lie, without a shuffle.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            levels, xs, ys = (batch.column(c).to_pylist() for c in ("level", "x", "y"))
            every = batch.column("heights")
            for start in range(0, batch.num_rows, _AT_ONCE):
                grids = [np.nan_to_num(cells.values.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(math.isqrt(len(cells)), -1) for cells in every[start : start + _AT_ONCE]]
                steps = [180.0 / (1 << z) for z in levels[start : start + _AT_ONCE]]
                bounds = np.array([(-180 + x * t, -90 + y * t, -180 + (x + 1) * t, -90 + (y + 1) * t) for x, y, t in zip(xs[start:], ys[start:], steps, strict=False)])
                same = max_error is None and not normals and len({len(g) for g in grids}) == 1
                plain = encode_grids(bounds, np.stack(grids)) if same else [None] * len(grids)
                for box, heights, data in zip(bounds, grids, plain, strict=True):
                    n, k = len(heights), len(heights) - 1
                    vertices, triangles = mesh(mesh_errors(heights), max_error) if max_error is not None and k > 1 and not k & (k - 1) else grid_mesh(n)
                    data = data or encode(tuple(box), heights, vertices, triangles, vertex_normals(tuple(box), heights) if normals else None)
                    made.append((gzip.compress(data, 6, mtime=0), float(heights.min()), float(heights.max()), len(vertices), len(triangles)))
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            kinds = [pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            arrays = [pa.array(levels, pa.int32()), pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["level", "x", "y", "tile", "low", "high", "vertices", "triangles"])

    return blocks.select("level", "x", "y", "heights").mapInArrow(make, "level int, x long, y long, tile binary, low double, high double, vertices long, triangles long")


def layer_availability(tiles: DataFrame) -> DataFrame:
    """level, ranges: a layer document's availability, as disjoint runs of tiles in a row, one list a level."""
    w = Window.partitionBy("level", "y").orderBy("x")
    runs = tiles.select("level", "x", "y").distinct().withColumn("g", F.col("x") - F.row_number().over(w))
    spans = runs.groupBy("level", "y", "g").agg(F.min("x").alias("startX"), F.max("x").alias("endX"))
    boxes = spans.select("level", "startX", F.col("y").alias("startY"), "endX", F.col("y").alias("endY"))
    return boxes.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("startX", "startY", "endX", "endY"))).alias("ranges"))
