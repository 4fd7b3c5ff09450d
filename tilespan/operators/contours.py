"""Contour lines on tables of raster blocks: marching squares by block, lines joined across blocks.

A cell lies between four pixel centres and belongs to the block of its upper left one; the centres right of and below a
block come as strips of its neighbours. Levels are multiples of the interval, so lines meet at the blocks' borders. Cells
with a corner without data have no lines. In a cell with two opposite corners above, the mean of all four says which
corners hang together. A height equal to a level is below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespan.operators import blocks as B
from tilespan.tables import written

#: Fixed value: more levels than this in a block are not drawn.
MOST_LEVELS = 200
#: Heights that are gone through at once, a block counted for each of its levels.
STACKED = 1 << 18
#: Points of lines that are held before they are sent on; they are Python numbers until then.
SENT = 1 << 16
_FIELDS = "level double, is_index boolean, closed boolean, head long, tail long, xs array<double>, ys array<double>, nodes array<long>"


def _levels(low: float, high: float, interval: float, most: int) -> np.ndarray:
    """Multiples of the interval that cover [low, high]; none for flat ground or more than most."""
    if not np.isfinite(low) or high - low < 1e-6:
        return np.zeros(0)
    first = np.floor(low / interval)
    n = int(np.ceil(high / interval) - first) + 1
    return (first + np.arange(n)) * interval if n <= most else np.zeros(0)


def _segments(z: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stacked heights (n, rows + 1, cols + 1) with a level each: the number in the stack, rising, and pairs of crossed sides of its cells.

    A pair is (kind, row, col, kind, row, col); kind 0 goes right from a corner, 1 goes down.
    """
    corners = lambda a: (a[:, :-1, :-1], a[:, :-1, 1:], a[:, 1:, :-1], a[:, 1:, 1:])
    tl, tr, bl, br = corners(z > levels[:, None, None])
    known = corners(~np.isnan(z))
    full = known[0] & known[1] & known[2] & known[3]
    k, r, c = np.nonzero(full & ((tl != tr) | (tl != bl) | (tl != br)))
    case = tl[k, r, c] + 2 * tr[k, r, c] + 4 * br[k, r, c] + 8 * bl[k, r, c]
    middle = (z[k, r, c] + z[k, r, c + 1] + z[k, r + 1, c] + z[k, r + 1, c + 1]) / 4 > levels[k]
    # The sides: top, right, bottom, left.
    sides = [np.stack(x, axis=1) for x in ((0 * r, r, c), (0 * r + 1, r, c + 1), (0 * r, r + 1, c), (0 * r + 1, r, c))]
    saddle = (case == 5) | (case == 10)
    turned = saddle & ((case == 5) == middle)  # top right and bottom left corners are cut off
    pick = lambda yes, a, b: np.hstack([sides[a][yes], sides[b][yes]])
    one = lambda *cases: np.isin(case, cases)
    cut = {(3, 0): one(1, 14) | (saddle & ~turned), (0, 1): one(2, 13) | turned, (1, 2): one(4, 11) | (saddle & ~turned), (2, 3): one(7, 8) | turned, (3, 1): one(3, 12), (0, 2): one(6, 9)}
    of, pairs = np.concatenate([k[yes] for yes in cut.values()]), np.concatenate([pick(yes, a, b) for (a, b), yes in cut.items()])
    order = np.argsort(of, kind="stable")
    return of[order], pairs[order]


def _joined(pairs: np.ndarray) -> list[tuple[list[int], bool]]:
    """Lines through segments (rows of two node numbers): their nodes in order, and whether they are closed."""
    near: dict[int, list[int]] = {}
    for a, b in pairs.tolist():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, seen = [], set()
    for start in [*(n for n, v in near.items() if len(v) == 1), *near]:
        if start in seen:
            continue
        line, at = [start], start
        seen.add(start)
        while at is not None:
            at = next((n for n in near[at] if n not in seen), None)
            if at is not None:
                seen.add(at)
                line.append(at)
        out.append((line, len(near[start]) == 2))
    return out


def contours(blocks: DataFrame, side: int, interval: float, index_step: int = 5, most: int = MOST_LEVELS) -> DataFrame:
    """KEYS, level, is_index (every index_step-th multiple), closed, xs and ys (pixels; centres lie at halves) of each block's lines.

    nodes number the sides between pixel centres that a line crosses, alike in the block across the border; head and tail are
    the two ends of an open line. Where a height lies on a level or very near it, several nodes are at one place.
    """
    names = [*B.KEYS, *(f.split()[0] for f in _FIELDS.split(", "))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]

    def lines(keys: list[tuple[int, int, int]], z: np.ndarray) -> Iterator[tuple]:
        wanted = []
        for i, block in enumerate(z):
            known = block[~np.isnan(block)]
            wanted += [(i, level) for level in (_levels(known.min(), known.max(), interval, most) if len(known) else ())]
        step = max(1, STACKED // z[0].size)
        for start in range(0, len(wanted), step):
            some = wanted[start : start + step]
            at, levels = np.array([i for i, _ in some]), np.array([level for _, level in some])
            of, found = _segments(z[at], levels)
            kind, r, c = np.concatenate([found[:, :3], found[:, 3:]]).T
            k = at[np.concatenate([of, of])]
            top, left = np.array([(brow * side, bcol * side) for _, brow, bcol in keys], dtype=np.int64)[k].T
            ids = ((r + top) << 32) | ((c + left) << 1) | kind
            a, b = z[k, r, c], z[k, r + kind, c + 1 - kind]
            t = (levels[np.concatenate([of, of])] - a) / (b - a)
            x, y = c + left + 0.5 + np.where(kind == 0, t, 0), r + top + 0.5 + np.where(kind == 1, t, 0)
            ids, x, y = (v.reshape(2, -1) for v in (ids, x, y))
            cuts = np.searchsorted(of, np.arange(len(some) + 1)).tolist()
            for (i, level), begin, end in zip(some, cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                mine = slice(begin, end)
                place = dict(zip(ids[:, mine].ravel().tolist(), zip(x[:, mine].ravel().tolist(), y[:, mine].ravel().tolist(), strict=True), strict=True))
                ratio = level / (interval * index_step)
                for line, closed in _joined(ids[:, mine].T):
                    nodes = line + line[:1] if closed else line
                    path = [place[n] for n in nodes]
                    yield *keys[i], float(level), bool(abs(ratio - round(ratio)) < 1e-6), closed, line[0], line[-1], [p[0] for p in path], [p[1] for p in path], nodes

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, STACKED // (side + 2) ** 2)
        for batch in batches:
            for start in range(0, batch.num_rows, some):
                part = batch.slice(start, some)
                rows, held = [], 0
                for row in lines(list(zip(*(part.column(k).to_pylist() for k in B.KEYS), strict=True)), B.ringed(part, side)[:, 1:, 1:]):
                    rows.append(row)
                    held += len(row[-1])
                    if held >= SENT:
                        yield sent(rows)
                        rows, held = [], 0
                if rows:
                    yield sent(rows)

    return B.with_neighbours(blocks, side).mapInArrow(run, f"raster long, brow int, bcol int, {_FIELDS}")


def length(xs: Column, ys: Column) -> Column:
    """Of a path, in pixels."""
    step = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda p, q: (q - p) * (q - p))
    return F.aggregate(F.zip_with(step(xs), step(ys), lambda p, q: F.sqrt(p + q)), F.lit(0.0), lambda s, v: s + v)


def lines(pieces: DataFrame) -> DataFrame:
    """raster, level, line, is_index, closed, pieces, points, length: contours of blocks joined over all blocks.

    Leaving a piece at an end leads to the piece that shares the end, and out of that one at its other end. Each round
    doubles the step and keeps the least piece seen, until nothing changes: the rounds grow with the logarithm of the
    pieces of a line.
    """
    size = F.size("xs") - F.col("closed").cast("int")
    found = written(pieces.select("raster", "level", "is_index", "closed", "head", "tail", size.alias("points"), length(F.col("xs"), F.col("ys")).alias("length"), F.monotonically_increasing_id().alias("piece")), "pieces")
    ends = found.where(~F.col("closed")).select("raster", "level", "piece", F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("head").alias("node")), F.struct(F.lit(1).alias("end"), F.col("tail").alias("node")))))
    # A node belongs to two pieces at most: the other one is what is left of both ends' sums.
    state = F.col("piece") * 2 + F.col("end")
    pair = ends.groupBy("raster", "level", "node").agg(F.min(state).alias("a"), F.max(state).alias("b")).where("a <> b")
    # A state is a piece and the end it is left by; across the node the next piece is left by its other end.
    step = F.inline(F.array(F.struct(F.col("a").alias("state"), F.col("b").bitwiseXOR(F.lit(1).cast("long")).alias("jump")), F.struct(F.col("b").alias("state"), F.col("a").bitwiseXOR(F.lit(1).cast("long")).alias("jump"))))
    linked = pair.select(step)
    every = ends.select(state.alias("state"), F.col("piece").alias("least")).join(linked, "state", "left")
    now = written(every, "lines")
    while True:
        further = now.select(F.col("state").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("far"))
        after = now.join(further, "jump", "left").select("state", F.col("next").alias("jump"), F.least("least", F.coalesce("far", "least")).alias("least"), F.coalesce(F.col("far") < F.col("least"), F.lit(False)).alias("changed"))
        after = written(after, "lines")
        if after.where("changed").isEmpty():  # what still jumps goes round, and has the least of its ring
            break
        now = after.drop("changed")
    owner = after.groupBy(F.floor(F.col("state") / 2).alias("piece")).agg(F.min("least").alias("line"))
    loose = ends.groupBy("raster", "level", "node").agg(F.count("*").alias("n"), F.min("piece").alias("piece")).where("n = 1").select("piece").distinct().withColumn("loose", F.lit(True))
    rows = found.join(owner, "piece", "left").join(loose, "piece", "left").withColumn("line", F.coalesce("line", "piece"))
    out = rows.groupBy("raster", "level", "line").agg(F.first("is_index").alias("is_index"), F.max(F.coalesce("loose", F.lit(False))).alias("open"), F.count("*").alias("pieces"), F.sum("points").alias("points"), F.sum("length").alias("length"), F.max("closed").alias("whole"))
    # Two pieces share each node between them.
    shared = F.when(F.col("whole"), 0).when(F.col("open"), F.col("pieces") - 1).otherwise(F.col("pieces"))
    return out.select("raster", "level", "line", "is_index", (~F.col("open")).alias("closed"), "pieces", (F.col("points") - shared).alias("points"), "length")

