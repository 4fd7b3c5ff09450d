import math
import random

import numpy as np
from pyspark.sql import functions as F

from tilespan.llm import hilbert_ann


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, v)
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), i) for i, w in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, ids string, score double")
    got = {}
    for r in hilbert_ann.search(table, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hilbert_ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_edge_rows_exactly(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    same = [1.0] * 16
    rows += [(1000 + i, same) for i in range(100)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [math.inf] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0]), (2020, []), (None, same), (0, rows[0][1]), (40, rows[40][1])]
    got, want = run(spark, rows, near=16), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)
    assert run(spark, rows[:5]).keys() == {0} and len(run(spark, rows[:5])[0]) == 4
    assert run(spark, []) == {}


def test_recall(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = run(spark, rows), brute(rows, 20)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)
