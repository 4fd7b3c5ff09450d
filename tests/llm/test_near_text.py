import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tilespan.llm import near_text
from tilespan.llm.common import REMOVE_SHUFFLES, written


def plain(rows, width=5, similarity=0.8):
    sets = [set(near_text.shingles((t or "").encode(), width).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = up(i), up(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[up(i)] = min(least.get(up(i), d), d)
    return sorted(repr((d, least.get(up(i)))) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(25):
        base = rng.choices(words, k=rng.randint(3, 400))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    base = rng.choices(words, k=120)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = [*enumerate(rows)]
    return [*rows, (900, None), (901, ""), (902, "\n"), (903, "a b"), (904, "A  B"), (905, "x y " * 40000), (None, "only this one has no id at all"), (0, rows[0][1])]


def test_components(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, node string")
    want = plain(rows)
    assert sorted(repr(tuple(r)) for r in near_text.components(docs).collect()) == want
    kept = near_text.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, c in map(eval, want) if d == c}
    assert near_text.components(docs.limit(0)).count() == 0


def test_verified_in_chunks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    zero = np.zeros(40, dtype=np.uint64)
    u, v = near_text.verified(np.arange(40), zero, sets, 0.5)
    want = plain([(i, " ".join(f"{x}" for x in s)) for i, s in enumerate(sets)], 1, 0.5)
    root = list(range(40))
    for a, b in zip(u, v, strict=True):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert sorted(repr((i, r)) for i, r in enumerate(root)) == want


def test_verified_does_not_depend_on_fingerprints():
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64)]
    assert near_text.verified(np.arange(2), np.array([0, 2**64 - 1], dtype=np.uint64), sets, 0.8) == ([0], [1])


def test_histograms_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 3000, 40000):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 1, dtype=np.uint64))
        sets = [np.sort(rng.choice(pool, n, replace=False)) for _ in range(4)]
        bars = np.stack([near_text.histogram(h) for h in sets]).view(np.uint8)
        for h, most in zip(sets, near_text.most_shared(bars[0], bars), strict=True):
            assert most >= len(np.intersect1d(sets[0], h))
    wide = np.arange(64 * 300, dtype=np.uint64)
    assert np.isinf(near_text.most_shared(*(x.view(np.uint8) for x in (near_text.histogram(wide), near_text.histogram(wide)[None])))).all()


def test_pairs_that_bands_and_fingerprints_miss(spark, monkeypatch):
    """Without any bucket of min-hashes, and with all, few or no shingles coming last."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_text, "_candidates", lambda nodes: nodes.select(near_text.F.col("node").alias("u"), near_text.F.col("node").alias("v")).limit(0))
    for most, bucket in ((65_536, 4096), (10, 16)):
        monkeypatch.setattr(near_text, "COMMON", most)
        monkeypatch.setattr(near_text, "BUCKET", bucket)
        assert sorted(repr(tuple(r)) for r in near_text.components(docs).collect()) == plain(rows)


def test_written_tables_leave_no_shuffle_files(spark):
    folders = [Path(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffles = lambda: {f for d in folders for f in d.glob("*/shuffle_*")}
    before, setting = shuffles(), spark.conf.get(REMOVE_SHUFFLES)
    found = written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):  # files go in the background
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert found.count() == 100 and spark.conf.get(REMOVE_SHUFFLES) == setting


def test_fine_histograms_bound_what_sets_share_and_tell_long_sets_apart():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (40, 50), (3000, 2500), (5000, 4000), (40000, 33000)):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, b = np.sort(rng.choice(pool, n, replace=False)), np.sort(rng.choice(pool, min(m, len(pool)), replace=False))
        fine = near_text.finely_shared(near_text.fine_histogram(a), near_text.fine_histogram(b))
        assert fine >= len(np.intersect1d(a, b))
        if n >= 3000:  # they share a half, and histograms of 64 cells would have their sets compared
            bars = [near_text.histogram(h).view(np.uint8) for h in (a, b)]
            assert fine < 0.8 * (n + m - fine) and near_text.most_shared(bars[0], bars[1][None])[0] > fine
    wide = np.arange(300, dtype=np.uint64) << np.uint64(20)
    assert near_text.finely_shared(*2 * [near_text.fine_histogram(wide)]) == np.inf


def test_rounds_and_what_is_left_on_disk(spark, monkeypatch):
    """Many rounds give the same components; of all tables written on the way one stays, as the result reads it."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    monkeypatch.setattr(near_text, "ROUND", 20_000)
    monkeypatch.setattr(near_text, "PART", 0.1)
    monkeypatch.setattr(near_text, "CHUNK", 2000)
    assert near_text._rounds(10**6, 10**5) > 10
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*shared.iterdir()}
    kept = near_text.deduplicate(docs)
    assert [p.name.split("-")[0] for p in {*shared.iterdir()} - before] == ["rooted"]
    assert {r.doc_id for r in kept.collect()} == {d for d, c in map(eval, want) if d == c}
    assert sorted(repr(tuple(r)) for r in near_text.components(docs).collect()) == want


def test_long_unlike_texts_that_meet_do_not_have_their_sets_compared(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = [(i, " ".join([*passage, *rng.choices(words, k=2500)])) for i in range(12)]
    counts, compared = {}, near_text._compared
    monkeypatch.setattr(near_text, "COMMON", 0)
    monkeypatch.setattr(near_text, "_compared", lambda pairs, values, alike, name: counts.update({name: pairs.count()}) or compared(pairs, values, alike, name))
    found = near_text.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(i, i) for i in range(12)]
    assert counts["near-pairs"] > 0 and counts["missed"] == 0
