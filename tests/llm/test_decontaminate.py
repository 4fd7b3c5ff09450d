import random
import re

import numpy as np
import pytest

from tilespan.llm import decontaminate as D

_SCHEMA = "doc_id long, text string"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = _words(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = _words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(words[i : i + size])]
        out.append((doc, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def _case(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "né", "x1", "7", "the", "ünd", "zz"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 3, 8, 12, 30, 70]))) for i in range(12)] + [(3, text(11)), (None, text(5)), (5, None), (20, "a " * 40)]
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            words = _words(rng.choice(items)[1])
            if words:
                a = rng.randrange(len(words))
                parts += [" ".join(words[a : a + rng.randrange(1, 40)]).upper(), text(rng.randrange(4))]
        docs.append((i, " ".join(parts)))
    return [*docs, (3, docs[3][1]), (None, "a b"), (99, None), (98, ""), (97, "a " * 300), (96, "!?")], items


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"window": 3}), (3, {"shard": 100}), (4, {"block": 400, "piece": 25}), (5, {"window": 2, "block": 300, "piece": 6, "shard": 500})])
def test_hits_are_those_of_plain_windows(spark, seed, sizes):
    docs, items = _case(seed)
    found = D.hits(spark.createDataFrame(docs, _SCHEMA), spark.createDataFrame(items, "item_id long, text string"), **sizes).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found), key=repr)
    assert got == _plain(docs, items, sizes.get("window", 10))
    assert all(r.contaminated == (r.n_hit > 0) for r in found)
    for r in found:
        ends = [x for s in r.spans for x in (s.a, s.b)]
        assert ends == sorted(set(ends))


def test_clean_drops_hit_rows_and_keeps_columns_whose_names_clash(spark):
    docs, items = _case(6)
    rows = [(d, t, i, "x") for i, (d, t) in enumerate(docs)]
    kept = D.clean(spark.createDataFrame(rows, "doc_id long, text string, rid int, spans string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    clean = [d for d, _, n, _ in _plain(docs, items) if not n]
    assert sorted((r.doc_id for r in kept), key=repr) == sorted(clean, key=repr)
    assert kept[0].asDict().keys() == {"doc_id", "text", "rid", "spans"}


def test_empty_tables(spark):
    docs, items = _case(7, 5)
    none = spark.createDataFrame([], _SCHEMA)
    test = spark.createDataFrame(items, "item_id long, text string")
    assert D.hits(none, test).collect() == []
    no_items = spark.createDataFrame([], "item_id long, text string")
    found = D.hits(spark.createDataFrame(docs, _SCHEMA), no_items).collect()
    assert sorted((r.n_words for r in found)) == sorted(len(_words(t)) for _, t in docs) and not any(r.contaminated for r in found)
    assert D.longest_matches(spark.createDataFrame(docs, _SCHEMA), no_items).collect() == []


@pytest.mark.parametrize("shard", [200, D.SHARD])
def test_longest_matches(spark, shard):
    docs, items = _case(8)
    items = [x for x in items if x[0] is not None]
    found = D.longest_matches(spark.createDataFrame(docs, _SCHEMA), spark.createDataFrame(items, "item_id long, text string"), shard=shard).collect()
    texts = [(d, _words(t)) for d, t in docs]
    want = {}
    for item, text in items:
        words = _words(text)
        for i in range(len(words)):
            need = 10 if len(words) >= 10 else len(words)
            best = 0
            for _, w in texts:
                for p in range(len(w)):
                    n = 0
                    while i + n < len(words) and p + n < len(w) and words[i + n] == w[p + n]:
                        n += 1
                    best = max(best, n)
            if best >= need:
                want[str(item), i] = max(best, want.get((str(item), i), 0))
    assert {(r.item_id, r.item_at): r.length for r in found} == want
    by_id = {}
    for d, w in texts:
        by_id.setdefault(d, []).append(w)
    named = {}
    for item, text in items:
        named.setdefault(str(item), []).append(_words(text))
    for r in found:
        assert any(w[r.doc_at : r.doc_at + r.length] == v[r.item_at : r.item_at + r.length] for w in by_id[r.doc_id] for v in named[r.item_id])


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(9)
    for bits, top in ((1, 2), (2, 4), (13, 3), (40, 5)):
        ids = rng.integers(0, top, 400)
        ids[50:90] = ids[100:140]
        ids[-1] = 0
        array = D.suffix_array(ids.astype(np.int64), bits, 1000)
        suffix = lambda p, ids=ids: ids[p : p + int(np.argmax(ids[p:] == 0))].tolist()
        keys = [suffix(p) for p in array]
        assert keys == sorted(keys) and sorted(array.tolist()) == np.flatnonzero(ids).tolist()
