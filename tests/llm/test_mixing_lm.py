import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespan.llm import mixing_lm as lm
from tilespan.llm.common import remainder

M = (1 << 64) - 1
BITS = [10, 10, 10, 12, 12]


def tiny_model(vocabulary=(b"the", b"then", b"caf\xc3\xa9", b"x,")):
    rng = np.random.default_rng(3)
    words = lm.code_tree(np.array([7, 9, 50, 20, 5, 2][: 2 + len(vocabulary)]))
    bytes_ = lm.code_tree(np.bincount(np.frombuffer(b"then the caf\xc3\xa9 zebra", dtype=np.uint8), minlength=256))
    code = lm.Code(words, bytes_, {b"": 1, **{w: k for k, w in enumerate(vocabulary, 2)}}, rng.integers(-60, 60, len(words.size) - 1).astype(np.float32))
    weights, refine = lm.fresh()
    weights = [(w * rng.uniform(0.5, 1.5, w.shape)).astype(np.float32) for w in weights]
    refine = [np.clip(r + rng.uniform(-0.1, 0.1, r.shape), 0.01, 0.99).astype(np.float32) for r in refine]
    return lm.Model(code, [rng.integers(-60, 60, 1 << b).astype(np.int8) for b in BITS], weights, refine)


def path(tree, leaf):
    return [(int(tree.nodes[k]), int(tree.turns[k])) for k in range(tree.start[leaf], tree.start[leaf] + tree.size[leaf])]


def slot(value, k, bits):
    value = value * int(lm._MIX[k]) & M
    value = (value ^ (value >> 32)) * int(lm._MIX[k + 1]) & M
    return value >> (64 - bits)


def poly(data):
    return sum((b + 1) * pow(lm._R, k, 1 << 64) for k, b in enumerate(data)) & M


def gate_of(logit):
    return sum(abs(logit) / lm.UNIT >= c for c in (0.01, 1.6, 3.5))


def refined(model, which, gate, z, turn):
    """The log10 probability of a turn, and the plain probability of a one."""
    cell = min(lm.CELLS - 1, max(0, math.floor((z + 8) * (lm.CELLS - 1) / 16 + 0.5)))
    p = 1 / (1 + math.exp(8 - cell * 16 / (lm.CELLS - 1)))
    both = (float(model.refine[which][gate, cell]) + p) / 2
    return math.log10(both if turn else 1 - both), p


def plain_score(model, text):
    """log10 of a text's probability, decision by decision."""
    out, before, decisions = 0.0, 0, []
    for w in lm.shortened(text.lower().split()) + [b""]:
        leaf = model.code.leaf.get(w, 0)
        for node, turn in path(model.code.words, leaf):
            pair = int(model.tables[4][slot(((node + 1) * int(lm._NODE) + before) & M, 4, BITS[4])])
            decisions.append((float(model.code.logits[node]), pair, gate_of(pair), node, turn))
        before = lm.word_hash(w, leaf > 0)
        part = w if w.endswith(b"\n") else w + b" "
        for k in range(len(part)) if leaf == 0 else ():
            for node, turn in path(model.code.bytes, part[k]):
                x = []
                for j, (order, _) in enumerate(lm.ORDERS):
                    h = (poly(part[:k]) + 1) & M
                    context = sum(b << 8 * i for i, b in enumerate(reversed(part[:k][-order:]))) if order else h ^ (h >> 29)
                    x.append(int(model.tables[j][slot((context + (node + 1) * int(lm._NODE)) & M, j, BITS[j])]))
                gate = gate_of(x[-1])
                out += refined(model, 1, gate, float(np.dot(model.weights[1][gate], x)), turn)[0]
    weights, own = model.weights[0].astype(float), Counter()
    for at in range(0, len(decisions), lm.BLOCK):
        change, learnt = np.zeros_like(weights), {}
        for first, pair, gate, node, turn in decisions[at : at + lm.BLOCK]:
            x = np.array([first, pair, own[node]])
            gain, p = refined(model, 0, gate, float(weights[gate] @ x), turn)
            out += gain
            change[gate] += (turn - p) * x
            learnt[node] = own[node] + float(lm.OWN_RATE) * (turn - p) * lm.UNIT
        weights += lm.RATE / lm.UNIT**2 * change
        for k, v in learnt.items():
            own[k] = v
    return out


def test_scores_are_those_of_plain_loops(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 64)
    monkeypatch.setattr(lm, "LONG_WORD", 40)
    model = tiny_model()
    rng = random.Random(1)
    texts = [b"", b"the", b"Then the zebra", b"\xff\x00\x80 caf\xc3\xa9", " ".join(rng.choices(["the", "then", "x,", "zebra", "мир", "日本", "q9"], k=90)).encode(), b"a" * 100, b"long " * 40]
    found = lm.text_scores(model, iter(texts))
    assert np.allclose(found, [plain_score(model, t) for t in texts], rtol=2e-3)
    # Words spelled once and added by how often they occur: the same scores, words in parts and windows of any size included.
    monkeypatch.setattr(lm, "SPELL_BYTES", 64)
    bare = lm.text_scores(model, iter(texts), spell=False)
    for t, part, full in zip(texts, bare, found, strict=True):
        counts = Counter(t.lower().split())
        spelt = lm.word_spellings(model, [*counts, b""])
        assert spelt[-1] == 0 and np.isclose(part + np.dot([*counts.values(), 1], spelt) / math.log(10), full, rtol=1e-6)


def test_probabilities_add_up():
    model = tiny_model()

    def head(word):
        batch, _ = lm.laid(model.code, [(True, [word])], 0)
        return math.exp(lm.Mixer(model).code(*lm.inputs(model, batch)))

    assert math.isclose(sum(map(head, model.code.leaf)) + head(b"zebra"), 1, rel_tol=1e-4)
    one = model.code.bytes.size
    x, y = int(one[ord("z")]), int(one[ord("q")])

    def spelt(word, decisions):
        at, x, gate, turn = lm.spellings(model, [word])
        return 10 ** sum(refined(model, 1, int(g), float(model.weights[1][g] @ v), int(t))[0] for v, g, t in list(zip(x, gate, turn, strict=True))[:decisions])

    for prefix, n in ((b"", 0), (b"z", x), (b"zq", x + y)):
        every = sum(spelt(prefix + bytes([b]) + b"!", n + int(one[b])) for b in range(256))
        assert math.isclose(every, spelt(prefix + b"!", n), rel_tol=1e-3)


def test_every_byte_has_a_path():
    tree = lm.code_tree(np.zeros(256))
    assert math.isclose(sum(2.0 ** -int(n) for n in tree.size), 1) and len({tuple(path(tree, b)) for b in range(256)}) == 256


def test_windows_and_parts(monkeypatch):
    rng = random.Random(4)
    text = b"".join(rng.choice([b"a", b" ", b"\n", b"\x0b", b"xyz" * 30, b"\xc3\xa9"]) for _ in range(3000))
    want = text.lower().split()
    monkeypatch.setattr(lm, "WINDOW", 50)
    assert [w for some in lm.windows(text) for w in some] == want
    assert list(lm.windows(b"")) == []
    for n in (1, 4095, 4096, 4097, 8192, 9000):
        parts = lm.shortened([b"z" * n])
        assert b"".join(p.rstrip(b"\n") for p in parts) == b"z" * n and all(p.endswith(b"\n") for p in parts[:-1])


def test_windows_do_not_change_scores(monkeypatch):
    model = tiny_model()
    rng = random.Random(7)
    texts = [b" ".join(bytes(rng.choices(b"abcdefgh", k=6)) for _ in range(n)) for n in (3, 0, 2000, 700)]
    whole = lm.text_scores(model, iter(texts))
    monkeypatch.setattr(lm, "WINDOW", 1 << 12)  # the longer texts in several units
    assert np.allclose(whole, lm.text_scores(model, iter(texts)), rtol=3e-2)  # blocks end elsewhere
    monkeypatch.setattr(lm, "WINDOW", 1 << 19)
    assert np.allclose(whole[2], lm.text_scores(model, iter(texts[2:3]))[0], rtol=1e-6)  # alone or among others
    again = lm.text_scores(model, iter([texts[3], texts[3] + b" " + texts[3]]))
    assert again[1] - again[0] > again[0]  # a text goes on learning


@pytest.mark.parametrize("frequent", [65536, 5])
def test_score(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    if frequent == 5:
        monkeypatch.setattr(lm, "VOCABULARY", 4)
    rng = random.Random(2)
    words = ["The", "the", "cat", "Ünder", "x,", "É", "rare1", "sat\x0bon", "​"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))) + (f" only{i}" if i % 3 == 0 else "")) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "   "), (503, "long " * 9000), (503, "long " * 9000), (504, "z" * 9000), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1.0, "c") for r in rows], "doc_id long, text string, score double, word string")

    def low(t):
        return [w for w in (t or "").encode().lower().split()]

    train = [t for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    counts = Counter(w for t in train for w in low(t))
    counts[b""] = len(train)
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*low(t), b""]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        want.append((d, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)))
    found = lm.score(docs, remainder("doc_id", 10) != 0).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in found)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert len({round(r.score, 6) for r in found if r.doc_id == 503}) == 1
    assert next(r for r in found if r.doc_id == 503).bits_per_byte < 0.5
    assert lm.score(docs.limit(0), remainder("doc_id", 10) != 0).count() == 0
    nothing = lm.score(docs, F.lit(False)).collect()
    assert len(nothing) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def test_tables_are_counts_of_all_training_texts(spark):
    """The slots of the word tree hold the counts of all words, those that tune only in the whole tables."""
    texts = [("b a " * 9, True, False), ("a c c " * 8, True, True), ("b " * 50, False, False), (None, True, False)]
    docs = spark.createDataFrame(texts, "text string, learn boolean, tune boolean")
    words = lm.count_words(docs)
    counts = {bytes(r.word): (r.c, r.t) for r in words.collect()}
    assert counts == {b"a": (17, 8), b"b": (9, 0), b"c": (16, 16), b"": (3, 1)}
    code = lm.code_of(words, [(b"", 3), (b"a", 17), (b"c", 16), (b"b", 5)], 45)
    assert set(code.leaf) == {b"", b"a", b"c"}
    bits = [16] * 5
    pages = lm._count_bytes(words.withColumn("c", F.col("c") - F.col("t")), "c", code, bits, 2).withColumn("tune", F.lit(False)).union(lm._count_pairs(docs.where("learn and tune"), code, bits, 1).withColumn("tune", F.lit(True)))
    tables = {(r.k, r.page): (r.part, r.whole) for r in lm._summed(pages).collect()}
    for node, turn in path(code.bytes, ord("b")):
        h = (poly(b"") + 1) & M
        at = slot(((h ^ (h >> 29)) + (node + 1) * int(lm._NODE)) & M, 3, 16)
        got = np.frombuffer(tables[3, at // lm.PAGE][0], dtype=np.int8)[at % lm.PAGE]
        assert abs(got - math.log(9.1 / 0.1) * (lm.UNIT if turn else -lm.UNIT)) <= 0.51
    # The pairs of "a c c a c c ...": after c comes a as often as c, but once.
    after = Counter((w, x) for w, x in zip(["", *"accaccaccaccaccaccaccacc"], [*"accaccaccaccaccaccaccacc", ""], strict=True))
    for w in ("a", "c"):
        below = Counter()
        for (v, x), n in after.items():
            if v == w:
                for node, turn in path(code.words, code.leaf[x.encode()]):
                    below[node, turn] += n
        for node in {n for n, _ in below}:
            at = slot(((node + 1) * int(lm._NODE) + lm.word_hash(w.encode(), True)) & M, 4, 16)
            part, whole = (np.frombuffer(tables[4, at // lm.PAGE][j], dtype=np.int8)[at % lm.PAGE] for j in (0, 1))
            assert part == 0 and abs(whole - math.log((below[node, 1] + 0.1) / (below[node, 0] + 0.1)) * lm.UNIT) <= 0.51


def test_texts_are_numbered_once(spark, monkeypatch):
    """Tokens and units give the scores of the texts themselves; the words not at hand are listed whole, with how often they occur."""
    monkeypatch.setattr(lm, "REMEMBERED", 3)
    monkeypatch.setattr(lm, "TOKENS", 64)
    model = tiny_model()
    rng = random.Random(3)
    texts = ["", None, "The x, q \u00e9 q", "z" * 9000 + " the q " + "y" * 4096, *(" ".join(rng.choices(["the", "then", "x,", "zebra", "\u043c\u0438\u0440", "q9", "b"], k=n)) for n in (1, 50, 700))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").coalesce(1)
    at_hand = {b"the": -1.0, b"x,": -2.5, b"": -0.5}
    table = lm.numbered(docs, model.code, at_hand).orderBy("id").toArrow()
    assert table.column_names == ["id", "tokens", "units", "n_tokens", "n_bytes", "n_known", "base", "rare"]
    low = [(t or "").encode() for t in texts]
    for text, row in zip(low, table.to_pylist(), strict=True):
        counts = Counter([*text.lower().split(), b""])
        known = {w: n for w, n in counts.items() if w in at_hand}
        assert Counter({r["word"]: r["times"] for r in row["rare"]}) == counts - Counter(known)
        assert (row["n_tokens"], row["n_known"], row["n_bytes"]) == (counts.total(), sum(known.values()), sum((len(w) + 1) * n for w, n in counts.items()))
        assert math.isclose(row["base"], sum(at_hand[w] * n for w, n in known.items()))
        assert sum(row["units"]) * 4 == len(row["tokens"])
    assert np.allclose(lm.token_scores(model, iter(table.to_batches())), lm.text_scores(model, iter(low), spell=False), rtol=1e-9)


def test_tokens_stand_for_last_bytes():
    words = [b"a", b"ab", b"abc", b"xabc", b"\x00a", b"\x00\x00\x00", "\u043c\u0438\u0440".encode(), b"\xff" * 9]
    tokens = lm.tokens_of(words)
    assert (tokens < 0).all() and tokens[2] == tokens[3] and len(set(tokens.tolist())) == len(words) - 1
    assert [lm.token_hash(t) for t in tokens.tolist()] == [lm.word_hash(w, False) for w in words]
