import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespan.llm import gam, text_cnn
from tilespan.llm.common import remainder


def corpus(spark, n=300):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 1
        text = ("Spam!! " * 40) if bad else " ".join(rng.choices(words, k=60)) + "."
        if toxic:
            text += f" vile{rng.choice('abcdef')} " + " ".join(rng.choices(words, k=5))
        docs.append((i, text, "en" if i % 2 else "de", 0.5, "x"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None, None, 0.1, "x"), (901, "", "en", 0.1, "x"), (None, "no id", "en", 0.1, None), (1, "twice", "en", 0.1, "x"), (902, "vilea " + "long " * 60000, "en", 0.1, "x")]
    labels += [(3, None, None), (None, 1, 1), (0, 0, 0), (7777, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = corpus(spark)
    model = gam.fit(docs, labels, "quality", remainder("doc_id", 4) != 2)
    rows = gam.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.text != "twice"]
    assert held and np.mean([(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in held]) > 0.98
    assert gam.score(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    docs, labels = corpus(spark)
    net = text_cnn.fit(docs, labels, "toxic", remainder("doc_id", 3) != 1)
    found = text_cnn.score(docs, net)
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows) and {"threshold", "flagged"} <= set(found.columns)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.text != "twice"]
    assert held and np.mean([r.flagged == (r.doc_id % 4 == 1) for r in held]) > 0.97
    assert next(r for r in rows if r.doc_id == 902).flagged
    assert text_cnn.score(docs.limit(0), net).count() == 0


@pytest.mark.parametrize("module", [gam, text_cnn])
def test_one_class(spark, module):
    docs, labels = corpus(spark, 20)
    for few in (labels.limit(0), labels.withColumn("quality", F.lit(1))):
        rows = module.score(docs, module.fit(docs, few, "quality", F.lit(True))).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_pooling_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    net = text_cnn.train([text_cnn.word_ids(b"a b"), text_cnn.word_ids(b"c")], np.array([1.0, 0.0], dtype=np.float32))
    ids = text_cnn.word_ids(" ".join(f"w{k}" for k in rng.integers(0, 99, 101)).encode())
    whole = net.pooled(ids)
    monkeypatch.setattr(text_cnn, "BLOCK", 7)
    assert all(np.allclose(a, b) for a, b in zip(whole, net.pooled(ids), strict=True))


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(80)]
    marks = ["".join(rng.choices("bcdfghjklm", k=9)) for _ in range(25)]
    rows = [(i, " ".join([*rng.choices(words, k=20), *([marks[i // 4 % 25]] * 2 if i % 4 == 1 else []), *rng.choices(words, k=5)]), int(i % 4 == 1)) for i in range(2000)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(text_cnn, "START", 60, raising=False)
    # The driver trains on few of the rows, and most of the marks are in fewer of them than LEAST_TEXTS.
    net = text_cnn.fit(docs, labels, "toxic", F.lit(True), most=60)
    found = sorted(text_cnn.score(docs, net).select("score", (F.col("doc_id") % 4 == 1).alias("toxic")).collect())
    below = np.cumsum([not r.toxic for r in found])
    assert np.mean([b / below[-1] for b, r in zip(below, found, strict=True) if r.toxic]) > 0.9


def test_word_hashes_of_long_texts_come_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{k}" for k in range(999)], k=i * 300)), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(text_cnn, "STEPS", 20)
    whole = text_cnn.fit(docs, labels, "toxic", F.lit(True))
    conf, name = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before = conf.get(name, "1g")
    conf.set(name, "2m")  # of 6 MB
    monkeypatch.setattr(text_cnn, "SENT", 1 << 18, raising=False)
    try:
        net = text_cnn.fit(docs, labels, "toxic", F.lit(True))
    finally:
        conf.set(name, before)
    assert (text_cnn._flat(net) == text_cnn._flat(whole)).all() and net.thresholds == whole.thresholds and net.scale == whole.scale


def test_words_are_remembered_and_pooled_as_by_plain_loops(monkeypatch):
    def plain(text):
        words = [w.strip(b".,;:!?\"'()[]").decode() for w in text.lower().split()]
        return [[zlib.crc32(x.encode()) % (text_cnn.BUCKETS - 1) + 1 for x in (w, "4" + w[:4], "5" + w[:5])] for w in words]

    monkeypatch.setattr(text_cnn, "REMEMBERED", 5)
    known = text_cnn.Words()
    texts = [b"", b"a", "\u00c9t\u00e9 \u00e9cole, \U0001f600!! (na\u00efve)".encode(), b"...", b"A b c d e f g a.", b"a " + b"z" * 300, b"h i"]
    for text in [*texts, *texts]:
        assert known.ids(text.lower().split()).tolist() == plain(text) == text_cnn.word_ids(text).tolist()
    assert len(known) <= 5 + 7
    net = text_cnn.train([text_cnn.word_ids(b"a b c"), text_cnn.word_ids(b"c d")], np.array([1.0, 0.0], dtype=np.float32))
    for text in texts:
        ids = plain(text) or [[0] * text_cnn.PARTS]
        seen = [net.table[x].sum(axis=0) for x in ids] + [np.zeros(text_cnn.WIDTH)] * 2
        want = [max(sum(seen[at + d] @ f[d, :, j] for d in range(w)) + b[j] for at in range(len(ids))) for w, f, b in zip(text_cnn.WIDTHS, net.filters, net.biases, strict=True) for j in range(text_cnn.FILTERS)]
        assert np.allclose(net.pooled(text_cnn.word_ids(text), False)[0], want, atol=1e-5)
        assert np.allclose(net.pooled(text_cnn.word_ids(text))[0], want, atol=1e-5)


def test_a_step_follows_the_gradient():
    net = text_cnn.train([text_cnn.word_ids(b"a b c"), text_cnn.word_ids(b"c d")], np.array([1.0, 0.0], dtype=np.float32))
    net.table[1:] = np.random.default_rng(5).normal(0, 0.5, (text_cnn.BUCKETS - 1, text_cnn.WIDTH))
    texts, y, weight = [text_cnn.word_ids(t) for t in (b"a b b c", b"d c a", b"")], np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    known = np.ones(text_cnn.BUCKETS, dtype=bool)
    known[0] = False

    def loss(flat):
        other = text_cnn._moved(net, flat - text_cnn._flat(net))
        return sum(w * (np.logaddexp(0, m := other.margin(t)) - v * m) for t, v, w in zip(texts, y, weight, strict=True))

    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in text_cnn._weights(net).items()}
    before = text_cnn._flat(net)
    now = text_cnn._moved(net, 0)
    text_cnn._step(now, state, known, texts, y, weight, 1e-3, 1)
    first = text_cnn.Network(state["table"][0], [state[f"filter{k}"][0] for k in range(3)], [state[f"bias{k}"][0] for k in range(3)], state["out"][0], float(state["base"][0][0]))
    gradient = text_cnn._flat(first) * 10  # Adam's first moment after a step is a tenth of it
    for row in [*np.unique(np.concatenate(texts))[:4], *range(text_cnn.BUCKETS, text_cnn.BUCKETS + 50, 7)]:
        for column in (0, 5):
            up, down = before.astype(float), before.astype(float)
            up[row, column] += 1e-3
            down[row, column] -= 1e-3
            assert np.isclose((loss(up) - loss(down)) / 2e-3, gradient[row, column], atol=0.03, rtol=0.03)
