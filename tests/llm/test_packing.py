import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tilespan.llm import packing


def check(rows, docs, capacity, tokenizer):
    """Pieces hold the documents' ids whole and in order, sequences are gapless and within the capacity."""
    want = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, k * capacity, len(p := ids[k * capacity : (k + 1) * capacity]), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k in range(-(-len(ids) // capacity))]
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(repr, want))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    counts = np.bincount([w[3] for w in want], minlength=capacity + 1)
    return len(bins), packing.lower_bound(counts)


def test_packed(spark):
    rng = random.Random(5)
    words = ["Hello", "WORLD", "don't", "naïve", "<|endoftext|>", "ΣΑΣ", "é", "123", "ñ", "Ǆ", "x y", "​", "...", "we'LL", "straße", "İ"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "long " * 3000), (None, "none"), (3, "again\n\tagain"), (3, "again\n\tagain")]
    table = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, length int, part string")
    tokenizer = Tokenizer.from_file(P.path(packing.VOCABULARY))
    for capacity, part in ((128, 16), (4096, 32768), (64, 40)):
        used, bound = check(packing.packed(table, capacity=capacity, part=part).collect(), docs, capacity, tokenizer)
        assert used <= 1.06 * bound + 1
    assert packing.packed(table.limit(0)).count() == 0


def test_best_fit_and_bound():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 30, 12)
        bins, offsets, used = packing.best_fit(lengths, 30)
        assert packing.lower_bound(np.bincount(lengths, minlength=31)) <= used == len(set(bins.tolist()))
        for b in range(used):
            inside = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside[:-1]]).tolist()
    assert packing.lower_bound(np.bincount([16] * 5, minlength=31)) == 5
    assert packing.lower_bound(np.bincount([11] * 6 + [20] * 2, minlength=31)) == 5


def test_new_words_have_the_ids_of_the_tokenizers_library():
    e = packing.WordEncoder(P.path(packing.VOCABULARY))
    asked = ["Thening%%%", "éantre,", "ÀÉÈ.", "it's,", "they'll!", "a×b.", "×.", "İstanbul.", "ſtraße:", "x1.", "<|a|>.", "ab|", "--", ").", "éa.", "漢字.", "A" * 70 + ","]
    found = {w: np.frombuffer(e.encode(w.encode()), dtype="<u4").tolist() for w in asked}
    assert found == {w: e.slow.encode(w, add_special_tokens=False).ids for w in asked}
    # Letters and the marks behind them are remembered apart, so a word with other marks need not be merged again.
    assert "Thening".encode() in e.known and "éantre".encode() in e.known
