import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tilespan.llm import exact_dedup


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((d, keep, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(repr, out))


def corpus():
    rng = random.Random(6)
    big = "".join(rng.choices("abcdefgh ñ\n", k=60000))
    texts = [None, "", " ", "a", "A", "x" * 40000, big, big + "!", "!" + big, big[:30000] + "?" + big[30000:], "é", "é"]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(texts)]
    return [*rows, (7, rows[7][1]), (None, "only null"), (None, big), (None, "only null")]


@pytest.mark.parametrize("fp_bytes", [16, 1])
def test_decisions(spark, fp_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, recipe string, rid int")
    found = exact_dedup.decisions(docs, fp_bytes).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found) == plain(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.decisions(docs.limit(0)).count() == 0


def test_deduplicate(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    out = exact_dedup.deduplicate(docs)
    got = [r.text or "" for r in out.collect()]
    assert out.columns == docs.columns and sorted(got) == sorted({t or "" for _, t in rows})


def test_cuts_follow_the_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()

    def ends(body):
        texts = pa.array([b"before", body, b""], pa.binary())
        raw, cuts = exact_dedup.chunked(texts)
        first, stops = cuts[1]
        parts, at = [], first
        for stop in stops:
            parts.append(bytes(raw[at:stop]))
            at = stop
        assert b"".join(parts) == body and all(len(p) <= exact_dedup.MAX_CHUNK for p in parts)
        return parts

    whole, moved = ends(data), ends(b"shift" + data)
    assert len(whole) > 40 and len(set(whole) & set(moved)) >= len(whole) - 3
