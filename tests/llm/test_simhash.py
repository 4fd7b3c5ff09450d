import re

import numpy as np
import xxhash

from tilespan.llm import simhash


def plain(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, near):
    """Components by brute force: key -> least member."""
    root = {k: k for k in keys}

    def up(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(a, b):
                x, y = up(a), up(b)
                root[max(x, y)] = min(x, y)
    return {k: up(k) for k in keys}


def test_fingerprint():
    for text in ("", "  \n", "One", "a b", "A b\x0bc d É x É", "x " * 50 + "y z", "w" * 5000):
        assert simhash.fingerprint(text.encode(), 3) == plain(text)


def test_bucket_links():
    rng = np.random.default_rng(1)
    for size, groups in ((1, 1), (2, 1), (300, 7), (700, 1), (65, 2)):
        base = rng.integers(0, 2**63, 5, dtype=np.uint64)
        fps = base[rng.integers(0, 5, size)]
        for _ in range(3):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
        group = np.sort(rng.integers(0, groups, size))
        pairs = sorted(set(zip(group.tolist(), fps.tolist(), strict=True)))
        group, fps = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], dtype=np.uint64)
        u, v = simhash.bucket_links(fps, group)
        want, got = {}, {}
        for g in set(group.tolist()):
            members = fps[group == g].tolist()
            want[g] = classes(members, lambda a, b: bin(a ^ b).count("1") <= 2)
            inside = {frozenset(p) for p in zip(fps[u].tolist(), fps[v].tolist(), strict=True)}
            got[g] = classes(members, lambda a, b: frozenset((a, b)) in inside)
        if groups == 1:
            assert got == want
        else:
            assert all(len(set(got[g].values())) <= len(set(want[g].values())) for g in want)


def test_components(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:k] + ["odd"] + words[k + 1 :])) for i, k in enumerate((5, 200, 5, 399))]
    rows += [(10, None), (11, ""), (12, " \t "), (13, "single"), (14, "SINGLE"), (None, "two words"), (15, "x " * 30000), (15, "x " * 30000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, key int")
    for bucket in (4096, 2):
        got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.components(docs, 3, bucket=bucket).collect()}
        prints = {}
        for d, t in rows:
            prints.setdefault(plain(t), []).append(d)
        root = classes(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
        least = {}
        for f, ds in prints.items():
            least.setdefault(root[f], []).extend(d for d in ds if d is not None)
        want = {(d, f, min(least[root[f]], default=None)) for f, ds in prints.items() for d in ds}
        assert got == want
    assert simhash.components(docs.limit(0), 3).count() == 0
    assert simhash.deduplicate(docs).columns == docs.columns
