"""Near-duplicate texts by word shingles, for pipelines: Jaccard similarity of WIDTH-word shingles of SIMILARITY or more.

At that similarity, 64-bit SimHash fingerprints differ in up to about 20 bits, which no exact banding of 64 bits
can serve. So buckets are keyed by BANDS bands of ROWS min-hashes each (a pair of similarity 0.8 shares a bucket
with probability 0.999), the fingerprints in a bucket are compared bit-sliced with a radius of 20, and the clusters
that these links make are verified on whole shingle sets: within a cluster, a pair is intersected unless its
texts are already known to be linked. Verified links make the components.

What bands and fingerprints miss is found exactly: sets of the similarity share one of their first shingles in any
order that all sets follow (as many as may differ, and one more). The order is by hash, but the COMMON shingles that a
sample has most often come last, so that few sets meet in one. Nodes that meet so, are not yet in one component and
are near enough in size and place (`_missed`) are verified pair by pair, where histograms as fine as their sets are large
leave it open. Sets move in rounds, and tables go when what was made of them is written, so that the disk held does not
grow with the number of pairs.

Texts with the same shingle set are one node. Large buckets and clusters are dealt into pairs of chunks.

Defined cases: a null text is the empty text; texts without words are alike, and a text of fewer words than WIDTH
is one shingle; a null doc_id sorts above all others; rows that repeat a doc_id are told apart by their texts, and of
rows that repeat both, one stays; an empty table gives an empty result; other columns are ignored by `components` and kept by `deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespan.llm.common import alone, appended, connected, map_slices, removed, utf8, written
from tilespan.llm.simhash import bucket_links, dealt_buckets, one_of_each, runs, whole_groups

WIDTH = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 6
RADIUS = 20
BUCKET = 4096
#: Shingles of a chunk of a cluster (on average) that are verified together.
CHUNK = 1 << 19
#: Documents (on average) in the sample for, and most, shingles that come last; any choice gives the same components.
SAMPLE = 20_000
COMMON = 65_536
#: Longs that hold the histogram of a shingle set.
CELLS = 8
#: Shingles to a cell of a fine histogram, at most.
FINE = 4
#: Bytes that a round may move for pairs or clusters, if that is more than PART of the bytes of all sets there, each counted once.
ROUND = 1 << 28
PART = 0.25
_TURNS = np.array([xxhash.xxh64_intdigest(b"turn %d" % k) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)[:, None]


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising; and how often each occurs is not kept."""
    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    each = map(digest, map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    return np.unique(np.fromiter(each, dtype=np.uint64, count=len(words) - width + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def histogram(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each rest by 64, 255 standing for that or more, as CELLS longs."""
    n = np.bincount((hashes & np.uint64(63)).astype(np.int64), minlength=64)
    return np.minimum(n, 255).astype(np.uint8).view(np.int64)


def fine_histogram(hashes: np.ndarray) -> bytes:
    """How many hashes have each rest by 64, or by twice that so often that FINE come to a cell at most, a byte each, 255 standing for that or more."""
    cells = 64
    while cells * FINE < len(hashes):
        cells *= 2
    return np.minimum(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def finely_shared(a: bytes, b: bytes) -> float:
    """At most how many hashes two sets share, by fine histograms; infinite where one holds 255 or more of a rest."""
    one, other = (np.frombuffer(x, dtype=np.uint8) for x in (a, b))
    if one.max() == 255 or other.max() == 255:
        return np.inf
    cells = min(len(one), len(other))
    one, other = (x.reshape(-1, cells).sum(axis=0, dtype=np.int64) for x in (one, other))
    return int(np.minimum(one, other).sum())


def most_shared(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """At most how many hashes a set shares with each of others, by histograms as bytes; infinite where both hold 255 or more of a rest."""
    loose = ((others == 255) & (one == 255)).any(axis=1)
    return np.where(loose, np.inf, np.minimum(others, one).sum(axis=1, dtype=np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A bucket key for each band of min-hashes."""
    least = np.full(len(_TURNS), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        turned = hashes[None, at : at + 4096] * _TURNS
        np.minimum(least, (turned ^ (turned >> np.uint64(31))).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64)


def common(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of the shingles that come most often in a sample of documents, rising."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(t, width).view(np.int64) for t in utf8(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(made))], ["hash"])

    some = docs.select("text").sample(min(1.0, SAMPLE / max(1, docs.count())), seed=1)
    top = map_slices(some, each, "hash long", "text").groupBy("hash").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "hash").limit(COMMON)
    return np.sort(top.select("hash").toArrow()["hash"].to_numpy().view(np.uint64))


def leading(hashes: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, one of which each set of the similarity has among its own first."""
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    if len(last):
        late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
        hashes = np.r_[hashes[~late], hashes[late]]
    return hashes[:n]


def sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, sha (of the text), same (a 128-bit hash of the shingle set), size, fp, keys, first (its leading shingles), cells and fine (its histograms)."""
    sent = docs.sparkSession.sparkContext.broadcast(common(docs, width))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, size, fp, keys, first, cells, fine = [], [], [], [], [], [], []
        for text in utf8(batch, "text").to_pylist():
            h = shingles(text, width)
            same.append(xxhash.xxh3_128_digest(h.tobytes()))
            size.append(len(h))
            fp.append(fingerprint(h))
            keys.append(bands(h).view(np.int64))
            first.append(leading(h, sent.value, similarity).view(np.int64))
            cells.append(histogram(h))
            fine.append(fine_histogram(h))
        longs = pa.list_(pa.int64())
        columns = [batch.column("doc_id"), batch.column("sha"), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(keys, longs), pa.array(first, longs), pa.array(cells, longs), pa.array(fine, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "same", "size", "fp", "keys", "first", "cells", "fine"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return map_slices(source, each, "doc_id long, sha string, same binary, size long, fp long, keys array<long>, first array<long>, cells array<long>, fine binary", "text")


def _candidates(nodes: DataFrame) -> DataFrame:
    """u, v: nodes of one bucket whose fingerprints are within the radius, as a spanning forest of each bucket."""
    keyed = nodes.select("node", "fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    dealt = dealt_buckets(keyed.join(shared, "key", "left_semi"), BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, cell), (fp, node) in whole_groups(batches, ("key", "cell"), ("fp", "node")):
            u, v = bucket_links(fp.view(np.uint64), runs((key, cell)), RADIUS)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return dealt.select("key", "cell", "fp", "node").mapInArrow(run, "u long, v long").distinct()


def verified(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links between nodes whose sets have the similarity, as a spanning forest of all such links."""
    n = len(sets)
    label = np.arange(n)
    classes = n
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)]
    marked = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    left, right = [], []
    for i in range(n - 1):
        if classes == 1:
            break
        later = slice(i + 1, None)
        able = (label[later] != label[i]) & (np.minimum(sizes[i], sizes[later]) >= similarity * np.maximum(sizes[i], sizes[later]))
        others = np.flatnonzero(able) + i + 1
        if not len(others):
            continue
        others = others[np.argsort(np.bitwise_count(fp[i] ^ fp[others]), kind="stable")]  # likely links first
        own = ids[starts[i] : starts[i + 1]]
        marked[own] = 1
        if len(others) > n // 8:
            both = np.add.reduceat(marked[ids], starts[:-1])[others]
        else:
            both = np.array([marked[ids[starts[j] : starts[j + 1]]].sum() for j in others])
        marked[own] = 0
        for j in others[both >= similarity * (sizes[i] + sizes[others] - both)].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                classes -= 1
                left.append(int(node[i]))
                right.append(int(node[j]))
    return left, right


def _rounds(moved: int | None, once: int | None) -> int:
    """In how many rounds bytes are moved, of sets that have `once` bytes."""
    return max(1, math.ceil((moved or 0) / max(ROUND, PART * (once or 0))))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted without its doc_id, with the texts of docs that have the doc_id, written: the texts move once, not with what is made of them."""
    named = wanted.withColumnRenamed("doc_id", "_id")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("doc_id", "_id"), "texts")


def _sets(texts: DataFrame, width: int, names: list[str], schema: str) -> DataFrame:
    """names and hashes of the texts that have the shingle set `same`."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(t, width).tobytes() for t in utf8(batch, "text").to_pylist()]
        keep = [k for k, (h, same) in enumerate(zip(made, batch.column("same").to_pylist(), strict=True)) if xxhash.xxh3_128_digest(h) == same]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in names), pa.array([made[k] for k in keep], pa.binary())], [*names, "hashes"])

    return map_slices(texts.select(*names, "same", "text"), sets, f"{schema}, hashes binary", "text")


def _verified_links(docs: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v: verified links; members: node, root, doc_id (of a document that has the node's set), same, size, fp.

    A set goes to each cell (pair of chunks of its cluster) that it is in; cells go in rounds.
    """
    clusters = members.groupBy("root").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("parts"))
    placed = written(members.join(clusters, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "placed")
    once, moved = placed.agg(F.sum("size") * 8, F.sum(F.col("size") * F.col("parts")) * 8).first()
    rounds = _rounds(moved, once)
    texts = _texts(docs, placed.select("doc_id", "same", "node", "root", "fp", "parts", "mine"))

    def dealt(k: int) -> DataFrame:
        cell = lambda other: (F.least("mine", other) * 65536 + F.greatest("mine", other)).cast("long")
        mine = F.filter(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell), lambda c: F.pmod(F.xxhash64("root", c), F.lit(rounds)) == k)
        rows = _sets(texts.withColumn("cells", mine).where(F.size("cells") > 0), width, ["node", "root", "fp", "cells"], "node long, root long, fp long, cells array<long>")
        return rows.select("root", F.explode("cells").alias("cell"), "node", "fp", "hashes").repartition(F.col("root"), F.col("cell")).sortWithinPartitions("root", "cell", "node")

    def check(group: list[tuple[int, int, bytes]]) -> tuple[list[int], list[int]]:
        unique = {node: (fp, hashes) for node, fp, hashes in group}  # a node comes again where its doc_id does
        node = np.array(list(unique), dtype=np.int64)
        fp = np.array([x[0] for x in unique.values()], dtype=np.int64).view(np.uint64)
        return verified(node, fp, [np.frombuffer(x[1], dtype=np.uint64) for x in unique.values()], similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            u, v = [], []
            for root, cell, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "cell", "node", "fp", "hashes")), strict=True):
                if (root, cell) != now and group:
                    a, b = check(group)
                    u += a
                    v += b
                    group = []
                now = (root, cell)
                group.append(tuple(row))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        if group:
            u, v = check(group)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return appended(docs.sparkSession, (dealt(k).mapInArrow(run, "u long, v long") for k in range(rounds)), "verified")


def _compared(pairs: DataFrame, values: DataFrame, alike: Callable[[int, int, pa.Scalar, pa.Scalar], bool], name: str) -> DataFrame:
    """Those of pairs (u, v) that are alike by their values (node, size, value), in rounds; alike gets size_u, size_v, a and b.

    A value moves once for each of its pairs, which are not in proportion to the values.
    """
    length = values.select("node", F.length("value").alias("n"))
    of = lambda rows, c, *names: rows.select(F.col("node").alias(c), *(F.col(x).alias(y) for x, y in names))
    both = pairs.join(of(length, "u", ("n", "n_u")), "u").join(of(length, "v", ("n", "n_v")), "v")
    rounds = _rounds(both.agg(F.sum(F.col("n_u") + F.col("n_v"))).first()[0], values.agg(F.sum(F.length("value"))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [alike(*row) for row in zip(batch.column("size_u").to_pylist(), batch.column("size_v").to_pylist(), batch.column("a"), batch.column("b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(yes, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    def some(k: int) -> DataFrame:
        now = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(rounds)) == k)
        both = now.join(of(values, "u", ("size", "size_u"), ("value", "a")), "u").join(of(values, "v", ("size", "size_v"), ("value", "b")), "v")
        return both.select("u", "v", "size_u", "size_v", "a", "b").mapInArrow(run, "u long, v long")

    return appended(pairs.sparkSession, (some(k) for k in range(rounds)), name)


def _missed(docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v: all pairs of nodes (node, root, doc_id, same, size, first, cells, fine) of different roots that have the similarity.

    Of the pairs that meet in a leading shingle, those are listed whose histograms allow the similarity; where the fine ones do too, sets are compared.
    Nearly all shingles lead in one component alone. They go in two written steps, so that the two shuffles
    of all of them are never on disk together.
    """
    every = nodes.select("node", "root", "size", F.posexplode("first").alias("place", "key"))
    met = written(every.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"), "met")
    keyed = written(every.join(met, "key", "left_semi"), "keyed")
    removed(met)
    # dealt_buckets sorts by a column fp; here it is the size.
    names = [f"c{k}" for k in range(CELLS)]
    cells = nodes.select("node", *(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(names)))
    # Rows go twice, with their histograms: once to be joined, once dealt.
    rounds = _rounds(keyed.count() * 16 * (6 + CELLS), nodes.agg(F.sum("size") * 8).first()[0])

    def dealt(k: int) -> DataFrame:
        now = keyed.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        return dealt_buckets(now.select("key", F.col("size").alias("fp"), "node", "root", F.col("place").cast("long").alias("place")).join(cells, "node"), BUCKET)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, cell), (size, node, root, place, *held) in whole_groups(batches, ("key", "cell"), ("fp", "node", "root", "place", *names)):
            group, bars = runs((key, cell)), np.stack(held, axis=1).view(np.uint8)
            ends = np.searchsorted(group, group, side="right")
            for i in range(len(node)):  # sizes rise in a group
                later = slice(i + 1, i + 1 + int(np.searchsorted(size[i + 1 : ends[i]], size[i] / similarity + 1e-6, side="right")))
                if later.start == later.stop:
                    continue
                both = np.minimum(size[i] - place[i], size[later] - place[later])  # at most, if this is the first shingle they share
                able = (root[later] != root[i]) & (both >= similarity * (size[i] + size[later] - both) - 1e-6)
                near = i + 1 + np.flatnonzero(able)
                both = most_shared(bars[i], bars[near])
                found = node[near[both >= similarity * (size[i] + size[near] - both) - 1e-6]]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found, node[i])), pa.array(np.maximum(found, node[i]))], ["u", "v"])

    listed = appended(docs.sparkSession, (dealt(k).select("key", "cell", "fp", "node", "root", "place", *names).mapInArrow(pairs, "u long, v long").distinct() for k in range(rounds)), "listed")
    able = written(listed.distinct(), "pairs")
    removed(listed)
    removed(keyed)
    enough = lambda both, a, b: both >= similarity * (a + b - both) - 1e-6
    held = _held(able, nodes.select("node", "size", F.col("fine").alias("value")))
    near = _compared(able, held, lambda n, m, a, b: enough(finely_shared(a.as_py(), b.as_py()), n, m), "near-pairs")
    removed(able, held)
    texts = _texts(docs, _held(near, nodes.select("node", "doc_id", "same")))
    whole = written(_sets(texts, width, ["node"], "node long").dropDuplicates(["node"]).select("node", (F.length("hashes") / 8).cast("long").alias("size"), F.col("hashes").alias("value")), "sets")
    removed(texts)

    def alike(n: int, m: int, *pair: pa.Scalar) -> bool:
        shared = len(np.intersect1d(*(np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in pair), assume_unique=True))
        return shared >= similarity * (n + m - shared)

    return _compared(near, whole, alike, "missed")


def _held(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of nodes that are in pairs (u, v), written."""
    return written(rows.join(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "node", "left_semi"), "held")


def _rooted(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, sha, root (a node), component_id of each row of docs."""
    found = written(sketches(docs, width, similarity).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    firsts = [F.first(c).alias(c) for c in ("size", "fp", "keys", "first", "cells", "fine")]
    nodes = written(found.groupBy("same").agg(F.min("rid").alias("node"), F.min("doc_id").alias("doc_id"), *firsts), "nodes")
    known = written(found.select("doc_id", "sha", "same"), "known")
    removed(found)
    clusters = alone(lambda: connected(_candidates(nodes), "clusters"), "clusters")
    both = clusters.union(clusters.select(F.col("root").alias("node"), "root")).distinct()
    members = nodes.drop("keys", "first", "cells", "fine").join(both, "node")
    near = alone(lambda: connected(_verified_links(docs, members, width, similarity), "near"), "near")
    rooted = nodes.drop("keys").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    missed = alone(lambda: _missed(docs, rooted, width, similarity), "missed")
    few = written(nodes.select("same", "node", "doc_id"), "few")
    removed(nodes, clusters)
    roots = connected(near.select(F.col("node").alias("u"), F.col("root").alias("v")).union(missed), "joined")
    placed = few.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = placed.join(least, "root").select("same", "root", "component_id")
    return known.join(by_set, "same").select("doc_id", "sha", "root", "component_id")


def components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the least doc_id reachable by links)."""
    return alone(lambda: _rooted(docs, width, similarity).select("doc_id", "component_id"), "components")


def deduplicate(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each component, with all columns: the one with the least doc_id, and of rows that repeat it, the least text hash."""
    rooted = alone(lambda: _rooted(docs, width, similarity).select("doc_id", "sha", "root"), "rooted")
    out = one_of_each(docs, rooted)  # which writes its own copy
    removed(rooted)
    return out
