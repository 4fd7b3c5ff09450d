"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits over the XXH64 hashes of word shingles. Two fingerprints at 2 or fewer differing bits
agree in at least two of four 16-bit bands, so every link meets in one of six buckets keyed by a pair of bands.
In a bucket the fingerprints stand as vertical bit planes, 64 lanes to a word. For each shift d the planes are
compared with themselves d lanes on: xor gives 64 pairs' differences in a bit at once, carry-save counters add
them up, and words whose lanes all exceed the radius are abandoned. Each bucket gives a spanning forest, not all
pairs; components are then joined by shuffles.

Buckets of more than BUCKET distinct fingerprints are dealt into chunks, and each pair of chunks is a bucket of
its own, so that no task holds a hot one whole. Copies share a fingerprint and count once.

Defined cases: a null text is the empty text; texts without words have fingerprint zero and link like any other;
a null doc_id takes part and sorts above all others; an empty table gives an empty result; other columns are
ignored by `components` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespan.llm.common import connected, map_slices, unused, utf8, written

RADIUS = 2
SEED = 42
#: Most distinct fingerprints in a bucket that is compared as one.
BUCKET = 4096
BANDS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a UTF-8 text; bytes.lower() changes A-Z only, and bytes.split() splits at ASCII white space only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)), len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, sha (of the text), fp (the 64 bits as a signed long)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, width) for x in utf8(batch, "text").to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.array(fps.view(np.int64))], ["doc_id", "sha", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return map_slices(source, each, "doc_id long, sha string, fp long", "text")


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words + 1) bit planes of uint64 fingerprints; lane i of word w is fingerprint 64 w + i; the last word is empty."""
    lanes = -(-len(fps) // 64) * 64
    padded = np.zeros(lanes, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([packed, np.zeros((64, 1), dtype=np.uint64)], axis=1)


def _hits(planes: np.ndarray, valid: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Positions p of valid lanes at which fingerprints p and p + shift differ in radius bits or fewer."""
    words, off = divmod(shift, 64)
    here = np.flatnonzero(valid)
    alive = valid[here]
    stages = radius.bit_length()
    counts = [np.zeros(len(here), dtype=np.uint64) for _ in range(stages)]
    over = np.zeros(len(here), dtype=np.uint64)  # carry out of the counters
    last, low, high = planes.shape[1] - 1, np.uint64(off), np.uint64(64 - off)
    for b in range(64):
        row = planes[b]
        other = row[np.minimum(here + words, last)]
        if off:
            other = (other >> low) | (row[np.minimum(here + words + 1, last)] << high)
        carry = row[here] ^ other
        for k in range(stages):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over |= carry
        if b % 8 == 7:
            near = alive & ~over & _at_most(counts, radius)
            keep = near != 0
            if not keep.all():
                if not keep.any():
                    return np.zeros(0, dtype=np.int64)
                here, alive, over = here[keep], alive[keep], over[keep]
                counts = [c[keep] for c in counts]
    near = alive & ~over & _at_most(counts, radius)
    bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return here[at] * 64 + lane


def _at_most(counts: list[np.ndarray], most: int) -> np.ndarray:
    """Lanes whose counter, lowest plane first, is at most `most`."""
    less, same = np.zeros_like(counts[0]), np.full_like(counts[0], _FULL)
    for k in reversed(range(len(counts))):
        if most >> k & 1:
            less |= same & ~counts[k]
            same = same & counts[k]
        else:
            same = same & ~counts[k]
    return less | same


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b in label, where label[i] <= i names i's class by its least member."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def bucket_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (child, representative) that join, in each run of equal `group`, all fingerprints connected within the radius."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return order, order
    sizes = sizes[order]
    first = np.r_[0, np.cumsum(sizes)]
    total = int(first[-1])
    take = np.repeat(starts[order] - first[:-1], sizes) + np.arange(total)
    fps = fps[take]
    planes = _planes(fps)
    words = planes.shape[1] - 1
    room = np.repeat(first[1:], sizes) - np.arange(total)  # fingerprints from here to the end of the bucket
    label = np.arange(total)
    for shift in range(1, int(sizes[0])):
        upto = int(first[np.searchsorted(-sizes, -shift, side="left")])  # larger buckets come first
        lanes = np.zeros(words * 64, dtype=np.uint8)
        lanes[:upto] = room[:upto] > shift
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        hits = _hits(planes, valid, shift, radius)
        if len(hits):
            _union(label, hits, hits + shift)
    child = np.flatnonzero(label != np.arange(total))
    return take[child], take[label[child]]


def runs(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """A number for each run of equal keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, ...], rows: int = 1 << 16) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Key and value columns of long columns sorted by their keys, some `rows` at a time, no group of equal keys cut."""
    names = (*keys, *values)
    held = [np.zeros(0, dtype=np.int64) for _ in names]
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names, strict=True)]
        if len(held[0]) < rows:
            continue
        group = runs(tuple(held[: len(keys)]))
        whole = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if whole:
            yield [h[:whole] for h in held[: len(keys)]], [h[:whole] for h in held[len(keys) :]]
            held = [h[whole:] for h in held]
    if len(held[0]):
        yield held[: len(keys)], held[len(keys) :]


def dealt_buckets(keyed: DataFrame, bucket: int) -> DataFrame:
    """Rows (key, fp, ...) with a cell, sorted by key and cell; keys of more than `bucket` rows are dealt into pairs of chunks."""
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    parts = F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1)).cast("int")
    cells = keyed.join(hot, "key", "left").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64(*(c for c in keyed.columns if c != "key")), F.col("parts")).cast("int")).drop("n")
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("cell", (F.least("mine", "other") * 65536 + F.greatest("mine", "other")).cast("long")).drop("parts", "mine", "other")
    return cells.repartition(F.col("key"), F.col("cell")).sortWithinPartitions("key", "cell", "fp")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fp (distinct longs) -> u, v: links that connect all fingerprints within the radius."""
    if not 1 <= radius <= 2:
        raise ValueError("four bands in pairs serve a radius of 1 or 2")
    band = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.struct((F.lit(t * (1 << 32)) + F.shiftleft(band[b], 16) + band[a]).alias("key")) for t, (a, b) in enumerate(BANDS)]
    dealt = dealt_buckets(fps.select("fp", F.inline(F.array(*keys))), bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, cell), (fp,) in whole_groups(batches, ("key", "cell"), ("fp",)):
            u, v = bucket_links(fp.view(np.uint64), runs((key, cell)), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

    return dealt.select("key", "cell", "fp").mapInArrow(run, "u long, v long").distinct()


def _rooted(docs: DataFrame, width: int, radius: int, bucket: int) -> DataFrame:
    """doc_id, sha, fp, root (a fingerprint), component_id of each row of docs."""
    prints = written(fingerprints(docs, width), "prints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(groups.select("fp"), radius, bucket), "prints-links")
    joined = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(joined.join(least, "root").select("fp", "root", "component_id"), "fp")


def components(docs: DataFrame, width: int = 5, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the least doc_id reachable by links)."""
    return _rooted(docs, width, radius, bucket).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of docs with the least doc_id (null last), then the least hash of its text, of each root; rooted: doc_id, sha, root."""
    sha, at, stay = unused(docs.columns, "sha", "at", "stay")
    rooted = written(rooted.select("doc_id", "sha", "root"), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "sha")).alias("s")).select(F.col("s.doc_id").alias(at), F.col("s.sha").alias(stay))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = keyed.join(first, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(sha) == F.col(stay)), "left_semi")
    # Only where rows repeat both, one has to be picked, for which whole rows move once more.
    if rooted.groupBy("doc_id", "sha").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found.drop(sha)
    return found.dropDuplicates(["doc_id", sha]).drop(sha)


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of docs for each component, with all columns: the one with the least doc_id, and of rows that repeat it, the least text hash."""
    return one_of_each(docs, _rooted(docs, width, RADIUS, BUCKET))
