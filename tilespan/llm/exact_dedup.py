"""Exact deduplication by content-defined chunk recipes.

Texts are cut into chunks where a rolling gear hash of the last 32 bytes meets a mask, so equal texts get equal
chunks. A chunk's 128-bit fingerprint becomes a verified identifier once all bytes seen under it are known to be
the same; where they differ, the identifier also carries a variant number. A document is then the ordered list of
its identifiers, and lists, not texts, are shuffled, grouped and joined. Chunk bytes move once, to be verified.

Defined cases: a null text is the empty text (an empty recipe); texts are compared byte for byte in UTF-8; a null
doc_id sorts below all others; of rows that repeat doc_id and text, one stays; an empty table gives an empty
result; other columns of the input are ignored by `decisions` and kept by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespan.llm.common import map_slices, unused, utf8, written

MIN_CHUNK = 512
MASK_BITS = 11
MAX_CHUNK = 16384
#: Bytes of a fingerprint, short only in tests.
FP_BYTES = 16
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


def _candidates(data: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Ends (exclusive) at which the gear hash of the last 32 bytes meets the mask."""
    found = []
    top = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))
    for at in range(0, len(data), block):
        lead = min(at, 31)
        h = _GEAR[data[at - lead : at + block]]
        for s in (1, 2, 4, 8, 16):
            h[s:] += h[:-s] << np.uint32(s)  # the right side is computed before it is added
        found.append(np.flatnonzero((h[lead:] & top) == 0) + at + 1)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _cuts(first: int, last: int, marks: list[int]) -> list[int]:
    """Chunk ends of the text in [first, last); marks: the candidates inside."""
    ends, at = [], first
    for m in [*marks, last]:
        while m - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if m - at >= MIN_CHUNK and m < last:
            ends.append(at := m)
    if last > at:
        ends.append(last)
    return ends


def chunked(texts: pa.Array) -> tuple[memoryview, list[tuple[int, list[int]]]]:
    """The bytes of a binary array, and each text's first byte and chunk ends in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    data = memoryview(texts.buffers()[2])[base:end] if end > base else memoryview(b"")
    marks = _candidates(np.frombuffer(data, dtype=np.uint8))
    near = np.searchsorted(marks, offsets - base, side="right")
    out = []
    for i in range(len(texts)):
        first, last = int(offsets[i]) - base, int(offsets[i + 1]) - base
        out.append((first, _cuts(first, last, marks[near[i] : near[i + 1]].tolist())))
    return data, out


def recipes(docs: DataFrame, fp_bytes: int = FP_BYTES) -> DataFrame:
    """doc_id, recipe (the chunks' fingerprints in order), text_sha256."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, cuts = chunked(utf8(batch, "text"))
        made = []
        for first, ends in cuts:
            parts = []
            for end in ends:
                parts.append(xxhash.xxh3_128_digest(data[first:end])[:fp_bytes])
                first = end
            made.append(b"".join(parts))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary()), batch.column("text_sha256")], ["doc_id", "recipe", "text_sha256"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return map_slices(source, each, "doc_id long, recipe binary, text_sha256 string", "text")


def chunks(docs: DataFrame, fp_bytes: int = FP_BYTES) -> DataFrame:
    """fp, content: the distinct chunks of each slice of rows."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, cuts = chunked(utf8(batch, "text"))
        seen: dict[tuple[bytes, bytes], None] = {}
        for first, ends in cuts:
            for end in ends:
                body = bytes(data[first:end])
                seen[xxhash.xxh3_128_digest(body)[:fp_bytes], body] = None
                first = end
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.binary())], ["fp", "content"])

    return map_slices(docs.select("text"), each, "fp binary, content binary", "text")


def _placed(docs: DataFrame, fp_bytes: int) -> DataFrame:
    """text_sha256, seq, fp, content of every chunk of every distinct text; used only if a fingerprint has two contents."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, cuts = chunked(utf8(batch, "text"))
        rows = []
        for sha, (first, ends) in zip(batch.column("text_sha256").to_pylist(), cuts, strict=True):
            for k, end in enumerate(ends):
                body = bytes(data[first:end])
                rows.append((sha, k, xxhash.xxh3_128_digest(body)[:fp_bytes], body))
                first = end
        names, kinds = ["text_sha256", "seq", "fp", "content"], [pa.string(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    source = docs.select("text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return map_slices(source, each, "text_sha256 string, seq int, fp binary, content binary", "text")


def verified_recipes(docs: DataFrame, fp_bytes: int = FP_BYTES) -> DataFrame:
    """rid, doc_id, recipe, variants, text_sha256: equal (recipe, variants) means equal texts."""
    plain = written(recipes(docs, fp_bytes).withColumn("rid", F.monotonically_increasing_id()), "recipes")
    known = chunks(docs, fp_bytes).distinct()
    doubtful = written(known.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "doubtful")
    if doubtful.isEmpty():
        return plain.withColumn("variants", F.lit(""))
    contents = chunks(docs, fp_bytes).join(doubtful, "fp", "left_semi").distinct()
    variant = contents.withColumn("variant", F.row_number().over(Window.partitionBy("fp").orderBy("content")))
    noted = _placed(docs, fp_bytes).join(variant, ["fp", "content"])
    lists = noted.groupBy("text_sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("seq", "variant"))), lambda x: F.concat_ws(":", x.seq, x.variant)), ",").alias("variants"))
    return plain.join(lists, "text_sha256", "left").withColumn("variants", F.coalesce("variants", F.lit("")))


def decisions(docs: DataFrame, fp_bytes: int = FP_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = verified_recipes(docs, fp_bytes)
    groups = rows.groupBy("recipe", "variants").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep")).where("group_size > 1")
    out = rows.join(groups, ["recipe", "variants"], "left")
    return out.select("doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    sha, at, stay = unused(docs.columns, "sha", "at", "stay")
    kept = decisions(docs).where("kept").select(F.col("doc_id").alias(at), F.col("text_sha256").alias(stay))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(sha) == F.col(stay)), "left_semi")
    return found.dropDuplicates(["doc_id", sha]).drop(sha)
