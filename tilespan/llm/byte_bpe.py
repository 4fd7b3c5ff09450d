"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of more than CHUNK characters is cut into chunks that run OVERLAP characters into the next. Each chunk is
pre-tokenised on its own, from a start that need not be a boundary. Matching depends on what follows only, so once
two neighbours have a boundary in common they agree from there on: the first common boundary in the overlap is
where they are stitched. From a chunk that has none with its predecessor on, the rest of the text is read again from the
last stitch, as one piece. The stitched pieces are encoded by the ranks, and decoding joins the tokens' raw bytes.

Defined cases: a null text is the empty text, with no tokens; rows with the same doc_id are encoded each by itself;
an empty table gives an empty result; other columns are ignored. The rank file must be at the same path on all
machines, as the tokenizers' package puts it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespan.llm.common import in_slices, map_slices, written

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 32768
OVERLAP = 1024
#: Characters before a chunk's end in which a match may depend on what follows the chunk ("'ll" is the longest such).
MARGIN = 4
#: Pieces that a worker remembers at most.
REMEMBERED = 200_000


class Codec:
    """Encodes pieces by ranks, remembering pieces it has met."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.match = regex.compile(pattern)
        self.size = max(self.ranks.values()) + 1
        self.raw: list[bytes] = [b""] * self.size
        for token, i in self.ranks.items():
            self.raw[i] = token
        self.text = [str(i) for i in range(self.size)]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """The ids of each match of the pattern, in order."""
        known, ranks = self.known, self.ranks
        out = []
        for x in self.match.findall(text):
            ids = known.get(x)
            if ids is None:
                b = x.encode()
                ids = (ranks[b],) if b in ranks else tuple(self.piece(b))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(x) <= 64:
                    known[x] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def starts(self, text: str, last: bool) -> list[int]:
        """Starts of the matches that no text after this one can change; last: nothing follows."""
        sure = len(text) if last else len(text) - MARGIN
        return [0, *(m.end() for m in self.match.finditer(text) if m.end() < sure)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _whole(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """rid, doc_id, part, ids (decimal, joined by commas), raw, n_tokens of each row's text, encoded in one go."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        counts, ids_sha, raw_sha = [], [], []
        for text in batch.column("text").to_pylist():
            ids = c.encode(text or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(c.text.__getitem__, ids)).encode()).hexdigest())
            raw_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(docs, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")


def _boundaries(chunks: DataFrame, path: str, pattern: str, overlap: int) -> DataFrame:
    """rid, part, at, head and tail: match starts in the overlap with the chunk before and after, as places in the text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        heads, tails = [], []
        for text, at, size, last in zip(*(batch.column(k).to_pylist() for k in ("text", "at", "size", "last")), strict=True):
            starts = c.starts(text, last)
            heads.append([at + s for s in starts if s < overlap])
            tails.append([] if last else [at + s for s in starts if s >= size])
        kinds = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("part"), batch.column("at"), pa.array(heads, kinds), pa.array(tails, kinds)], ["rid", "part", "at", "head", "tail"])

    return map_slices(chunks, each, "rid long, part int, at long, head array<long>, tail array<long>", "text")


def _spans(bounds: DataFrame) -> DataFrame:
    """rid, first, until: the stitched spans, from one common boundary to the next (until null: to the end)."""
    w = Window.partitionBy("rid").orderBy("part")
    stitch = bounds.withColumn("first", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w)))))
    lost = F.max(F.col("first").isNull()).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = stitch.withColumn("lost", lost).where("not lost")
    return found.select("rid", "first", F.lead("first").over(Window.partitionBy("rid").orderBy("part")).alias("until"))


def _encoded(spans: DataFrame, path: str, pattern: str) -> DataFrame:
    """rid, first, n_tokens, ids, raw of stitched spans."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        counts, texts, raws = [], [], []
        for text in batch.column("text").to_pylist():
            ids = c.encode(text)
            counts.append(len(ids))
            texts.append(",".join(map(c.text.__getitem__, ids)))
            raws.append(c.decode(ids))
        return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("first"), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(raws, pa.binary())], ["rid", "first", "n_tokens", "ids", "raw"])

    return map_slices(spans, each, "rid long, first long, n_tokens long, ids string, raw binary", "text")


def _cut(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """rid, part, at, size, last, text: the chunks of long texts, each of which runs into the next, dealt over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        for batch in in_slices(batches, "text"):
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = range(0, len(text), chunk)
                for k in range(0, len(starts), 64):
                    rows = [(rid, at // chunk, at, chunk, at + chunk + overlap >= len(text), text[at : at + chunk + overlap]) for at in starts[k : k + 64]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "part", "at", "size", "last", "text"])

    return long.select("rid", "text").mapInArrow(run, "rid long, part int, at long, size long, last boolean, text string").repartition("rid", "part")


def _cut_again(spans: DataFrame, long: DataFrame) -> DataFrame:
    """rid, first, text of stitched spans, dealt over tasks; a text meets its spans' starts once."""
    starts = spans.groupBy("rid").agg(F.array_sort(F.collect_list("first")).alias("starts"))  # a number for each chunk of a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            for rid, text, firsts in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                ends = [*firsts[1:], len(text)]
                for k in range(0, len(firsts), 64):
                    rows = [(rid, a, text[a:b]) for a, b in zip(firsts[k : k + 64], ends[k : k + 64], strict=True) if b > a or a == 0]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["rid", "first", "text"])

    return long.join(starts, "rid").select("rid", "text", "starts").mapInArrow(run, "rid long, first long, text string").repartition("rid", "first")


def pieces(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """rid, doc_id, first, n_tokens, ids, raw: the encoded spans of the texts longer than a chunk, ordered by first."""
    long = written(docs.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "long-texts")
    spans = _spans(_boundaries(_cut(long, chunk, overlap), path, pattern, overlap))
    return _encoded(_cut_again(spans, long), path, pattern).join(long.select("rid", "doc_id"), "rid")


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    path = path or public_tokenizers.path(RANKS)
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = pieces(docs, path, pattern, chunk, overlap)
    lists = spans.groupBy("rid", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("first", "ids", "raw"))).alias("s"))
    ids = F.array_join(F.filter(F.transform("s", lambda x: x.ids), lambda x: x != ""), ",")
    raw = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x.raw))
    stitched = lists.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256"))
    return _whole(short, path, pattern).union(stitched)
