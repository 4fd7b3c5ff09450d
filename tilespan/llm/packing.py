"""Best-fit packing with certified bin counts.

Texts become token ids; a document longer than a sequence is cut into full pieces and a last one. Full pieces are
sequences of their own. The others are dealt evenly over partitions, each packed by best-fit decreasing. Dual-
feasible functions give each partition a lower bound on the sequences any packing of it needs: where the count
equals the bound, the partition is done. Partitions with a gap, and every partition's unfilled sequences, exchange
their pieces and are packed again; a repacking that does not save sequences is dropped.

Only lengths are packed: ids stay where they were made, as a checksum. Best-fit decreasing runs on (doc_id, piece,
length) rows of PART pieces at most.

Defined cases: a null text is the empty text, whose one token is the end; rows that repeat a doc_id are packed each
by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilespan.llm.common import map_slices, utf8, written

VOCABULARY = "word_bpe_49k.json"
END = 1
CAPACITY = 4096
#: Pieces that are packed in one task at most (on average).
PART = 32768
REMEMBERED = 200_000
ROUNDS = 3
_END_OF_WORD = b"\xff"
#: Marks that are often behind words; no apostrophe, with which matches of more than marks begin.
_MARKS = b".,;:!?)\"#$%&*"


class WordEncoder:
    """Ids of a lower-casing BPE with word ends, by white-space-delimited words that it remembers.

    No match of the vocabulary's own pattern goes across ASCII white space, so a text's ids are its words' ids in
    turn. A word that is new and plain is merged by ranks: the word end stands as byte 0xFF, which UTF-8 never has,
    and its pairs have the lowest ranks, so it joins the last byte first, as in the vocabulary. Words with bytes
    that the vocabulary's special tokens or normaliser treat specially go through the tokenizers library.
    """

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.match = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        byte = {c: b for b, c in shown.items()}
        ranks = {}
        for token, i in self.slow.get_vocab().items():
            if not (token.startswith("<|") and token.endswith("|>")):
                word = token.removesuffix("</w>") if len(token) > 4 else token
                ranks[bytes(byte[c] for c in word) + (_END_OF_WORD if word != token else b"")] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.plain = re.compile(r"[\x00-\x7fÀ-ž]*").fullmatch
        self.letters = re.compile("(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+".encode("latin-1")).fullmatch  # of ASCII and À to ÿ, in UTF-8
        self.packed = lambda ids: pack(f"<{len(ids)}I", *ids)
        self.known: dict[bytes, bytes] = {}

    def _new(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone are one match of the pattern
            made = self.packed(self.merge(word.lower() + _END_OF_WORD))
        elif word[-1:] in _MARKS and self.letters(stem := word.rstrip(_MARKS)):  # and marks after letters are one more
            marks = word[len(stem) :]
            made = (self.known.get(stem) or self._new(stem)) + (self.known.get(marks) or self._new(marks))
        else:
            made = self.packed(self._ids(word))
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = made
        return made

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode()
        if b"<|" in word or not self.plain(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        low = text.lower()
        return [i for m in ([low] if low.isalpha() else self.match.findall(low)) for i in self.merge(m.encode() + _END_OF_WORD)]

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian unsigned 32-bit numbers."""
        known, new = self.known.get, self._new
        return b"".join([known(w) or new(w) for w in text.split()])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of docs."""
    path = path or public_tokenizers.path(VOCABULARY)
    width = 4 * capacity
    end = np.array([END], dtype="<u4").tobytes()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).encode
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text").to_pylist(), strict=True):
            ids = encode(text) + end
            rows += [(doc, at // width, at // 4, min(width, len(ids) - at) // 4, zlib.crc32(ids[at : at + width])) for at in range(0, len(ids), width)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, piece int, start long, length long, ids_crc32 long", "text")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, taken in falling order into the fullest bin with room; and the number of bins."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    rooms: list[int] = []  # the rooms that some bin has, rising
    having: dict[int, list[int]] = {}
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = having[room].pop()
            if not having[room]:
                del having[room]
                rooms.pop(k)
        else:
            b, room, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - n:
            if left not in having:
                having[left] = []
                insort(rooms, left)
            having[left].append(b)
    return bins, offsets, used


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs of counts[n] pieces of n tokens each; the capacity is the last n.

    The best of two families of dual-feasible functions: f_a drops lengths below a and rounds those above
    capacity - a up to the whole; u_k maps x to x where (k + 1) x is a multiple of the capacity, else to
    floor((k + 1) x / capacity) capacity / k. The plain sum is the third.
    """
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    total = int((counts * size).sum())
    best = -(-total // capacity)
    upto_sum, upto_n = np.cumsum(counts * size), np.cumsum(counts)
    a = np.arange(1, capacity // 2 + 1)
    middle = upto_sum[capacity - a] - upto_sum[a - 1]
    whole = upto_n[capacity] - upto_n[capacity - a]
    if len(a):
        best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 31):
        up = (k + 1) * size
        scaled = np.where(up % capacity == 0, size * k, up // capacity * capacity)  # times k
        best = max(best, -(-int((counts * scaled).sum()) // (capacity * k)))
    return best


def _packed_once(rows: DataFrame, parts: int, capacity: int, seed: int) -> DataFrame:
    """rows (id, length, ...) with part, bin, offset, bins (of the part) and bound (on them)."""
    schema = "id long, length long, part int, bin long, offset long, bins long, bound long"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id"], ascending=[False, True])
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        return pd.DataFrame({"id": pdf["id"], "length": lengths, "part": pdf["part"], "bin": bins, "offset": offsets, "bins": used, "bound": lower_bound(np.bincount(lengths, minlength=capacity + 1))})

    dealt = rows.select("id", "length", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, schema)


def _bound(rows: DataFrame, capacity: int) -> int:
    """lower_bound of all rows together: only counts by length, capacity of them at most, come to the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound(counts)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    made = written(pieces(docs, path, capacity).withColumn("id", F.monotonically_increasing_id()), "pieces")
    loose = made.where(F.col("length") < capacity).select("id", "length")
    parts = max(1, -(-loose.count() // part))

    def numbered(rows: DataFrame, k: int) -> DataFrame:
        return rows.select("id", "offset", (F.lit(k << 56) + F.col("part").cast("long") * (1 << 24) + F.col("bin")).alias("sequence_id"))

    done = made.where(F.col("length") == capacity).select("id", F.lit(0).cast("long").alias("offset"), (-1 - F.col("id")).alias("sequence_id"))
    now = written(_packed_once(loose, parts, capacity, 0), "packed")
    for k in range(rounds):
        filled = now.groupBy("part", "bin").agg(F.sum("length").alias("held"), F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        # To be exchanged: a part's unfilled sequences where its count is above its bound, else its emptiest one.
        emptiest = filled.groupBy("part").agg(F.min_by("bin", F.struct("held", "bin")).alias("emptiest"))
        given = filled.join(emptiest, "part").where((F.col("held") < capacity) & ((F.col("bins") > F.col("bound")) | (F.col("bin") == F.col("emptiest")))).select("part", "bin")
        pool = written(now.join(given, ["part", "bin"], "left_semi"), "pool")
        before, size = given.count(), pool.count()
        if before <= _bound(pool, capacity):  # no packing of these pieces needs fewer sequences
            break
        again = written(_packed_once(pool.select("id", "length"), max(1, -(-size // part)), capacity, k + 1), "packed")
        if again.select("part", "bin").distinct().count() >= before:
            break
        done = done.union(numbered(now.join(given, ["part", "bin"], "left_anti"), k))
        now = again
    else:
        k = rounds
    placed = done.union(numbered(now, k))
    return made.join(placed, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
