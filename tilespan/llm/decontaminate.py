"""Benchmark decontamination with suffix arrays of the training texts.

Documents are cut into shards of bounded bytes, each in one task. A shard's words are numbered by the vocabulary of
the test items (all other words end a match and cannot begin one, so suffixes that start there are left out), and its
suffixes are sorted: first by as many words as fit 63 bits, then by doubling within what is still tied, as deep as the
longest item. Every suffix of every item is binary-searched in the array: its neighbours there give the longest
verbatim match and where it lies. Suffixes that match a whole window (WINDOW words; an item of fewer words is one
window) get the interval of the array that holds all its occurrences, and these mark the documents' words.

A document lies in one shard whole, so what is found is summed up where it is: texts are read once and not shuffled.
Items go to the tasks in blocks of at most about BLOCK bytes, long ones in pieces that overlap by a window less one
word; with several blocks there is a pass over the texts for each, and the passes' spans are united by row.

Defined cases: a null or empty text has no words and is never hit, as a document or as an item; letters A-Z are
lower-cased, words are runs of digits, letters a-z and characters beyond ASCII; rows that repeat a doc_id are documents
of their own; items that repeat an item_id are one item, a null item_id counts as the empty string; an empty table of
documents gives an empty result, an empty benchmark hits nothing; other columns are ignored by `hits` and
`longest_matches` and kept by `clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespan.llm.common import in_slices, map_slices, unused, utf8, written

WINDOW = 10
#: Bytes of text in a shard (a longer text is a shard of its own).
SHARD = 12 << 20
#: Bytes of test words that go to the tasks at once.
BLOCK = 16 << 20
#: Words of an item in one piece.
PIECE = 8192
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a binary array, and the number of words before each text (one more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    offsets -= first
    data = np.frombuffer(bytes(memoryview(texts.buffers()[2])[first:last]).translate(_LOWER), dtype=np.uint8) if last > first else np.zeros(0, np.uint8)
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, offsets)
    kept = np.cumsum(inside, dtype=np.int64)
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return found, before


def suffix_array(ids: np.ndarray, bits: int, deepest: int) -> np.ndarray:
    """Positions of words with an id over 0 in the order of what follows up to a 0, told apart to `deepest` words; ids end with a 0 and are below 2**bits."""
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    depth = max(1, 63 // bits)
    key = np.zeros(len(at), dtype=np.int64)
    alive = np.ones(len(at), dtype=bool)
    for k in range(depth):
        word = ids[np.minimum(at + k, len(ids) - 1)] * alive
        alive &= word > 0
        key = (key << bits) | word
    order = np.argsort(key, kind="stable")
    key = key[order]
    # A rank is one more than the place of the first suffix that is not yet told from it; 0: no word.
    new = np.append(True, key[1:] != key[:-1])
    rank = np.zeros(len(ids), dtype=np.int64)
    rank[at[order]] = np.maximum.accumulate(np.where(new, np.arange(1, len(at) + 1), 0))
    array = at[order]
    open_ = np.ones(len(ids), dtype=bool)  # whether the suffix goes on beyond the depth reached
    open_[at] = alive
    tied = ~new | ~np.append(new[1:], True)
    while depth < deepest and tied.any():
        places = np.flatnonzero(tied)
        here = array[places]
        follow = np.where(open_[here], rank[np.minimum(here + depth, len(ids) - 1)], 0)
        group = rank[here]
        again = np.lexsort((follow, group))
        here, follow, group = here[again], follow[again], group[again]
        array[places] = here
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        rank[here] = np.maximum.accumulate(np.where(new, places + 1, 0))
        reach = np.minimum(here + depth, len(ids) - 1)
        open_[here] = (follow > 0) & open_[reach]
        still = ~new | ~np.append(new[1:], True)
        tied[places] = still & open_[here]
        depth *= 2
    return array


def _compare(ids: np.ndarray, at: np.ndarray, tests: np.ndarray, first: np.ndarray, most: np.ndarray, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """How many words of the suffixes at `at` equal those of the test suffixes, to `most` at most, and whether the former sort before."""
    same = np.zeros(len(at), dtype=np.int64)
    less = np.zeros(len(at), dtype=bool)
    todo = np.arange(len(at))
    while len(todo):
        k = same[todo][:, None] + np.arange(step)
        a = ids[np.minimum(at[todo][:, None] + k, len(ids) - 1)]
        b = tests[np.minimum(first[todo][:, None] + k, len(tests) - 1)]
        left = most[todo][:, None] > k
        stop = (a != b) | (a == 0) | ~left
        ends = stop.any(axis=1)
        n = np.where(ends, stop.argmax(axis=1), step)
        rows = np.arange(len(todo))
        col = np.minimum(n, step - 1)
        less[todo] = ends & left[rows, col] & (a[rows, col] < b[rows, col])
        same[todo] += n
        todo = todo[~ends]
    return same, less


def _search(ids: np.ndarray, array: np.ndarray, tests: np.ndarray, first: np.ndarray, most: np.ndarray, above: bool = False) -> np.ndarray:
    """Where each test suffix, cut to `most` words, would go in the array: before all that begin with it, or (above) after them."""
    low, high = np.zeros(len(first), dtype=np.int64), np.full(len(first), len(array), dtype=np.int64)
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        middle = (low[todo] + high[todo]) // 2
        same, less = _compare(ids, array[middle], tests, first[todo], most[todo])
        right = less | (above & (same >= most[todo]))
        low[todo] = np.where(right, middle + 1, low[todo])
        high[todo] = np.where(right, high[todo], middle)


class Tests:
    """A block of test items: their vocabulary, their words as one array of ids (0 after each piece), and their windows."""

    def __init__(self, pieces: list[tuple[str, int, bytes]], window: int):
        self.window = window
        split = [p[2].split(b" ") for p in pieces]
        self.vocabulary = pa.array(sorted({w for s in split for w in s}), pa.binary())
        number = {w: i + 1 for i, w in enumerate(self.vocabulary.to_pylist())}
        self.bits = max(1, len(number).bit_length())
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        self.ids = np.array([n for s in split for n in (*(number[w] for w in s), 0)], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        self.items = [p[0] for p in pieces]
        #: Of each suffix: where it starts, its piece, its place in the item, its length.
        self.first = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)])
        self.piece = np.repeat(np.arange(len(pieces)), sizes)
        self.place = self.first - starts[self.piece] + np.array([p[1] for p in pieces], dtype=np.int64)[self.piece]
        self.length = sizes[self.piece] - (self.first - starts[self.piece])
        self.longest = int(sizes.max())
        # Windows: one for each distinct sequence, with the set of items that have it.
        begins = np.flatnonzero((self.length >= window) | (self.first == starts[self.piece]))
        owners: dict[bytes, set[str]] = {}
        where: dict[bytes, int] = {}
        for i in begins.tolist():
            key = self.ids[self.first[i] : self.first[i] + min(window, self.length[i])].tobytes()
            owners.setdefault(key, set()).add(self.items[self.piece[i]])
            where.setdefault(key, i)
        self.windows = np.array(list(where.values()), dtype=np.int64)
        self.size = np.minimum(self.length[self.windows], window)
        classes: dict[frozenset[str], int] = {}
        self.item_class = np.array([classes.setdefault(frozenset(o), len(classes)) for o in owners.values()], dtype=np.int64)
        self.classes = [sorted(c) for c in classes]


class Shard:
    """The suffix array of some documents over the words of some tests, and what the tests match in it."""

    def __init__(self, texts: pa.Array, tests: Tests):
        found, self.before = words_of(texts)
        self.n_words = np.diff(self.before)
        known = pc.index_in(found, value_set=tests.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # One 0 after each text.
        self.owner = np.repeat(np.arange(len(texts)), self.n_words + 1)
        self.shift = self.before[:-1] + np.arange(len(texts))
        self.ids = np.zeros(len(known) + len(texts), dtype=np.int64)
        self.ids[np.arange(len(known)) + np.repeat(np.arange(len(texts)), self.n_words)] = known
        self.array = suffix_array(self.ids, tests.bits, tests.longest)
        self.tests = tests

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every test suffix: the length of its longest match here, and the position of one."""
        t = self.tests
        size, where = np.zeros(len(t.first), dtype=np.int64), np.zeros(len(t.first), dtype=np.int64)
        if not len(self.array):
            return size, where
        for at in range(0, len(t.first), 1 << 14):
            some = slice(at, at + (1 << 14))
            place = _search(self.ids, self.array, t.ids, t.first[some], t.length[some])
            for near in (np.maximum(place - 1, 0), np.minimum(place, len(self.array) - 1)):
                same, _ = _compare(self.ids, self.array[near], t.ids, t.first[some], t.length[some])
                better = same > size[some]
                size[some] = np.where(better, same, size[some])
                where[some] = np.where(better, self.array[near], where[some])
        return size, where

    def marks(self) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
        """Which words (with the 0 after each text) lie in an occurrence of a window, and the items of each text that has any."""
        t = self.tests
        hit = np.zeros(len(self.ids) + 1, dtype=np.int64)
        size, _ = self.longest()
        there = np.flatnonzero(size[t.windows] >= t.size)
        if not len(there):
            return hit[:-1] > 0, []
        first, most = t.first[t.windows[there]], t.size[there]
        low, high = (_search(self.ids, self.array, t.ids, first, most, above) for above in (False, True))
        # Windows of one size have intervals that do not meet: no more occurrences than suffixes for each size.
        seen = []
        for n in np.unique(most):
            of = np.flatnonzero(most == n)
            counts = high[of] - low[of]
            total = int(counts.sum())
            at = self.array[np.repeat(low[of] - (np.cumsum(counts) - counts), counts) + np.arange(total)]
            hit[at] += 1
            hit[at + n] -= 1
            seen.append(np.unique(self.owner[at] * len(t.classes) + np.repeat(t.item_class[there[of]], counts)))
        pairs = np.unique(np.concatenate(seen))
        texts, starts = np.unique(pairs // len(t.classes), return_index=True)
        items = []
        for text, part in zip(texts.tolist(), np.split(pairs % len(t.classes), starts[1:]), strict=True):
            items.append((text, sorted(set().union(*(t.classes[c] for c in part.tolist())))))
        return np.cumsum(hit[:-1]) > 0, items


def _pieces(benchmark: DataFrame, window: int, piece: int) -> DataFrame:
    """item (item_id as text), start, words (space-joined) of items with words, long ones in overlapping pieces."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, before = words_of(utf8(batch, "text"))
        rows = []
        for i, item in enumerate(batch.column("item").to_pylist()):
            a, b = int(before[i]), int(before[i + 1])
            for s in range(a, max(a + 1, b - window + 1) if b > a else a, piece - window + 1):
                rows.append((item, s - a, b" ".join(found.slice(s, min(piece, b - s)).to_pylist())))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["item", "start", "words"])

    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return map_slices(source, each, "item string, start long, words binary", "text")


def _blocks(benchmark: DataFrame, window: int, block: int, piece: int) -> Iterator[Tests]:
    """The tests, in blocks of about `block` bytes: dealt by hash, so that what comes to the driver at once is bounded."""
    found = written(_pieces(benchmark, window, max(piece, 2 * window)).distinct(), "test-pieces")
    total = found.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0
    n = -(-total // block)
    for k in range(n):
        rows = found.where(F.pmod(F.xxhash64("item", "start", "words"), F.lit(n)) == k).sort("item", "start", "words").collect()
        if rows:
            yield Tests([(r.item, r.start, bytes(r.words)) for r in rows], window)


def _spans(hit: np.ndarray, owner: np.ndarray, before: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs of hit words by text, as places of words in it."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        out.setdefault(int(owner[a]), []).append((a - int(before[owner[a]]), b - int(before[owner[a]])))
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `shard` bytes of text, or one row."""
    held, size = [], 0
    for part in in_slices(batches, "text", shard):
        n = part.column("text").nbytes
        if held and size + n > shard:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_FOUND = "rid long, doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
_FOUND_ARROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _scan(docs: DataFrame, tests: Tests | None, shard: int) -> DataFrame:
    """rid, doc_id, n_words, the hit spans and the items of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, shard):
            spans: list[list[dict[str, int]]] = [[] for _ in range(part.num_rows)]
            items: list[list[str]] = [[] for _ in range(part.num_rows)]
            if sent.value is None:
                counts = np.diff(words_of(utf8(part, "text"))[1])
            else:
                here = Shard(utf8(part, "text"), sent.value)
                counts = here.n_words
                hit, of = here.marks()
                for text, names in of:
                    items[text] = names
                for text, runs in _spans(hit, here.owner, here.shift).items():
                    spans[text] = [{"a": a, "b": b} for a, b in runs]
            columns = [part.column("rid"), part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, _FOUND_ARROW.field("spans").type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, schema=_FOUND_ARROW)

    return docs.mapInArrow(run, _FOUND)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def found_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """rid, doc_id, n_words, spans (of hit words, in order, apart) and items (sorted as text) of each row of docs (rid, doc_id, text)."""
    blocks = _blocks(benchmark, window, block, piece)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _scan(docs, first, shard)
    docs = written(docs, "texts")  # several passes: ids of rows have to stay
    out = written(_scan(docs, first, shard), "hits")
    while second is not None:
        out = out.union(written(_scan(docs, second, shard), "hits"))
        second = next(blocks, None)
    merged = out.groupBy("rid", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr("aggregate(all, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, x) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1).b >= x.a THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))) ELSE concat(acc, array(x)) END)")
    return merged.select("rid", "doc_id", "n_words", joined.alias("spans"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items, contaminated, spans."""
    found = found_spans(_rows(docs), benchmark, **sizes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x.b - x.a)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", (F.size("spans") > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """The rows of docs that no window occurs in, with all their columns."""
    (rid,) = unused(docs.columns, "rid")
    kept = written(docs.withColumn(rid, F.monotonically_increasing_id()), "texts")
    found = found_spans(kept.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **sizes)
    bad = found.where(F.size("spans") > 0).select(F.col("rid").alias(rid))
    return kept.join(bad, rid, "left_anti").drop(rid)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """item_id (as text), item_at, length, doc_id, doc_at: of each place in an item where a match of a window begins, its longest match in
    all documents and one location of it (the least doc_id of the shards' locations). A match is followed to the end of the item's piece."""
    kinds = "item_id string, item_at long, length long, doc_id long, doc_at long"
    schema = pa.schema([("item_id", pa.string()), ("item_at", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("doc_at", pa.int64())])
    spark = docs.sparkSession

    def scan(tests: Tests) -> DataFrame:
        sent = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _shards(batches, shard):
                t, here = sent.value, Shard(utf8(part, "text"), sent.value)
                size, where = here.longest()
                at = np.flatnonzero((size >= t.window) | ((size == t.length) & (t.place == 0)))
                text = here.owner[where[at]]
                names = [t.items[p] for p in t.piece[at].tolist()]
                ids = part.column("doc_id").take(pa.array(text, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(t.place[at]), pa.array(size[at]), ids, pa.array(where[at] - here.shift[text])], schema=schema)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)

    out = None
    for tests in _blocks(benchmark, window, block, piece):
        one = written(scan(tests), "matches")
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], kinds)
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_at"))
    return out.groupBy("item_id", "item_at").agg(best.alias("m")).select("item_id", "item_at", (-F.col("m.l")).alias("length"), F.col("m.doc_id").alias("doc_id"), F.col("m.doc_at").alias("doc_at"))
