"""Toxicity classifier: a convolutional network over hashed word embeddings.

Words and their first four and five characters are hashed to rows of an embedding table, and a word's embedding is
the sum of its rows, so that unseen forms of a known stem are near it. Filters of several widths run over the whole text; each filter's
largest response, through a ReLU, is a feature of a logistic output. The network is trained in numpy with Adam on
all labelled rows and their whole texts but a part, HELD of them, which is kept out to calibrate: it sets the scale of the scores, and for each
language the threshold above which documents are flagged. Up to SAMPLE / 2 rows of either class are trained on by the driver. Where there
are more, the driver's network over START of them (the first by a hash of their doc_id) is where RATES passes over all rows begin: in each pass every task
goes on with Adam over its rows, weighted so that both classes count alike, and what the tasks moved is averaged, embeddings over the texts that
hold them; an embedding row counts if LEAST_TEXTS of all texts hold it. Margins of all rows kept out are counted in bins of 1 / BINS for the
calibration. Language is no input of a score. Labelled rows without a label or a
doc_id are left out, and of several labels for one doc_id the largest counts, of several texts the least. Only the word hashes of SAMPLE rows, a fixed number of
weights and the counts of margins come to the driver; the word hashes, whose bytes grow with the texts, come SENT bytes at a time and lie in a temporary file there.

Defined cases: a null text is the empty text and is scored as such; a language without enough labelled rows, or
null, has the threshold of all; rows that repeat a doc_id are scored each by itself; an empty table gives an empty
result; without rows of both classes every score is the share of label 1 (0 without any); other columns are kept by `score` unless they have
the name of one that it adds.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespan.llm.common import in_slices, map_slices, utf8, written

SAMPLE = 8000
START = 4000
RATES = (0.01, 0.004)
BINS = 64
HELD = 0.2
#: Bytes of word hashes, or one text's, that come to the driver at once.
SENT = 1 << 24
BUCKETS = 1 << 18
#: Texts in which an embedding row must occur; others stay zero, as nothing general is learnt of them.
LEAST_TEXTS = 3
WIDTH = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Gradient steps, and texts to a step, half of either class.
STEPS = 1500
BATCH = 16
#: Words of a text that are convolved at once.
BLOCK = 8192
#: Of each place of each filter, the filter and where in it the place is.
_COLUMN = np.concatenate([np.arange(k * FILTERS, (k + 1) * FILTERS) for k, w in enumerate(WIDTHS) for _ in range(w)])
_OFFSET = np.concatenate([np.full(FILTERS, d) for w in WIDTHS for d in range(w)])
_STRIP = b".,;:!?\"'()[]"


#: Words, and bytes of words, beyond which a worker forgets those that it has met before the next text.
REMEMBERED = 200_000
REMEMBERED_BYTES = 1 << 23
PARTS = 3


class Words(dict[bytes, int]):
    """The words that a worker has met, numbered from 0, and the embedding rows of each."""

    def __init__(self) -> None:
        self.rows, self.fresh, self.size = np.zeros((1 << 10, PARTS), dtype=np.int32), [], 0

    def __missing__(self, word: bytes) -> int:
        text, number = word.strip(_STRIP), len(self)
        if not text.isascii():
            text = text.decode()
            four, five, text = text[:4].encode(), text[:5].encode(), text.encode()
        else:
            four, five = text[:4], text[:5]
        self.fresh.append([zlib.crc32(x) % (BUCKETS - 1) + 1 for x in (text, b"4" + four, b"5" + five)])
        self.size += len(word)
        self[word] = number
        return number

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= REMEMBERED or self.size >= REMEMBERED_BYTES:
            self.clear()
            self.__init__()
        at = len(self)
        numbers = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.fresh:
            if len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows[:at], np.zeros((2 * len(self) - at, PARTS), dtype=np.int32)])
            self.rows[at : len(self)] = self.fresh
            self.fresh = []
        return self.rows.take(numbers, axis=0)


_known = Words()


def word_ids(text: bytes) -> np.ndarray:
    """The embedding rows of each word, lower-cased (A-Z) and without marks at its ends; row 0 stands after the text."""
    return _known.ids(text.lower().split())


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    base: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def places(self) -> np.ndarray:
        """The weights of each place of each filter: a row for each of _COLUMN and _OFFSET."""
        return np.concatenate([f[d].T for f in self.filters for d in range(len(f))])

    def pooled(self, ids: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter over a text, and, if asked for, where it begins."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, dtype=np.float32)
        where = np.zeros(len(best), dtype=np.int64)
        pad = np.zeros((max(WIDTHS) - 1, PARTS), dtype=np.int32)
        end = max(1, len(ids))
        ids = np.concatenate([ids if len(ids) else pad[:1], pad])
        every = self.places()
        for at in range(0, end, BLOCK):
            n = min(BLOCK, end - at)
            some = ids[at : at + n + len(pad)]
            seen = self.table.take(some[:, 0], axis=0)
            for k in range(1, PARTS):
                seen += self.table.take(some[:, k], axis=0)
            made, row = every @ seen.T, 0
            for k, w in enumerate(WIDTHS):
                sums = made[row : row + FILTERS, :n]
                for d in range(1, w):
                    row += FILTERS
                    sums = sums + made[row : row + FILTERS, d : d + n]
                row += FILTERS
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                if places:
                    top = sums.argmax(axis=1)
                    values = sums[np.arange(FILTERS), top] + self.biases[k]
                    where[part] = np.where(values > best[part], top + at, where[part])
                else:
                    values = sums.max(axis=1) + self.biases[k]
                best[part] = np.maximum(best[part], values)
        return best, where

    def margin(self, ids: np.ndarray) -> float:
        return float(np.maximum(self.pooled(ids, False)[0], 0) @ self.out + self.base)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(ids) + self.shift, -30, 30))))


def train(texts: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Network:
    """Fits a network by Adam on the log loss, a gradient for every BATCH texts, half of either class."""
    rng = np.random.default_rng(seed)
    net = Network(
        table=rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32),
        filters=[rng.normal(0, 1 / np.sqrt(w * WIDTH), (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS],
        biases=[np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        out=rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        base=0.0,
    )
    texts_with = np.zeros(BUCKETS, dtype=np.int64)
    for ids in texts:
        texts_with[np.unique(ids)] += 1
    known = texts_with >= min(LEAST_TEXTS, len(texts))
    known[0] = False
    net.table[~known] = 0
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in _weights(net).items()}
    classes = [c for c in (np.flatnonzero(y == 1), np.flatnonzero(y == 0)) if len(c)]
    turns = [np.concatenate([rng.permutation(c) for _ in range(-(-STEPS * BATCH // len(classes) // len(c)))]) for c in classes]
    for step in range(1, STEPS + 1):
        rate = 0.02 * (1 - step / (STEPS + 1))
        some = BATCH // len(classes)
        some = np.concatenate([t[(step - 1) * some : step * some] for t in turns])
        _step(net, state, known, [texts[i] for i in some], y[some], np.ones(len(some)), rate, step)
    return net


def _step(net: Network, state: dict, known: np.ndarray, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float, step: int) -> None:
    """One step along the gradient over some texts, each as its weight says; embeddings that are not known stay."""
    found = [net.pooled(ids) for ids in texts]
    best = np.stack([b for b, _ in found])
    pad = np.zeros((max(WIDTHS), PARTS), dtype=np.int32)
    rows = np.stack([np.concatenate([ids, pad]).take(where[_COLUMN] + _OFFSET, axis=0) for ids, (_, where) in zip(texts, found, strict=True)])
    act = np.maximum(best, 0)
    err = weight * (1 / (1 + np.exp(-np.clip(act @ net.out + net.base, -30, 30))) - y)
    back = np.where(best > 0, err[:, None] * net.out, 0)
    of_place = back[:, _COLUMN]
    grads: dict[str, np.ndarray] = {"out": (err @ act).astype(np.float32), "base": np.array([err.sum()])}
    moved = np.einsum("tpe,tp->pe", net.table[rows].sum(axis=2), of_place).astype(np.float32)
    at = 0
    for k, w in enumerate(WIDTHS):
        grads[f"bias{k}"] = back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0).astype(np.float32)
        grads[f"filter{k}"] = moved[at : at + w * FILTERS].reshape(w, FILTERS, WIDTH).transpose(0, 2, 1)
        at += w * FILTERS
    hit, which = np.unique(rows, return_inverse=True)
    pushes = np.repeat((net.places() * of_place[:, :, None]).reshape(-1, WIDTH), PARTS, axis=0)
    push = np.stack([np.bincount(which.ravel(), column, len(hit)) for column in pushes.T], axis=1).astype(np.float32)
    push[~known[hit]] = 0
    _adam(net, state, grads, hit, push, rate, step)


def _weights(net: Network) -> dict[str, np.ndarray]:
    return {"table": net.table, "out": net.out, "base": np.array([net.base]), **{f"filter{k}": f for k, f in enumerate(net.filters)}, **{f"bias{k}": b for k, b in enumerate(net.biases)}}


def _adam(net: Network, state: dict, grads: dict[str, np.ndarray], hit: np.ndarray, push: np.ndarray, rate: float, step: int) -> None:
    """One step; of the embeddings, only the rows that were hit move."""
    weights = _weights(net)
    fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    for k, w in weights.items():
        m, v = state[k]
        at = hit if k == "table" else slice(None)
        g = push if k == "table" else grads[k]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.999 * v[at] + 0.001 * g * g
        w[at] -= rate * fix * m[at] / (np.sqrt(v[at]) + 1e-8)
    net.base = float(weights["base"][0])


def calibrate(net: Network, margins: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list[str | None], least: int = 50, rows: np.ndarray | None = None) -> None:
    """Sets the scores' scale (logistic regression on the margin) and each language's threshold (best F1).

    rows: how many rows a margin stands for (one each, if not given); weight: what they count in all.
    """
    rows = np.ones(len(y), dtype=np.int64) if rows is None else rows
    middle = float(np.average(margins, weights=rows))
    spread = float(np.sqrt(np.average((margins - middle) ** 2, weights=rows))) or 1.0
    z = np.stack([(margins - middle) / spread, np.ones(len(margins))], axis=1)
    target = np.where(y == 1, 1 - 1 / (2 + rows[y == 1].sum()), 1 / (2 + rows[y == 0].sum()))

    def loss(c: np.ndarray) -> float:
        t = z @ c
        return float((weight * (np.logaddexp(0, t) - target * t)).sum() + 1e-3 * (c @ c))

    c = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + 2e-3 * np.eye(2), z.T @ (weight * (p - target)) + 2e-3 * c)
        while loss(c - step) > loss(c) and np.abs(step).max() > 1e-9:
            step = step / 2
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    net.scale = float(max(c[0], 1e-3) / spread)
    net.shift = float(c[1] - net.scale * middle)
    p = 1 / (1 + np.exp(-np.clip(net.scale * margins + net.shift, -30, 30)))

    def best(part: np.ndarray) -> float:
        cuts = np.linspace(0.3, 0.9, 25)
        f1 = [2 * (weight * (p >= c) * y)[part].sum() / max(1e-9, (weight * ((p >= c) + y))[part].sum()) for c in cuts]
        good = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        return float(cuts[good[len(good) // 2]])

    net.threshold = best(np.ones(len(y), dtype=bool))
    for lang in {x for x in langs if x is not None}:
        part = np.array([x == lang for x in langs])
        if rows[part].sum() >= least and 0 < y[part].sum() < part.sum():
            net.thresholds[lang] = best(part)


def _flat(net: Network) -> np.ndarray:
    """All weights as rows of WIDTH numbers: the embeddings first, then the others, filled up with zeros."""
    rest = np.concatenate([np.ravel(v) for k, v in _weights(net).items() if k != "table"])
    return np.concatenate([net.table, np.concatenate([rest, np.zeros(-len(rest) % WIDTH)]).reshape(-1, WIDTH)]).astype(np.float32)


def _moved(net: Network, by: np.ndarray) -> Network:
    """The network after a move of its flat weights."""
    flat = _flat(net) + by
    rest, at = flat[BUCKETS:].ravel(), 0
    made = {"table": flat[:BUCKETS]}
    for k, v in _weights(net).items():
        if k != "table":
            made[k] = rest[at : at + v.size].reshape(v.shape)
            at += v.size
    n = range(len(WIDTHS))
    return Network(made["table"], [made[f"filter{k}"] for k in n], [made[f"bias{k}"] for k in n], made["out"], float(made["base"][0]))


def _pass(rows: DataFrame, net: Network, balance: tuple[float, float], rate: float) -> tuple[Network, np.ndarray]:
    """The network after every task has gone on with it over its rows (label, text), and which embeddings LEAST_TEXTS texts hold; balance: the weight of a row of class 0 and of class 1.

    A task keeps a batch of BATCH texts and a copy of the network, whatever its rows. Embeddings move by the mean over
    the texts that hold them, the other weights by the mean over all texts.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen, held = None, np.zeros(BUCKETS, dtype=np.int64), []
        step = n = 0

        def go() -> None:
            nonlocal step
            step += 1
            y = np.array([label for label, _ in held], dtype=np.float32)
            _step(mine, state, known, [ids for _, ids in held], y, np.where(y == 1, balance[1], balance[0]), rate, step)
            held.clear()

        for part in in_slices(batches, "text"):
            if mine is None:
                mine = _moved(sent.value, 0)
                state, known = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in _weights(mine).items()}, np.ones(BUCKETS, dtype=bool)
                known[0] = False
            for label, text in zip(part.column("label").to_pylist(), utf8(part, "text").to_pylist(), strict=True):
                held.append((int(label > 0), word_ids(text)))
                seen[np.unique(held[-1][1])] += 1
                n += 1
                if len(held) == BATCH:
                    go()
        if mine is None:
            return
        if held:
            go()
        by, texts = _flat(mine) - _flat(sent.value), np.concatenate([seen, np.full(len(_flat(mine)) - BUCKETS, n)])
        slots = np.flatnonzero(texts)
        moves = pa.array((by[slots] * texts[slots, None]).ravel(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(texts[slots]), pa.FixedSizeListArray.from_arrays(moves, WIDTH).cast(pa.list_(pa.float64()))], ["slot", "texts", "moves"])

    found = rows.select("label", "text").mapInArrow(run, "slot int, texts long, moves array<double>")
    sums = found.groupBy("slot").agg(F.sum("texts").alias("texts"), *(F.sum(F.get("moves", F.lit(i))).alias(f"m{i}") for i in range(WIDTH)))
    mean = [(F.col(f"m{i}") / F.col("texts")).cast("float").alias(f"m{i}") for i in range(WIDTH)]
    took = sums.where((F.col("texts") >= LEAST_TEXTS) | (F.col("slot") >= BUCKETS)).select("slot", *mean).toArrow()  # a row for each slot at most
    by = np.zeros_like(_flat(net))
    by[took["slot"].to_numpy()] = np.stack([took[f"m{i}"].to_numpy() for i in range(WIDTH)], axis=1)
    sent.unpersist()
    held = np.zeros(len(by), dtype=bool)
    held[took["slot"].to_numpy()] = True
    return _moved(net, by), held[:BUCKETS]


def _counted(rows: DataFrame, net: Network) -> pa.Table:
    """lang, label, bin and n: how many rows have which margin, in bins of 1 / BINS."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.array([round(float(np.clip(sent.value.margin(word_ids(t)), -1000, 1000)) * BINS) for t in utf8(batch, "text").to_pylist()], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(at)], ["lang", "label", "bin"])

    found = map_slices(rows.select("lang", "label", "text"), each, "lang string, label int, bin int", "text")
    return found.groupBy("lang", (F.col("label") > 0).cast("int").alias("label"), "bin").agg(F.count("*").alias("n")).toArrow().sort_by([("label", "ascending"), ("bin", "ascending"), ("lang", "ascending")])


def _fetched(rows: DataFrame) -> tuple[np.ndarray, list[str | None], list[np.ndarray]]:
    """label, lang and embedding rows of each row (doc_id, label, lang, ids), by doc_id; the embedding rows lie in a temporary file, whatever their size."""
    rows = written(rows, "start")
    about = rows.select("doc_id", "label", "lang", F.octet_length("ids").cast("long").alias("size")).toArrow().sort_by("doc_id")
    doc_id, ends = about["doc_id"].to_numpy(), np.cumsum(about["size"].to_numpy())
    if len(ends) and ends[-1] > SENT:
        rows = written(rows.orderBy("doc_id"), "start-ordered")  # so that a range of them is read alone
    with tempfile.TemporaryFile() as file:
        first = 0
        while first < len(doc_id):
            sent = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, sent + SENT, side="right")))
            some = rows.where(F.col("doc_id").between(int(doc_id[first]), int(doc_id[last - 1]))).select("doc_id", "ids").toArrow().sort_by("doc_id")
            for x in some["ids"]:
                file.write(x.as_buffer())
            first = last
        file.flush()
        every = np.asarray(np.memmap(file, np.int32, "r")) if len(ends) and ends[-1] else np.zeros(0, dtype=np.int32)
    return about["label"].to_numpy(), about["lang"].to_pylist(), [x.reshape(-1, PARTS) for x in np.split(every, ends[:-1] // 4)] if len(ends) else []


def fit(docs: DataFrame, labels: DataFrame, column: str, allowed: F.Column, most: int = SAMPLE) -> Network:
    """A network for labels[column]; allowed: which rows of labels may be learnt from; most: rows that the driver itself trains on."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & allowed)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).join(known, "doc_id")
    texts = written(texts.groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "label", "t.text", "t.lang"), "labelled")
    share = {int(r["label"]): r["n"] for r in texts.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    large = max(share.values(), default=0) > most // 2
    kept_out = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1000)) < int(HELD * 1000)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([word_ids(t).tobytes() for t in utf8(batch, "text").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("lang"), ids], ["doc_id", "label", "lang", "ids"])

    begin = texts
    if large:
        first, some = [F.xxhash64("doc_id", F.lit(13)), F.col("doc_id")], min(most, START) // 2
        rows = texts.where(~kept_out).select("doc_id", "label")
        chosen = rows.where("label > 0").orderBy(*first).limit(some).union(rows.where("label <= 0").orderBy(*first).limit(some)).select("doc_id")
        begin = texts.join(F.broadcast(chosen), "doc_id", "left_semi")  # START numbers at most
    label, langs, ids = _fetched(map_slices(begin, each, "doc_id long, label int, lang string, ids binary", "text"))
    y = (label > 0).astype(np.float32)
    if not len(y) or len(share) < 2 or y.min() == y.max():
        share_1 = share.get(1, 0) / max(1, sum(share.values()))
        net = train([word_ids(b"")], np.zeros(1, dtype=np.float32))
        net.out[:] = 0
        net.base, net.scale, net.shift = 0.0, 1.0, float(np.log((share_1 + 1e-6) / (1 - share_1 + 1e-6)))
        return net
    if not large:
        order = np.random.default_rng(1).permutation(len(y))
        held, rest = order[: max(1, int(HELD * len(y)))], order[max(1, int(HELD * len(y))) :]
        net = train([ids[i] for i in rest], y[rest])
        calibrate(net, np.array([net.margin(ids[i]) for i in held]), y[held], np.ones(len(held)), [langs[i] for i in held])
        return net
    net = train(ids, y)
    whole = sum(share.values())
    fresh = ~net.table.any(axis=1)
    net.table[fresh] = np.random.default_rng(2).normal(0, 0.1, (fresh.sum(), WIDTH))
    net.table[0] = 0
    for rate in RATES:
        net, general = _pass(texts.where(~kept_out), net, (whole / 2 / share[0], whole / 2 / share[1]), rate)
    net.table[~general] = 0
    counts = _counted(texts.where(kept_out), net)
    n = counts["n"].to_numpy()
    if len(n):
        calibrate(net, counts["bin"].to_numpy() / BINS, counts["label"].to_numpy().astype(np.float32), n.astype(np.float64), counts["lang"].to_pylist(), rows=n)
    return net


def score(docs: DataFrame, net: Network, name: str = "score", columns: list[str] | None = None, limit_name: str = "threshold", flag_name: str = "flagged") -> DataFrame:
    """docs, or only `columns` of it, with the columns `name` (0 to 1), threshold and flagged (the score reaches its language's threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    added = [name, limit_name, flag_name]
    kept = [c for c in columns or docs.columns if c not in added]
    kinds = {f.name: f for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in kept) + f", `{name}` double"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [sent.value.score(word_ids(t)) for t in utf8(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, name])

    out = map_slices(docs.select(*dict.fromkeys([*kept, "text"])), each, schema, "text")
    limit = F.lit(net.threshold)
    if "lang" in kept and net.thresholds:
        by = F.create_map(*(F.lit(x) for pair in sorted(net.thresholds.items()) for x in pair))
        limit = F.coalesce(by[F.col("lang").cast("string")], limit)
    return out.withColumn(limit_name, limit).withColumn(flag_name, F.col(name) >= F.col(limit_name))
