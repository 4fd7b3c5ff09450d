"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Cyclic boosting fits, in turn for each feature, a shallow
tree on its bins to the log-loss gradient, and adds it to the feature's lookup table; then the pairs with the
largest gain get two-dimensional tables in the same way. A score is the logistic of a sum of table entries, looked
up for a whole batch at once.

The model learns from at most SAMPLE labelled rows, the first by a hash of their doc_id; labelled rows without a
label or a doc_id are left out, and of several labels for one doc_id the largest counts. Only the sample's features
and the tables come to the driver. Without rows of both classes, every score is the share of label 1 (0.5 without
any).

Defined cases: a null text is the empty text and is scored as such; rows that repeat a doc_id are scored each by
itself; an empty table gives an empty result; other columns are kept by `score` unless they have the name of one
that it adds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespan.llm.common import map_slices, utf8

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.15
_MARKS = b"!?.,;:|%$&*#@/<>=+-_(){}[]\"'"
NAMES = (
    "words", "word_length", "distinct", "top_word", "top_ten", "same_as_last", "short_words", "odd_words", "lines", "line_words", "repeated_lines", "short_lines",
    "upper", "digits", "space", "other", "entropy", "packed", "long_run", "stops", "commas", "marks", "shouts", "bars",
)


def features(text: bytes) -> list[float]:
    """The features named in NAMES of a UTF-8 text."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    counts = Counter(words)
    top = counts.most_common(10)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = hist[hist > 0] / n
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum() + hist[192:].sum()))
    sizes = [*map(len, words)]
    marks = {c: int(hist[c]) for c in _MARKS}
    run = best = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return [
        np.log1p(m), sum(sizes) / m, len(counts) / m, top[0][1] / m, sum(c for _, c in top) / m, sum(map(bytes.__eq__, words, words[1:])) / m, sum(s <= 3 for s in sizes) / m, sum(not w.isalnum() and w.isascii() for w in words) / m,
        np.log1p(len(lines)), m / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        int(hist[65:91].sum()) / letters, int(hist[48:58].sum()) / n, int(hist[32]) / n, int(hist[128:].sum()) / n, float(-(share * np.log2(share)).sum()), len(zlib.compress(text, 1)) / n, np.log1p(best),
        marks[46] / m, marks[44] / m, (sum(marks.values()) - marks[46] - marks[44]) / m, (marks[33] + marks[63]) / m, marks[124] / m,
    ]


@dataclass
class Model:
    """Lookup tables over binned features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (j, k), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_edges[j], x[:, j], side="right"), np.searchsorted(self.pair_edges[k], x[:, k], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 5.0) -> np.ndarray:
    """Values by bin of the best tree of `depth` cuts deep on sums of gradient and curvature by bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h > least * 0.05) & (right_h > least * 0.05), left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1), -1)
    at = int(gain.argmax())
    if gain[at] <= g.sum() ** 2 / (h.sum() + 1):
        return out
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1), _tree(g[at + 1 :], h[at + 1 :], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best table of four quadrants over sums by pair of bins, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(p[0] ** 2 / (p[1] + 1) for p in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    table = np.empty_like(g)
    for k, (rows, columns) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        table[rows, columns] = _leaf(float(parts[k][0][i, j]), float(parts[k][1][i, j]))
    return table, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits tables to rows x with labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return Model(base=float(np.log(share / (1 - share))))
    model = Model(base=float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin))
            g, h = np.bincount(at[j], y - p, len(table)), np.bincount(at[j], p * (1 - p), len(table))
            step = RATE * _tree(g, h, 2)
            table += step
            margin += step[at[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def sums(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        cell = coarse[j] * wide[k] + coarse[k]
        return np.bincount(cell, y - p, wide[j] * wide[k]).reshape(wide[j], wide[k]), np.bincount(cell, p * (1 - p), wide[j] * wide[k]).reshape(wide[j], wide[k])

    able = [j for j in range(x.shape[1]) if wide[j] > 1]
    gains = {(j, k): _quadrants(*sums(j, k))[1] for i, j in enumerate(able) for k in able[i + 1 :]}
    model.pairs = sorted(gains, key=lambda jk: (-gains[jk], jk))[:PAIRS]
    model.pair_tables = [np.zeros((wide[j], wide[k])) for j, k in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (j, k), table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _quadrants(*sums(j, k))[0]
            table += step
            margin += step[coarse[j], coarse[k]]
    return model


def sampled(labels: DataFrame, column: str, allowed: F.Column, most: int) -> DataFrame:
    """doc_id, label of the labelled rows to learn from, `most` at most, the first by a hash of their doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & allowed)
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)


def _featured(docs: DataFrame) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in utf8(batch, "text").to_pylist()], dtype=np.float64)
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])

    return map_slices(docs.select("label", "text"), each, "label int, x array<double>", "text")


def fit(docs: DataFrame, labels: DataFrame, column: str, allowed: F.Column, most: int = SAMPLE) -> Model:
    """A model of labels[column]; allowed: which rows of labels may be learnt from. Of several texts of a doc_id the least counts."""
    chosen = F.broadcast(sampled(labels, column, allowed, most))  # `most` rows of two numbers at most
    rows = _featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))).toArrow()
    if not rows.num_rows:
        return train(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.array(rows["x"].to_pylist())
    order = np.lexsort(x.T)  # the same model whatever the order of the rows
    return train(x[order], rows["label"].to_numpy()[order].astype(float))


def score(docs: DataFrame, model: Model, name: str = "score", columns: list[str] | None = None) -> DataFrame:
    """docs, or only `columns` of it, with a column of scores from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in columns or docs.columns if c != name]
    kinds = {f.name: f for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in kept) + f", `{name}` double"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in utf8(batch, "text").to_pylist()], dtype=np.float64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sent.value.score(x))], [*kept, name])

    return map_slices(docs.select(*dict.fromkeys([*kept, "text"])), each, schema, "text")
