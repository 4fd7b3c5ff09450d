"""Language-model scores by online logistic context mixing, beside a smoothed unigram score.

A text is its words (runs of anything but ASCII white space, A-Z lowered) and an end. A word is a path of binary decisions
in a code tree (a Huffman tree over the VOCABULARY most frequent words, the end and an escape); after an escape the word is
spelled in bytes, whichever of the 256 they are, and a space, each a path in a second tree, in which every byte value has a
leaf. Decisions are predicted from several contexts, most of them hashed:

* of words: the place in the tree; the word before (a rare one: its last bytes) with the place; the place as this text has used it;
* of bytes: the last two, three and five bytes of the word, and the whole word so far.

Their logits are added with weights gated by how sure the word-pair (or the whole-word) context is, and the sum is refined by a
table for each gate. Weights and refinements are learnt online, from one training document in TUNE, by tables that leave these
documents out; the weights of words, and what this text has used, go on being learnt after each BLOCK decisions, from a text's
beginning to its end. Decisions' log probabilities add up to the score; over the bytes it gives bits per byte.

Everything counted comes from all training documents: the tree and the byte contexts from the aggregated word counts, word pairs
from the texts themselves. Counts are added up in tables of hashed slots, whose number grows with the distinct words up to
2 ** MOST_BITS, by tasks whose pages are shuffled and summed. Words outside the tree are no less learnt from: the byte contexts
are counted from them.

The unigram score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over words and the end. Counts of those of the FREQUENT words that
are in the tree are at hand in each task. A text is split and its words are looked up once, into a table of numbers from which
word pairs are counted and scores are made. What it takes to spell a word does not depend on the text, so each distinct word is
spelled once; other words of a text are joined to their counts and spellings by shuffle.

Defined cases: a null text is the empty text (an end alone); rows that repeat a doc_id are scored each by itself;
without training documents N and V are zero; an empty table gives an empty result; other columns are ignored. Texts are
read WINDOW bytes at a time, with all that was learnt carried on; words of more than LONG_WORD bytes are coded in parts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespan.llm.common import in_slices, map_slices, utf8, written

#: Contexts of bytes: how many bytes (0: the whole word so far), and the bits of the table; None: grows with the distinct words.
ORDERS = ((2, 17), (3, 19), (5, 20), (0, None))
PAIRS = len(ORDERS)
LEAST_BITS = 16
MOST_BITS = 22
TAIL = 3
FREQUENT = 65_536
#: Words with a path of their own in the tree at most, and how often they occur at least.
VOCABULARY = 65_536
LEAST_TIMES = 8
#: Tokens of texts that are laid out at once.
TOKENS = 1 << 15
#: Words outside the tree whose numbers a task remembers from batch to batch.
REMEMBERED = 65_536
WINDOW = 1 << 19
LONG_WORD = 4096
#: Decisions after which weights and the text's own context are brought up to date.
BLOCK = 1024
TUNE = 16
RATE = 4e-3
OWN_RATE = np.float32(0.6)
REFINE_RATE = np.float32(0.02)
CELLS = 513
#: Bytes of text, and distinct words, that a task counts before its tables are shuffled.
TASK_BYTES = 128 << 20
TASK_WORDS = 1_000_000
#: Bytes that are spelled at once.
SPELL_BYTES = 1 << 14
PAGE = 4096
_R = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_NODE = np.uint64(0x94D049BB133111EB)
#: Tables hold logits in sixteenths, as signed bytes; 0: nothing known.
UNIT = 16
_GATE = np.digitize(np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64)) / UNIT, [0.01, 1.6, 3.5])
GATES = 4


def _powers(base: int, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(n, base, dtype=np.uint64))]


_UP, _DOWN = _powers(_R, WINDOW + 2 * LONG_WORD), _powers(pow(_R, -1, 1 << 64), WINDOW + 2 * LONG_WORD)


@dataclass
class Tree:
    """A code tree: of each leaf, where its path begins in nodes and turns, and how long it is."""

    start: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray

    @cached_property
    def hashed(self) -> np.ndarray:
        """Hashes of nodes, to which contexts' are added."""
        return (self.nodes.astype(np.uint64) + np.uint64(1)) * _NODE


def code_tree(counts: np.ndarray) -> Tree:
    """A Huffman tree over leaves, each counted once more than it occurs."""
    leaves = len(counts)
    heap = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    for node in range(leaves, 2 * leaves - 1):
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a], above[b] = (node, 0), (node, 1)
        heapq.heappush(heap, (n + m, node, node))
    paths = []
    for b in range(leaves):
        path = []
        while b in above:
            b, turn = above[b]
            path.append((b - leaves, turn))
        paths.append(path[::-1])
    size = np.array([len(p) for p in paths], dtype=np.int64)
    nodes, turns = zip(*(x for p in paths for x in p), strict=True)
    return Tree(np.cumsum(size) - size, size, np.array(nodes, dtype=np.int64), np.array(turns, dtype=np.uint8))


@dataclass
class Code:
    """The trees of words (leaf 0: the escape, 1: the end) and bytes, the words' leaves, and the logits of the tree of words."""

    words: Tree
    bytes: Tree
    leaf: dict[bytes, int]
    logits: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        """word_hash of each leaf's word; that of the escape is not used."""
        out = np.zeros(len(self.words.size), dtype=np.uint64)
        out[list(self.leaf.values())] = [word_hash(w, True) for w in self.leaf]
        return out


@dataclass
class Model:
    """What the workers get: tables of signed bytes (ORDERS, then word pairs); of words and of bytes, GATES rows of weights and of refinements."""

    code: Code
    tables: list[np.ndarray]
    weights: list[np.ndarray]
    refine: list[np.ndarray]


def fresh() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights and refinements before anything is learnt."""
    refine = 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS, dtype=np.float32)))
    rows = [np.array(w, dtype=np.float32) / np.float32(UNIT) for w in ((0.9, 0.1, 0.3), (0.2, 0.3, 0.3, 0.4))]
    return [np.tile(w, (GATES, 1)) for w in rows], [np.tile(refine, (GATES, 1)) for _ in rows]


def cells_of(z: np.ndarray) -> np.ndarray:
    """The refinement's cell of each logit."""
    made = z + np.float32(8)
    made *= np.float32((CELLS - 1) / 16)
    np.rint(made, out=made)
    return np.minimum(np.maximum(made, 0, out=made), CELLS - 1, out=made).astype(np.int64)


def shortened(words: list[bytes]) -> list[bytes]:
    """Words with those of LONG_WORD bytes or more in parts; all but the last part of one end in a line feed."""
    if max(map(len, words), default=0) < LONG_WORD:
        return words
    out = []
    for w in words:
        cuts = range(0, len(w), LONG_WORD) if len(w) >= LONG_WORD else [0]
        out += [w[at : at + LONG_WORD] + b"\n" for at in cuts[:-1]]
        out.append(w[cuts[-1] :])
    return out


def windows(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, WINDOW bytes of it or one word at a time."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        if end >= len(text):
            end = len(text)
        else:
            back = max(text.rfind(bytes([x]), at, end) for x in b" \t\n\x0b\x0c\r")
            if back > at:
                end = back
            else:  # a word that is longer than a window: to its end
                ahead = [k for k in (text.find(bytes([x]), end) for x in b" \t\n\x0b\x0c\r") if k >= 0]
                end = min(ahead, default=len(text))
        yield text[at:end].lower().split()
        at = end


def _walk(tree: Tree, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths of leaves, end to end: the place of each step in the tree's nodes and turns; and how many steps each leaf has."""
    size = tree.size.take(leaves)
    ends = np.cumsum(size)
    place = np.repeat(tree.start.take(leaves) - (ends - size), size)
    place += np.arange(len(place))
    return place, size


def spelled(code: Code, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Decisions that spell words (or parts of long ones): which word each is of, its turn, and hashes of ORDERS' contexts and the node."""
    parts = [w if w[-1:] == b"\n" else w + b" " for w in words]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = len(flat)
    begin = np.repeat(start, size)
    depth = np.arange(n) - begin
    wide = flat.astype(np.uint64)
    up, down = (_UP[: n + 1], _DOWN[: n + 1]) if n < len(_UP) else (_powers(_R, n), _powers(pow(_R, -1, 1 << 64), n))
    upto = np.r_[np.uint64(0), np.cumsum((wide + np.uint64(1)) * up[:n])]
    so_far = (upto[:-1] - upto[begin]) * down[begin] + np.uint64(1)
    so_far ^= so_far >> np.uint64(29)
    recent, hashes = np.zeros(n, dtype=np.uint64), {0: so_far}
    for back in range(1, 6):
        earlier = np.zeros(n, dtype=np.uint64)
        earlier[back:] = wide[: max(0, n - back)] << np.uint64(8 * (back - 1))
        recent += np.where(depth >= back, earlier, np.uint64(0))
        if any(o == back for o, _ in ORDERS):
            hashes[back] = recent.copy()
    place, steps = _walk(code.bytes, flat)
    hashed = code.bytes.hashed.take(place, mode="clip")
    of = np.repeat(np.arange(len(parts)), np.add.reduceat(steps, start))
    contexts = []
    for order, _ in ORDERS:
        mixed = np.repeat(hashes[order], steps)
        mixed += hashed
        contexts.append(mixed)
    return of, code.bytes.turns.take(place, mode="clip"), contexts


def slots(hashed: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Slots of context k in a table of 2 ** bits."""
    mixed = hashed * _MIX[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX[k + 1]
    mixed >>= np.uint64(64 - bits)
    return mixed.view(np.int64)


def word_hash(word: bytes, known: bool) -> int:
    """What the word after is predicted from: a word of the tree, or the last bytes of another."""
    return xxhash.xxh3_64_intdigest(word if known else word[-TAIL:], int(known))


def tokens_of(words: list[bytes]) -> np.ndarray:
    """What stands for words outside the tree: below zero, from their last bytes."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat, end = np.frombuffer(bytes(TAIL) + b"".join(words), dtype=np.uint8), np.cumsum(size) + TAIL
    out = np.minimum(size, TAIL) << 8 * TAIL
    for back in range(1, TAIL + 1):
        out |= np.where(size >= back, flat.take(end - back).astype(np.int64), 0) << 8 * (back - 1)
    return (-1 - out).astype(np.int32)


@lru_cache(1 << 16)
def token_hash(token: int) -> int:
    """word_hash of the words outside the tree that tokens_of gives this token."""
    size = (-1 - token) >> 8 * TAIL
    return word_hash((-1 - token & (1 << 8 * TAIL) - 1).to_bytes(TAIL, "big")[TAIL - size :], False)


class Numbers:
    """Words' numbers: those of the tree have their leaves', others the next free one when they are met; tokens: what stands for each number in a text.

    Other words are forgotten between calls of `of` where there are REMEMBERED or more; cut: the numbers of parts that are no word's last.
    """

    def __init__(self, code: Code):
        self.code, self.first = code, len(code.words.size)
        self.forget()

    def forget(self) -> None:
        self.known = defaultdict(count(self.first).__next__, self.code.leaf)
        self.tokens, self.rare, self.cut = np.arange(self.first, dtype=np.int32), [], set()

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        """The number of each word."""
        if len(self.rare) >= REMEMBERED:
            self.forget()
        before = len(self.known)
        ids = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64)
        fresh = list(islice(reversed(self.known), len(self.known) - before))[::-1]
        if fresh:
            self.cut.update(k for k, w in enumerate(fresh, len(self.tokens)) if len(w) > LONG_WORD and w[-1] == 10)
            self.rare += fresh
            self.tokens = np.concatenate([self.tokens, tokens_of(fresh)])
        return ids

    def spelled(self, ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The distinct words of ids that are not in the tree, in turn, and of each of ids which of them it is (-1: none)."""
        first = self.first
        at = np.flatnonzero(ids >= first)
        found, begin, which = np.unique(ids[at], return_index=True, return_inverse=True)
        order = np.argsort(begin)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        out = np.full(len(ids), -1)
        out[at] = place[which]
        return [self.rare[k - first] for k in found[order].tolist()], out


@dataclass
class Batch:
    """The words of some texts in turn, as decisions in the tree of words."""

    ids: np.ndarray  # of each token, its word's number
    node: np.ndarray
    turn: np.ndarray
    pair: np.ndarray  # 64-bit hash of the word before (0 where a text begins) and the node
    ends: np.ndarray  # of each unit (a text or a window of it), where its decisions end
    tokens: np.ndarray  # and its tokens


def laid(code: Code, units: list[tuple[bool, list[bytes]]], carry: int, numbers: Numbers | None = None) -> tuple[Batch, int]:
    """Units (whether a text begins, its words) as a batch; carry: the hash of the word before the first unit, and after the last; numbers: those of the words, which go on from batch to batch."""
    numbers = Numbers(code) if numbers is None else numbers
    ids = numbers.of(chain.from_iterable(words for _, words in units))
    return placed(code, ids, numbers.tokens.take(ids), [(new, len(words)) for new, words in units], carry)


def placed(code: Code, ids: np.ndarray, tokens: np.ndarray, units: list[tuple[bool, int]], carry: int) -> tuple[Batch, int]:
    """The same from tokens and the units' numbers of them; ids only go with the batch."""
    upto = np.cumsum([n for _, n in units])
    leaves = np.maximum(tokens, 0)
    before = np.empty(len(tokens) + 1, dtype=np.uint64)
    before[0], before[1:] = carry, code.hashes.take(leaves)
    rare = np.flatnonzero(tokens < 0)
    found, which = np.unique(tokens[rare], return_inverse=True)
    before[rare + 1] = np.array([token_hash(t) for t in found.tolist()], dtype=np.uint64)[which]
    after, before = int(before[-1]), before[:-1]
    before[[end - n for end, (new, n) in zip(upto.tolist(), units, strict=True) if new]] = 0
    place, steps = _walk(code.words, leaves)
    pair = code.words.hashed.take(place, mode="clip")
    pair += np.repeat(before, steps)
    ends = np.r_[0, np.cumsum(steps)][upto]
    return Batch(ids, code.words.nodes.take(place, mode="clip"), code.words.turns.take(place, mode="clip"), pair, ends, upto), after


def laid_tokens(code: Code, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[Batch, list[tuple[bool, bool]]]]:
    """Batches of the texts of rows of tokens and units (as `numbered` makes them), and of each of their units whether a text begins and ends; some TOKENS together."""
    held, size, carry = [], 0, 0

    def made() -> tuple[Batch, list[tuple[bool, bool]]]:
        nonlocal carry
        batch, carry = placed(code, np.zeros(0, dtype=np.int64), np.concatenate([t for _, _, t in held]), [(new, len(t)) for new, _, t in held], carry)
        return batch, [(new, over) for new, over, _ in held]

    for row in rows:
        for data, sizes in zip(row.column("tokens").to_pylist(), row.column("units").to_pylist(), strict=True):
            tokens, at = np.frombuffer(data, dtype=np.int32), 0
            for k, n in enumerate(sizes):
                held.append((k == 0, k == len(sizes) - 1, tokens[at : at + n]))
                at += n
                size += n
                if size >= TOKENS:
                    yield made()
                    held, size = [], 0
    if held:
        yield made()


def units_of(text: bytes) -> Iterator[tuple[bool, bool, list[bytes]]]:
    """A text as units: whether it begins, whether it ends, and its words; they depend on the text alone."""
    new, held = True, []
    for words in windows(text):
        parts = shortened(words)
        for k in range(0, len(parts), 1 << 17):
            if held:
                yield new, False, held
                new = False
            held = parts[k : k + (1 << 17)]
    yield new, True, [*held, b""]


def batches_of(texts: Iterator[bytes]) -> Iterator[list[tuple[bool, bool, list[bytes]]]]:
    """Units of texts, some WINDOW bytes together."""
    held, size = [], 0
    for text in texts:
        for unit in units_of(text):
            held.append(unit)
            size += sum(map(len, unit[2])) + len(unit[2])
            if size >= WINDOW:
                yield held
                held, size = [], 0
    if held:
        yield held


class Mixer:
    """The online state of a text: weights of the tree of words, and what the text has used of it."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = model.weights[0].copy()
        self.own = np.zeros(len(model.code.logits), dtype=np.float32)
        self.rows = np.arange(BLOCK)
        self.spread = np.zeros(BLOCK * GATES, dtype=np.float32)
        self.refined(model.refine[0])

    def refined(self, refine: np.ndarray) -> None:
        """Tables by turn, gate and cell: the log of the refined probability of the turn, and the error of the plain one."""
        plain = 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))
        both = (refine + plain) / 2
        self.gain = np.log(np.stack([1 - both, both])).ravel()
        self.error = np.stack([-np.tile(plain, (GATES, 1)), 1 - np.tile(plain, (GATES, 1))]).astype(np.float32).ravel()

    def begin(self) -> None:
        """A new text, with the weights of the model."""
        self.weights[:] = self.model.weights[0]
        self.own[:] = 0

    def code(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray, turn: np.ndarray, refine: np.ndarray | None = None, last: bool = False) -> float:
        """Natural log of the probability of the turns of some decisions; x: their inputs, the last of which is filled in here; refine: a table that learns; last: whether nothing that is learnt in the last block is used after it."""
        rate = np.float32(RATE * UNIT**-2)
        scale, middle = np.float32((CELLS - 1) / 16), np.float32((CELLS - 1) / 2 + 0.5)
        row, cells = gate * CELLS, turn * (GATES * CELLS)
        cells += row
        for a in range(0, len(turn), BLOCK):
            b = slice(a, a + BLOCK)
            xb, place, cell = x[b], node[b], cells[b]
            there = gate[b] * len(place)
            there += self.rows[: len(place)]
            seen = self.own.take(place, mode="clip")
            xb[:, -1] = seen
            z = (self.weights @ xb.T).ravel().take(there, mode="clip")
            z *= scale
            z += middle
            at = np.minimum(np.maximum(z, 0, out=z), CELLS - 1, out=z).astype(np.int64)
            cell += at
            if refine is not None:
                flat = refine.ravel()
                at += row[b]
                flat[at] += REFINE_RATE * (turn[b] - flat.take(at))
            if last and a + BLOCK >= len(turn):
                break
            error = self.error.take(cell, mode="clip")
            spread = self.spread[: len(place) * GATES]
            spread[there] = error
            self.weights += rate * (spread.reshape(GATES, -1) @ xb)
            spread.fill(0)
            error *= OWN_RATE * np.float32(UNIT)
            seen += error
            self.own[place] = seen
        return float(self.gain.take(cells).sum())


def inputs(model: Model, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each decision in the tree of words: the inputs but for the text's own, the gate, the node, the turn."""
    pairs = model.tables[PAIRS].take(slots(batch.pair, PAIRS, len(model.tables[PAIRS]).bit_length() - 1), mode="clip")
    x = np.empty((3, len(pairs)), dtype=np.float32).T  # an input's values lie together
    x[:, 0] = model.code.logits.take(batch.node, mode="clip")
    x[:, 1] = pairs
    return x, _GATE.take(pairs.view(np.uint8), mode="clip"), batch.node, batch.turn.astype(np.int64)


def spellings(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each decision that spells words: the word, the inputs, the gate, the turn."""
    at, turn, contexts = spelled(model.code, words)
    x = np.empty((len(ORDERS), len(at)), dtype=np.float32).T
    for k, hashed in enumerate(contexts):
        found = model.tables[k].take(slots(hashed, k, len(model.tables[k]).bit_length() - 1), mode="clip")
        x[:, k] = found
    return at, x, _GATE.take(found.view(np.uint8)), turn.astype(np.int64)


def spelling_scores(model: Model, words: list[bytes]) -> np.ndarray:
    """Natural log of the probability of each word's bytes."""
    if not words:
        return np.zeros(0)
    at, x, gate, turn = spellings(model, words)
    there = gate * len(at)
    there += np.arange(len(at))
    cell = cells_of((model.weights[1] @ x.T).ravel().take(there, mode="clip"))
    turn *= GATES
    turn += gate
    turn *= CELLS
    cell += turn
    both = (model.refine[1] + 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))) / 2
    return np.bincount(at, np.log(np.stack([1 - both, both])).ravel().take(cell, mode="clip"), len(words))


def word_spellings(model: Model, words: list[bytes]) -> np.ndarray:
    """Natural log of the probability of each word's bytes, in parts if it is long; 0 for words of the tree and the end."""
    leaf, parts, of = model.code.leaf, [], []
    for k, w in enumerate(words):
        if w not in leaf and w:
            some = [p for p in shortened([w]) if p not in leaf]
            parts += some
            of += [k] * len(some)
    out, of, at = np.zeros(len(words)), np.array(of, dtype=np.int64), 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and held < SPELL_BYTES:
            held += len(parts[end]) + 1
            end += 1
        np.add.at(out, of[at:end], spelling_scores(model, parts[at:end]))
        at = end
    return out


def text_scores(model: Model, texts: Iterator[bytes], spell: bool = True) -> list[float]:
    """log10 of the probability of each text; spell: with the bytes of words that are not in the tree."""
    out, now, carry, mixer, numbers = [], 0.0, 0, Mixer(model), Numbers(model.code)
    for units in batches_of(texts):
        batch, carry = laid(model.code, [(new, words) for new, _, words in units], carry, numbers)
        upto = np.zeros(len(batch.ids) + 1)
        if spell:
            rare, which = numbers.spelled(batch.ids)
            np.cumsum(np.r_[spelling_scores(model, rare), 0][which], out=upto[1:])
        made, at, token = inputs(model, batch), 0, 0
        for (new, over, _), end, tokens in zip(units, batch.ends.tolist(), batch.tokens.tolist(), strict=True):
            if new:
                now = 0.0
                mixer.begin()
            now += mixer.code(*(m[at:end] for m in made), last=over) + upto[tokens] - upto[token]
            at, token = end, tokens
            if over:
                out.append(float(now) / math.log(10))
    return out


def token_scores(model: Model, rows: Iterator[pa.RecordBatch]) -> list[float]:
    """text_scores without spelling, of rows of tokens and units."""
    out, now, mixer = [], 0.0, Mixer(model)
    for batch, units in laid_tokens(model.code, rows):
        made, at = inputs(model, batch), 0
        for (new, over), end in zip(units, batch.ends.tolist(), strict=True):
            if new:
                now = 0.0
                mixer.begin()
            now += mixer.code(*(m[at:end] for m in made), last=over)
            at = end
            if over:
                out.append(now / math.log(10))
    return out


def learn(model: Model, texts: Iterator[bytes]) -> int:
    """Goes through texts online, from one to the next; the model's weights and refinements become what was learnt. How many decisions there were."""
    mixer, carry, n, numbers = Mixer(model), 0, 0, Numbers(model.code)
    for units in batches_of(texts):
        batch, carry = laid(model.code, [(new, words) for new, _, words in units], carry, numbers)
        made, at = inputs(model, batch), 0
        for (new, _, _), end in zip(units, batch.ends.tolist(), strict=True):
            if new:
                mixer.own[:] = 0
            mixer.code(*(m[at:end] for m in made), refine=model.refine[0])
            at = end
        n += at
        rare, _ = numbers.spelled(batch.ids)
        if rare:
            _, x, gate, turn = spellings(model, rare)
            for a in range(0, len(turn), BLOCK):
                b = slice(a, a + BLOCK)
                z = (x[b] @ model.weights[1].T).ravel().take(mixer.rows[: len(turn[b])] * GATES + gate[b])
                cell = gate[b] * CELLS + cells_of(z)
                flat = model.refine[1].ravel()
                flat[cell] += REFINE_RATE * (turn[b] - flat.take(cell))
                spread = np.zeros((len(z), GATES), dtype=np.float32)
                spread[np.arange(len(z)), gate[b]] = turn[b] - 1 / (1 + np.exp(-z))
                model.weights[1] += np.float32(RATE * UNIT**-2) * (spread.T @ x[b])
            n += len(turn)
    model.weights[0][:] = mixer.weights
    return n


def count_words(docs: DataFrame) -> DataFrame:
    """word (b"" is the end), c and t (how often in the documents to learn from, and in those of them that tune) of all documents."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[Counter[bytes]] = [Counter(), Counter(), Counter()]
        for text, learn, tune in zip(utf8(batch, "text").to_pylist(), batch.column("learn").to_pylist(), batch.column("tune").to_pylist(), strict=True):
            into = counts[learn + (learn and tune)]
            for words in windows(text):
                into.update(words)
            into[b""] += 1
        every = list(chain(*counts))
        sizes = [len(c) for c in counts]
        n = np.fromiter(chain.from_iterable(c.values() for c in counts), dtype=np.int64, count=len(every))
        return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array(n * np.repeat([0, 1, 1], sizes)), pa.array(n * np.repeat([0, 0, 1], sizes))], ["word", "c", "t"])

    return map_slices(docs, each, "word binary, c long, t long", "text").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte value occurs in the words, with the spaces that follow."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256)
        for batch in batches:
            made, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64)
            n += np.bincount(np.frombuffer(b"".join(made), dtype=np.uint8), np.repeat(c, [len(x) for x in made]), 256)
            n[32] += c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(n)], ["byte", "n"])

    out = np.zeros(256)
    for r in words.select("word", "c").mapInArrow(each, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r["byte"]] = r["n"]
    return out


def code_of(words: DataFrame, top: list[tuple[bytes, int]], total: int) -> Code:
    """The code; words: word, c; top: the most frequent words (b"" is the end), most frequent first."""
    own = [(w, c) for w, c in top if w and c >= LEAST_TIMES and len(w) < LONG_WORD][:VOCABULARY]
    ends = sum(c for w, c in top if not w)
    counts = np.array([total - ends - sum(c for _, c in own), ends, *(c for _, c in own)])
    tree = code_tree(counts)
    place, steps = _walk(tree, np.arange(len(counts)))
    at, node, turn = np.repeat(np.arange(len(counts)), steps), tree.nodes[place], tree.turns[place]
    sums = [np.bincount(node[turn == t].astype(np.int64), counts[at[turn == t]] + 0.3, len(counts) - 1) for t in (0, 1)]
    logits = (np.clip(np.log(sums[1] / sums[0]), -7.9, 7.9) * UNIT).astype(np.float32)
    known = words.sparkSession.createDataFrame(pa.table({"word": pa.array([w for w, _ in own], pa.binary())}))
    rare = words.where(F.col("word") != b"").join(F.broadcast(known), "word", "left_anti")  # VOCABULARY rows at most
    return Code(tree, code_tree(byte_counts(rare)), {b"": 1, **{w: k for k, (w, _) in enumerate(own, 2)}}, logits)


def numbered(docs: DataFrame, code: Code, at_hand: dict[bytes, float]) -> DataFrame:
    """docs with tokens and units (32-bit tokens of the text, the end among them, and how many each unit has), n_tokens, n_bytes, n_known and base of the words at hand, and rare (the others, and how often).

    at_hand: words of the tree, the end among them, with the logs of their base; a text's words are split and looked up here only.
    """
    names = [b"", *code.leaf]
    logs = np.full(len(code.words.size) + 1, np.nan)
    logs[[code.leaf[w] for w in at_hand]] = list(at_hand.values())
    kept = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast((code, names, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names, logs = sent.value
        numbers = Numbers(code)
        for batch in in_slices(batches, "text"):
            texts = utf8(batch, "text").to_pylist()
            n, held, known, base = (np.zeros(len(texts), dtype=t) for t in (np.int64, np.int64, np.int64, np.float64))
            tokens: list[list[bytes]] = [[] for _ in texts]
            sizes: list[list[int]] = [[] for _ in texts]
            rare: list[tuple[list[bytes], list[int]]] = [([], []) for _ in texts]
            parted, now = set(), -1
            for units in batches_of(iter(texts)):
                ids = numbers.of(chain.from_iterable(words for _, _, words in units))
                made, of, at = numbers.tokens.take(ids), [], 0
                for new, _, words in units:
                    now += new
                    of.append(now)
                    tokens[now].append(made[at : at + len(words)].tobytes())
                    sizes[now].append(len(words))
                    held[now] += sum(map(len, words)) + len(words)
                    at += len(words)
                of = np.repeat(of, [len(words) for _, _, words in units])
                if numbers.cut:
                    parted.update(of[np.isin(ids, list(numbers.cut))].tolist())
                log = logs.take(np.minimum(ids, numbers.first))
                rest = np.isnan(log)
                log[rest] = 0
                n += np.bincount(of, minlength=len(texts))
                known += np.bincount(of[~rest], minlength=len(texts))
                base += np.bincount(of, log, len(texts))
                key, times = np.unique(of[rest] << 40 | ids[rest], return_counts=True)
                for k, number, t in zip((key >> 40).tolist(), (key & (1 << 40) - 1).tolist(), times.tolist(), strict=True):
                    rare[k][0].append(names[number] if number < numbers.first else numbers.rare[number - numbers.first])
                    rare[k][1].append(t)
            for k in parted:  # words in parts: counted whole
                counts: Counter[bytes] = Counter()
                for some in windows(texts[k]):
                    counts.update(some)
                counts[b""] += 1
                n[k], held[k] = counts.total(), sum((len(w) + 1) * c for w, c in counts.items())
                log = {w: logs[code.leaf[w]] for w in counts if w in code.leaf and not math.isnan(logs[code.leaf[w]])}
                known[k], base[k] = sum(counts[w] for w in log), sum(counts[w] * x for w, x in log.items())
                rare[k] = ([w for w in counts if w not in log], [c for w, c in counts.items() if w not in log])
            words, times = ([x for r in rare for x in r[k]] for k in (0, 1))
            offsets = pa.array(np.r_[0, np.cumsum([len(r[0]) for r in rare])], pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "times"]))
            columns = [pa.array([b"".join(t) for t in tokens], pa.binary()), pa.array(sizes, pa.list_(pa.int32())), pa.array(n), pa.array(held), pa.array(known), pa.array(base), found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "tokens", "units", "n_tokens", "n_bytes", "n_known", "base", "rare"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.select(*kept, "text").mapInArrow(run, kinds + "tokens binary, units array<int>, n_tokens long, n_bytes long, n_known long, base double, rare array<struct<word: binary, times: long>>")


def _pages(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """k, page, cells of (slot, turn) counts, in the least whole type that holds a page's counts."""
    for k, table in tables.items():
        for page, cells in enumerate(table.reshape(-1, min(2 * PAGE, len(table)))):
            most = float(cells.max())
            if most:
                kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.float64
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([page], pa.int32()), pa.array([cells.astype(kind).tobytes()], pa.binary())], ["k", "page", "cells"])


def _count_bytes(words: DataFrame, column: str, code: Code, bits: list[int], tasks: int) -> DataFrame:
    """Pages of ORDERS' tables, from the words that are spelled and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros(2 << b, dtype=np.float32) for k, b in enumerate(bits[:PAIRS])}
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                rows = batch.slice(at, 1 << 13)
                made = [(p, c) for w, c in zip(rows.column("word").to_pylist(), rows.column("c").to_pylist(), strict=True) if w and w not in code.leaf for p in shortened([w])]
                for k in range(0, len(made), 1 << 11):
                    parts, c = zip(*made[k : k + (1 << 11)], strict=True)
                    of, turn, contexts = spelled(code, list(parts))
                    weight = np.array(c, dtype=np.float32)[of]
                    for j, hashed in enumerate(contexts):
                        np.add.at(tables[j], slots(hashed, j, bits[j]) * 2 + turn, weight)
        yield from _pages(tables)

    some = words.where(F.col(column) > 0).select("word", F.col(column).alias("c"))
    return some.coalesce(tasks).mapInArrow(run, "k int, page int, cells binary")


def _count_pairs(docs: DataFrame, code: Code, bits: list[int], tasks: int) -> DataFrame:
    """Pages of the word-pair table, from texts (numbered here, if they are not)."""
    docs = docs if "tokens" in docs.columns else numbered(docs, code, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 << bits[PAIRS], dtype=np.uint32)
        for batch, _ in laid_tokens(code, batches):
            slot = slots(batch.pair, PAIRS, bits[PAIRS])
            slot *= 2
            slot += batch.turn
            np.add.at(table, slot, np.uint32(1))
        yield from _pages({PAIRS: table})

    return docs.select("tokens", "units").coalesce(tasks).mapInArrow(run, "k int, page int, cells binary")


def _summed(pages: DataFrame) -> DataFrame:
    """k, page, part (slots' bytes without the documents that tune), whole (with them); pages have a column tune."""

    def slot_bytes(n: np.ndarray) -> bytes:
        n = n.reshape(-1, 2)
        return np.clip(np.round(np.log((n[:, 1] + 0.1) / (n[:, 0] + 0.1)) * UNIT), -127, 127).astype(np.int8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, 1))

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([slot_bytes(sums[0])], pa.binary()), pa.array([slot_bytes(sums[0] + sums[1])], pa.binary())], ["k", "page", "part", "whole"])

        for batch in batches:
            for k, page, tune, cells in zip(*(batch.column(c).to_pylist() for c in ("k", "page", "tune", "cells")), strict=True):
                if (k, page) != now:
                    if now is not None:
                        yield row()
                    now, sums = (k, page), np.zeros((2, 2 * PAGE))
                kind = {2 * PAGE: np.uint8, 4 * PAGE: np.uint16, 16 * PAGE: np.float64}[len(cells)]
                sums[int(tune)] += np.frombuffer(cells, dtype=kind)
        if now is not None:
            yield row()

    placed = pages.repartition("k", "page").sortWithinPartitions("k", "page")
    return placed.mapInArrow(run, "k int, page int, part binary, whole binary")


def fit(docs: DataFrame, words: DataFrame, code: Code, distinct: int, size: int, tokens: DataFrame) -> Model:
    """The model; docs: text, learn, tune; words: word, c, t; size: bytes to learn from; tokens: docs as `numbered` has them."""
    grown = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, distinct))) + 1))
    bits = [*(b or grown for _, b in ORDERS), grown]
    tasks, by_words = -(-size // TASK_BYTES) + 1, -(-distinct // TASK_WORDS) + 1
    parts = [
        _count_bytes(words.withColumn("c", F.col("c") - F.col("t")), "c", code, bits, by_words).withColumn("tune", F.lit(False)),
        _count_bytes(words, "t", code, bits, -(-by_words // 4)).withColumn("tune", F.lit(True)),
        _count_pairs(tokens.where("learn and not tune"), code, bits, tasks).withColumn("tune", F.lit(False)),
        _count_pairs(tokens.where("learn and tune"), code, bits, -(-tasks // TUNE)).withColumn("tune", F.lit(True)),
    ]
    pages = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    part, whole = ([np.zeros(1 << b, dtype=np.int8) for b in bits] for _ in range(2))
    for r in written(_summed(pages), "lm-tables").toLocalIterator():  # two bytes a slot, of 2 ** MOST_BITS slots at most
        at = slice(r["page"] * PAGE, (r["page"] + 1) * PAGE)
        part[r["k"]][at] = np.frombuffer(r["part"], dtype=np.int8)
        whole[r["k"]][at] = np.frombuffer(r["whole"], dtype=np.int8)
    weights, refine = tuned(docs.where("learn and tune"), Model(code, part, *fresh()))
    return Model(code, whole, weights, refine)


def tuned(docs: DataFrame, model: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights and refinements learnt online from docs: each task goes through its texts, and the tasks' results are averaged by decisions."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(sent.value.code, sent.value.tables, *fresh())
        n = learn(mine, (text for batch in batches for text in map(bytes, utf8(batch, "text").to_pylist())))
        state = np.concatenate([a.ravel() for a in (*mine.weights, *mine.refine)]).astype(np.float64) * n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(state)), pa.int32()), pa.array(state), pa.array(np.full(len(state), n), pa.int64())], ["at", "state", "n"])

    made = docs.select("text").mapInArrow(run, "at int, state double, n long").groupBy("at").agg((F.sum("state") / F.nullif(F.sum("n"), F.lit(0))).alias("state"))
    out = [*model.weights, *model.refine]
    flat = np.concatenate([a.ravel() for a in out])
    for r in made.collect():  # a row for each weight and cell
        if r["state"] is not None:
            flat[r["at"]] = r["state"]
    sent.destroy()
    parts = [p.reshape(a.shape) for p, a in zip(np.split(flat, np.cumsum([a.size for a in out])[:-1]), out, strict=True)]
    return parts[:2], [np.clip(p, 1e-4, 1 - 1e-4) for p in parts[2:]]


def score(docs: DataFrame, allowed: F.Column) -> DataFrame:
    """doc_id, n_tokens, n_bytes, n_known, train_tokens, base_score, score, bits_per_byte; allowed: the rows that may be learnt from."""
    spark = docs.sparkSession
    tune = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(97)), F.lit(TUNE)) == 0
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(allowed, F.lit(False)).alias("learn"), tune.alias("tune"))
    words = written(count_words(marked), "words")
    distinct, total, size = words.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") * (F.octet_length("word") + 1)), F.lit(0))).first()
    found = words.orderBy(F.col("word") != b"", F.desc("c"), "word").limit(max(FREQUENT, VOCABULARY + 1)).select("word", "c").toArrow()
    top = list(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True))
    code = code_of(words, top, total)
    bottom = math.log10(total + 0.1 * (distinct + 1)) if distinct else math.log10(0.1)
    ends = sum(c for w, c in top if not w)
    at_hand = {w: math.log10(c + 0.1) - bottom for w, c in top[:FREQUENT] if w and c > 0 and w in code.leaf} | {b"": math.log10(ends + 0.1) - bottom}
    tokens = written(numbered(marked, code, at_hand).withColumn("rid", F.monotonically_increasing_id()), "lm-tokens")
    model = fit(marked, words, code, distinct, size, tokens)
    sent = spark.sparkContext.broadcast(model)
    kept = {"rid": "long", "doc_id": "long", "n_tokens": "long", "n_bytes": "long", "n_known": "long", "base": "double"}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(token_scores(sent.value, iter([batch])), pa.float64())], [*kept, "score"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = word_spellings(sent.value, batch.column("word").to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs)], ["word", "c", "spelling"])

    schema = ", ".join(f"{c} {kind}" for c, kind in (kept | {"score": "double"}).items())
    scored = written(map_slices(tokens.select(*kept, "tokens", "units"), each, schema, "tokens"), "lm-scored")
    each_word = words.where("word <> X''").select("word", "c").mapInArrow(spell, "word binary, c long, spelling double")
    asked = tokens.select("rid", F.inline("rare")).join(each_word, "word")
    more = asked.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * (F.log10(F.col("c") + 0.1) - bottom)).alias("rest"), F.sum(F.col("times") * F.col("spelling")).alias("spelt")
    )
    whole = scored.join(more, "rid", "left").withColumn("score", F.col("score") + F.coalesce("spelt", F.lit(0.0)))
    return whole.select(
        "doc_id", "n_tokens", "n_bytes", (F.col("n_known") - int(not ends) + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
