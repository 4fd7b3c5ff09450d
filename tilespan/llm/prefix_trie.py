"""Conversation prefix trie: every distinct beginning of a conversation as a node, with figures of its subtree.

A prefix is known by a running digest of its turns: the exclusive-or of two 64-bit hashes of each turn's place, role and
text. Running digests of a conversation of any length are computed over ranges of turns, without bringing it together.
The least conversation of each (depth, digest) owns that node. A conversation that owns a depth owns all deeper ones, so
its first owned depth is found by binary search: each round joins one probe a conversation to the table of prefix
minima. What a conversation owns is a chain; it hangs on the node above its first owned depth, and a conversation that
owns nothing hangs on the node of its last turn.

Chains are aggregated bottom-up with doubling: each round adds the sums of chains 2^k steps below and doubles the way
up, so the rounds grow with the logarithm of the tree's height. A node's figures follow from what hangs on its chain at
its depth or deeper, by a running sum over ranges of nodes. For saved_tokens: below a node that has r other members and
b code points above it, these members' texts hold T code points in all and O of them on nodes they own, so T - r * b - O
are saved.

Members that end at a node are hashed as text: runs of ids are joined within ranges, and the pieces, not the ids, are
brought together and streamed through the hash.

Defined cases: rows with a null conv_id are left out; turns are ordered by turn (null first), then role, then text, so
repeated turns are turns of their own; a null role or text is empty; a conversation without turns is a member of the
root alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tilespan.llm.common import written

#: Characters of one piece of a list of ids.
PIECE = 1 << 16
#: Probes that may be broadcast, in rows of five numbers; more are shuffled.
FEW = 20_000
_ROW, _HEAD, _TAIL = 0, 1, 2


def running(df: DataFrame, key: str, order: list[Column], keep: list[str], sums: list[str], name: str, wrapped: tuple[str, ...] = ()) -> DataFrame:
    """key, keep and sums (long columns) as running totals over each key's rows in the given order; those of wrapped are exclusive-or sums.

    Rows are dealt by ranges of (key, order), so a key of any size is spread. Each range also gives its first and last
    key with the latter's total; from these (two rows a range) comes what earlier ranges carry into a range's first key.
    """
    schema = df.select(key, *keep, *sums).schema.add("part", "integer").add("mark", "integer")
    arrow = to_arrow_schema(schema)

    def marked(value: object, totals: dict[str, int], part: int, mark: int) -> pa.RecordBatch:
        row = {key: value, **totals, "part": part, "mark": mark}
        return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            if last is None:
                yield marked(keys[0], held, part, _HEAD)
            new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            columns = {c: batch.column(c) for c in (key, *keep)} | {"part": np.full(len(keys), part), "mark": np.full(len(keys), _ROW)}
            for c in sums:
                value = batch.column(c).to_numpy(zero_copy_only=False)
                total = np.append(0, np.bitwise_xor.accumulate(value) if c in wrapped else np.cumsum(value))
                # A run that began in an earlier batch goes on from what is held.
                before = np.where(start < 0, 0, total[np.maximum(start, 0)])
                more = np.where(start < 0, held[c], 0)
                columns[c] = total[1:] ^ before ^ more if c in wrapped else total[1:] - before + more
                held[c] = int(columns[c][-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        if last is not None:
            yield marked(last, held, part, _TAIL)

    for f in schema:
        f.nullable = True
    dealt = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(key, *keep, *sums)
    rows = written(dealt.mapInArrow(local, schema), name)
    earlier = Window.partitionBy(key).orderBy("part", "mark").rowsBetween(Window.unboundedPreceding, -1)
    into = [(F.bit_xor(c) if c in wrapped else F.sum(c)).over(earlier).alias(f"carried_{c}") for c in sums]
    carried = rows.where(F.col("mark") != _ROW).select(key, "part", "mark", *into).where(F.col("mark") == _HEAD).where(F.col(f"carried_{sums[0]}").isNotNull()).drop("mark")
    out = rows.where(F.col("mark") == _ROW).join(F.broadcast(carried), [key, "part"], "left")  # at most one row a range
    add = lambda c: F.coalesce(f"carried_{c}", F.lit(0))
    return out.select(key, *keep, *((F.col(c).bitwiseXOR(add(c)) if c in wrapped else F.col(c) + add(c)).alias(c) for c in sums))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: conv_id of each, and conv_id, pos (from 1), turn_hash, points of their turns.

    Conversation c begins with the first h turns of c - c % 100 (h: crc32 of c as text, mod 6) and goes on with its own
    after its first h.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("turn_hash"), F.length(text).cast("long").alias("points"), F.lit(1).cast("long").alias("pos"),
    )
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")], ["turn_hash", "points"], ["pos"], "placed")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = written(placed.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100), "conversations")
    heads = placed.where("conv_id % 100 = 0 and pos <= 5").withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "turn_hash", "points")
    # A base of fewer than h turns moves what follows forward.
    short = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    short = short.select("conv_id", (F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0)))).alias("gap")).where("gap > 0")
    own = placed.where(F.col("pos") > h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "turn_hash", "points")
    return convs.select("conv_id"), taken.union(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, points, cum (code points so far) and the running digest k0, k1 of each turn of turns (conv_id, pos, turn_hash, points)."""
    keyed = turns.withColumn("k0", F.xxhash64(F.lit(1), "pos", "turn_hash")).withColumn("k1", F.xxhash64(F.lit(2), "turn_hash", "pos")).withColumn("cum", F.col("points"))
    return written(running(keyed, "conv_id", [F.col("pos")], ["pos", "points"], ["k0", "k1", "cum"], "prefixes", ("k0", "k1")), "prefixes")


def chains(convs: DataFrame, found: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, size (turns), total (code points), first (owned depth; beyond size: none), parent (owner of the node above it), above (code points to there), owning."""
    sizes = found.groupBy("conv_id").agg(F.max("pos").alias("size"), F.max("cum").alias("total"))
    state = convs.join(sizes, "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total", F.lit(0)).alias("total"))
    root = state.agg(F.min("conv_id")).first()[0]
    long = lambda v: F.lit(v).cast("long")
    state = written(state.select("*", long(1).alias("low"), (F.col("size") + 1).alias("high"), long(root).alias("parent"), long(0).alias("above")), "search")
    probe = found.select("conv_id", F.col("pos").alias("mid"), "k0", "k1", "cum")
    least = minima.select(F.col("pos").alias("mid"), "k0", "k1", "owner")
    while left := state.where("low < high").count():
        asked = state.where("low < high").withColumn("mid", F.floor((F.col("low") + F.col("high")) / 2))
        asked = F.broadcast(asked) if left <= FEW else asked  # the last rounds ask for long conversations alone
        got = asked.join(probe, ["conv_id", "mid"]).join(least, ["mid", "k0", "k1"])
        owns = F.col("owner") == F.col("conv_id")
        step = lambda yes, no, name: F.when(owns, yes).otherwise(no).alias(name)
        got = got.select("conv_id", "size", "total", step(F.col("low"), F.col("mid") + 1, "low"), step(F.col("mid"), F.col("high"), "high"), step(F.col("parent"), F.col("owner"), "parent"), step(F.col("above"), F.col("cum"), "above"))
        state = written(state.where("low >= high").union(got), "search")
    top = F.col("conv_id") == long(root)
    return state.select("conv_id", "size", "total", F.when(top, long(0)).otherwise(F.col("low")).alias("first"), F.when(~top, F.col("parent")).alias("parent"), "above", (top | (F.col("low") <= F.col("size"))).alias("owning"))


def subtree_sums(found: DataFrame) -> DataFrame:
    """found (conv_id, parent, sums n, t, o, l) with the sums over each chain and all below it: doubles the way up in each round."""
    cols = ["n", "t", "o", "l"]
    now = found.select("conv_id", F.col("parent").alias("up"), *cols)
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(c).alias(f"more_{c}") for c in cols))
        further = now.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        step = now.join(below, "conv_id", "left").join(further, "up", "left")
        now = written(step.select("conv_id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in cols)), "subtrees")
    return now.select("conv_id", *cols)


def ids_digests(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, digest: SHA-256 of the decimal ids (column member) of each (conv_id, depth), ascending, comma-joined."""
    cuts = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
    names = ["conv_id", "depth", "digest"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, piece // 20)
        for batch in batches:
            owner, depth, member = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
            ends = np.flatnonzero(np.append((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1]), True)) + 1 if len(owner) else []
            rows, start = [], 0
            for end in map(int, ends):
                for a in range(start, end, most):
                    rows.append((owner[a], depth[a], member[a], ",".join(map(str, member[a : min(end, a + most)].tolist()))))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(cuts)], schema=cuts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if at == (owner, depth):
                    state.update(b"," + ids.encode())
                    continue
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (owner, depth), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, state.hexdigest())], names)

    pieces = members.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member").select("conv_id", "depth", "member").mapInArrow(joined, "conv_id long, depth long, least long, ids string")
    dealt = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least")
    return dealt.mapInArrow(hashed, "conv_id long, depth long, digest string")


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per distinct prefix of the rebuilt conversations."""
    convs, turns = rebuilt(conversations)
    found = prefixes(turns)
    minima = written(found.groupBy("pos", "k0", "k1").agg(F.min("conv_id").alias("owner"), F.first("points").alias("points"), F.first("cum").alias("cum")), "minima")
    tree = chains(convs, found, minima)
    hung = tree.where("parent is not null")
    branches = hung.where("owning").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("size")).agg(F.count("*").alias("branches"))
    tree = tree.join(branches, ["conv_id", "size"], "left")
    leaf = (F.col("owning") & F.col("branches").isNull()).cast("long")
    tree = written(tree.select("conv_id", "size", "first", "parent", "owning", F.lit(1).cast("long").alias("n"), F.col("total").alias("t"), (F.col("total") - F.col("above")).alias("o"), leaf.alias("l")), "chains")
    whole = subtree_sums(tree)
    hung = tree.where("parent is not null").select("conv_id", "parent", (F.col("first") - 1).alias("depth"), F.col("owning").cast("long").alias("kids")).join(whole, "conv_id")
    hung = hung.groupBy(F.col("parent").alias("conv_id"), "depth").agg(*(F.sum(c).alias(c) for c in ("kids", "n", "t", "o", "l")))
    each = minima.select(F.col("owner").alias("conv_id"), F.col("pos").alias("depth"), (F.col("cum") - F.col("points")).alias("before"))
    each = each.union(tree.where("parent is null").select("conv_id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    each = each.join(hung, ["conv_id", "depth"], "left").select("conv_id", "depth", "before", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("kids", "n", "t", "o", "l")))
    below = running(each, "conv_id", [F.col("depth").desc()], ["depth", "before", "kids"], ["n", "t", "o", "l"], "nodes")
    facts = tree.where("owning").select("conv_id", "size", "first", "parent", F.col("l").alias("leaf"))
    ends = ids_digests(tree.select(F.when(F.col("owning"), F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.col("size").alias("depth"), F.col("conv_id").alias("member")))
    out = below.join(facts, "conv_id").join(ends, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        (F.col("n") + 1).alias("n_convs"), (F.col("kids") + (F.col("depth") < F.col("size")).cast("long")).alias("n_children"), (F.col("leaf") + F.col("l")).alias("n_leaves"),
        (F.col("t") - F.col("n") * F.col("before") - F.col("o")).alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
