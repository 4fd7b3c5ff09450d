import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilespan.llm import prefix_trie

_SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved, out = {}, {}, []
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) if kids[key] else 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(saved[k] for k in kids[key])
        ends = ",".join(str(c) for c in members[key] if len(made[c]) == len(key))
        out.append((members[key][0], len(key), members[key[:-1]][0] if key else None, len(members[key]), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _found(spark, rows):
    df = prefix_trie.nodes(spark.createDataFrame(rows, _SCHEMA))
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def _random(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, n, 2), 100, 101, 105, 207, 399, 450, -3, -100, -107]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "hé", "yes", "no 🙂", None])))
    rows += [(6, None, "user", "first"), (6, 0, "user", "again"), (6, 0, "user", "again"), (None, 1, "user", "x"), (8, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nodes_are_those_of_a_plain_trie(spark, seed):
    rows = _random(seed)
    assert _found(spark, rows) == _plain(rows)


def test_a_long_conversation_spans_ranges_and_batches(spark, monkeypatch):
    rows = [(4, t, "user", f"t{t % 7}") for t in range(900)] + [(40, t, "user", f"t{t % 7}") for t in range(500)] + _random(4, 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _found(spark, rows) == _plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", "same") for c in range(1000, 1400) for t in range(7)] + [(c, 0, "user", "same") for c in range(2000, 2100)]
    assert _found(spark, rows) == _plain(rows)


def test_no_rows_and_other_columns(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(None, 1, "user", "x")]) == []
    rows = _random(5, 20)
    more = spark.createDataFrame(rows, _SCHEMA).withColumn("pos", F.lit("x")).withColumn("part", F.lit(1)).withColumn("owner", F.lit(1))
    assert sorted(tuple(r) for r in prefix_trie.nodes(more).collect()) == _plain(rows)


def test_ids_are_hashed_in_pieces(spark):
    members = spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") % 2).alias("depth"), (F.col("id") * 37 - 5000).alias("member"))
    found = {(r.conv_id, r.depth): r.digest for r in prefix_trie.ids_digests(members, piece=100).collect()}
    for d in (0, 1):
        ids = sorted(i * 37 - 5000 for i in range(1000) if i % 2 == d)
        assert found[1, d] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
