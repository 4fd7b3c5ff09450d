"""The numbered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tilespan.llm import byte_bpe, decontaminate, exact_dedup, filter_audit, gam, hilbert_ann, mixing_lm, packing, prefix_trie, quotes, simhash, text_cnn, warc
from tilespan.llm.common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = gam.fit(docs, _table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 4) != 2)
    found = gam.score(docs, model, columns=["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(_table(spark, sf_dir, "conversations")).drop("text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing_lm.score(_table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return found.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = text_cnn.fit(docs, _table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 3) != 1)
    found = text_cnn.score(docs, net, columns=["doc_id", "lang"])
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "flagged")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_hilbert": op2_hilbert,
    "op3_simhash": op3_simhash,
    "op4_quotes": op4_quotes,
    "op5_packing": op5_packing,
    "op6_mixing_lm": op6_mixing_lm,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc": op10_warc,
    "op11_decontaminate": op11_decontaminate,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM q
    """,
    "op11_decontaminate": r"""
        WITH lowered AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, lowered),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, lowered),
        starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
        wins AS (SELECT DISTINCT item, w[s : s + 9] AS win FROM starts),
        sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
        places AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
        grams AS (SELECT rid, n, s, w[s : s + n - 1] AS win FROM places),
        seen AS (SELECT rid, n, s, item FROM grams JOIN wins USING (win)),
        hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, n, s FROM seen)) GROUP BY rid),
        named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM seen) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
    """,
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT t.doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
                   100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                   coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM t LEFT JOIN marks ON t.doc_id = marks.doc_id
        ),
        g AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
        letters AS (SELECT unnest(range(1, 6)) AS i),
        orders AS (
            SELECT [p.i, q.i, r.i, s.i, u.i] AS ord FROM letters p, letters q, letters r, letters s, letters u
            WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5
        ),
        steps AS (SELECT ord, step, ord[step] AS own, ord[: step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
        seen AS (
            SELECT part, ord, step, own, n, good, toxic, fails[own] AS fails_it, len(list_filter(before, lambda x: fails[x])) > 0 AS gone,
                   len(list_filter(fails, lambda x: x)) AS n_fails
            FROM g, steps
        ),
        found AS (
            SELECT part, ord, step, own, sum(n) FILTER (NOT gone AND NOT fails_it) AS kept, sum(n) FILTER (NOT gone AND fails_it) AS removed,
                   sum(n) FILTER (gone AND fails_it) AS redundant, sum(n) FILTER (fails_it AND n_fails = 1) AS unique_fails,
                   sum(good) FILTER (NOT gone AND fails_it) AS good_lost, sum(toxic) FILTER (NOT gone AND fails_it) AS toxic_lost
            FROM seen GROUP BY ALL
        )
        SELECT part, array_to_string(list_transform(ord, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
               CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
               CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
               CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
        FROM found
    """,
    "op13_prefix_trie": """
        WITH own AS (
            SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        lists AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM own GROUP BY conv_id),
        sums AS (
            SELECT conv_id, turns, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT),
                   lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, bit: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 6 AS h
            FROM lists
        ),
        made AS (
            SELECT s.conv_id, coalesce(b.turns[: s.h], []) || s.turns[s.h + 1 :] AS turns
            FROM sums s LEFT JOIN lists b ON b.conv_id = s.conv_id - s.conv_id % 100
        ),
        member AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM made),
        keyed AS (SELECT conv_id, size, depth, turns[: depth] AS key FROM member),
        node AS (
            SELECT depth, key, min(conv_id) AS owner, count(*) AS n_convs, length(any_value(key[depth].text)) AS points,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
            FROM keyed GROUP BY depth, key
        ),
        above AS (SELECT n.*, p.owner AS parent FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.key = n.key[: n.depth - 1]),
        kids AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM above WHERE depth > 0 GROUP BY ALL),
        full_node AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM above a LEFT JOIN kids USING (owner, depth)),
        tree AS (
            SELECT v.owner, v.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * coalesce(u.points, 0)) AS saved_tokens
            FROM full_node u JOIN keyed k ON k.conv_id = u.owner AND k.depth <= u.depth JOIN node v ON v.depth = k.depth AND v.key = k.key
            GROUP BY v.owner, v.depth
        )
        SELECT owner AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM full_node JOIN tree USING (owner, depth)
    """,
}
