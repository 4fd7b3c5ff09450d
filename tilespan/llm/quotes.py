"""Quotation linking: conversations in reply order, without their quotes.

A line's quote level is the number of ">" before it. Runs of lines of one level are passages; a passage, and each
of its lines, is normalised (lower case, letters and numbers only) and hashed. The same hashes of every message's
own words (all of them, each paragraph, each line) point to the earliest message of the conversation that has them.
A quoted hash that meets an earlier message links to it. The message replies to the best link of its first-level
passages: passages before single lines, longer before shorter, later before earlier. Reply links are followed to
the message that began the thread, by doubling.

Everything is DataFrame expressions. Hashes are pre-aggregated to one row for each conversation and hash before
they are joined, so a frequent line or a long conversation makes no pairs.

Defined cases: a null text is the empty text; rows with a null conv_id or turn, or a passage without letters and
numbers, link to nothing; rows that repeat conv_id and turn are one message for links (the least turn it may reply
to counts) and stay as rows; an introduction ("On ... wrote:") right before a quote goes with it; an empty table
gives an empty result; other columns are kept by `linked`, unless they have the name of one that it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespan.llm.common import written

ADDED = ("own_text", "max_level", "n_passages", "n_linked", "reply_to", "thread_turn", "reply_depth")
_QUOTE = r"^[ \t]{0,3}((?:>[ \t]?)+)"
_INTRO = r"(?i)^[ \t]*on\b.{1,200}\bwrote:[ \t]*$"


def _level(line: F.Column) -> F.Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 1), "[^>]", ""))


def _normal(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(turns: DataFrame) -> DataFrame:
    """turns with lines (array of level and content, introductions of quotes left out), own_text and max_level."""
    raw = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    lines = turns.withColumn("_raw", F.transform(raw, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("content"))))
    intro = lambda x, k: (x.level == 0) & x.content.rlike(_INTRO) & (F.coalesce(F.try_element_at("_raw", k + 2).level, F.lit(0)) > 0)
    lines = lines.withColumn("lines", F.filter("_raw", lambda x, k: ~intro(x, k))).drop("_raw")
    own = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.content), "\n")
    own = F.when(F.exists("lines", lambda x: x.level > 0), F.trim(F.regexp_replace(own, "\n{3,}", "\n\n"))).otherwise(own)
    return lines.withColumn("own_text", own).withColumn("max_level", F.coalesce(F.array_max(F.transform("lines", lambda x: x.level)), F.lit(0)))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, run, rank (2: a whole passage, 1: a line of it), hash, size."""
    quoting = messages.where("max_level > 0 and conv_id is not null and turn is not null")
    lines = quoting.select("mid", "conv_id", "turn", F.posexplode("lines").alias("at", "line")).select("mid", "conv_id", "turn", "at", "line.level", "line.content").where("level > 0")
    run = F.col("at") - F.row_number().over(Window.partitionBy("mid", "level").orderBy("at"))
    runs = lines.withColumn("run", run).groupBy("mid", "conv_id", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("lines"))
    texts = F.transform("lines", lambda x: _normal(x.content))
    each = F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.struct(F.lit(1).alias("rank"), x.alias("norm")))
    whole = F.array(F.struct(F.lit(2).alias("rank"), _normal(F.array_join(texts, " ")).alias("norm")))
    keys = runs.select("mid", "conv_id", "turn", "level", "run", F.inline(F.concat(whole, each))).where("norm <> ''")
    return keys.select("mid", "conv_id", "turn", "level", "run", "rank", F.sha2("norm", 256).alias("hash"), F.length("norm").alias("size"))


def originals(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, hash, origin: the earliest turn whose own words have the hash, for conversations in which something is quoted."""
    own = messages.where("conv_id is not null and turn is not null and own_text <> ''").join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    texts = F.array_union(F.array("own_text"), F.array_union(F.split("own_text", r"\n\s*\n"), F.split("own_text", "\n")))
    keys = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(texts, _normal))).alias("norm")).where("norm <> ''")
    return keys.groupBy("conv_id", F.sha2("norm", 256).alias("hash")).agg(F.min("turn").alias("origin"))


def _threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to -> conv_id, turn, thread_turn, reply_depth, doubling the way back in each round."""
    now = written(replies.select("conv_id", "turn", F.col("reply_to").alias("thread_turn"), F.lit(1).alias("reply_depth")), "replies")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("further"), F.col("reply_depth").alias("more"))
        step = now.join(up, ["conv_id", "thread_turn"], "left")
        if step.where("further is not null").isEmpty():
            return now
        now = written(step.select("conv_id", "turn", F.coalesce("further", "thread_turn").alias("thread_turn"), (F.col("reply_depth") + F.coalesce("more", F.lit(0))).alias("reply_depth")), "replies")


def linked(turns: DataFrame) -> DataFrame:
    """turns with own_text, max_level, n_passages, n_linked, reply_to, thread_turn and reply_depth; (thread_turn, turn) is the reply order."""
    base = turns.drop(*(c for c in ADDED if c in turns.columns))
    messages = parsed(base.withColumn("mid", F.monotonically_increasing_id()))
    keys = written(passages(messages), "passages")
    found = keys.join(originals(messages, keys), ["conv_id", "hash"]).where("origin < turn")
    counts = keys.groupBy("conv_id", "turn").agg(F.countDistinct("mid", "level", "run").alias("n_passages"))
    links = found.groupBy("conv_id", "turn").agg(F.countDistinct("mid", "level", "run").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.struct("rank", "size", "origin")))["origin"].alias("reply_to"))
    links = written(counts.join(links, ["conv_id", "turn"], "left"), "quote-links")
    threads = _threads(links.where("reply_to is not null"))
    found = links.join(threads, ["conv_id", "turn"], "left")
    out = parsed(base).drop("lines").join(found, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*base.columns, "own_text", F.col("max_level").cast("int").alias("max_level"), zero("n_passages"), zero("n_linked"), "reply_to", F.coalesce("thread_turn", "turn").alias("thread_turn"), zero("reply_depth"))
