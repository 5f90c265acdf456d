"""Chat formatting by quotation linking, in DataFrame functions only.

A line that opens with ``>`` marks is quoted, its level the number of marks. Runs of
lines of one level are passages (blank lines part them). A passage is normalised
(lower case, single spaces) and hashed, as is each of its lines, for quotes in part.
The hashes are joined to the first earlier message of the same conversation that holds
the passage or line unquoted. A message replies to the source of its shallowest quote;
of several, the longest, then the latest. Replies form threads: a thread is named by
the turn of its first message, and ordering by ``(conv_id, thread_turn, turn)`` puts
every reply after what it replies to.

Sources are reduced to one row a conversation and hash before the join, so a passage
that everybody quotes makes no pairs; conversations are never gathered in one task.

Null texts have no quotes and stay null. Messages without a conversation or a turn
have no links. Repeated rows of a turn share its links. Quotes without a source are
still taken out of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_MARKS = r"^[ \t]*(?:>[ \t]?)+"


def _normalised(text: Column) -> Column:
    # a single blank needs no replacing
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]{2,}|[\t\r\n]", " "))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Adds ``lines``, array of (level, body, blank), and ``passages``, array of (level, body), blank ones left out."""

    def line(x: Column) -> Column:
        # only lines with a mark anywhere meet the patterns
        marked = x.contains(">")
        level = F.length(F.regexp_replace(F.regexp_extract(x, rf"({_MARKS})", 1), "[^>]", ""))
        return F.struct(F.when(marked, level).otherwise(0).alias("level"), F.when(marked, F.regexp_replace(x, _MARKS, "")).otherwise(x).alias("body"))

    def told(x: Column) -> Column:
        return F.struct(x["level"].alias("level"), x["body"].alias("body"), (F.trim(F.translate(x["body"], "\t\r", "  ")) == "").alias("blank"))

    lined = messages.withColumn("lines", F.transform(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), told))
    lines = F.col("lines")
    other = lambda x, y: (x["level"] != y["level"]) | (x["blank"] != y["blank"])
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | other(x, F.get(lines, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
    begun = lined.withColumn("starts", starts)
    at = F.col("starts")
    size = lambda s, j: F.coalesce(F.get(at, j + 1), F.size(lines)) - s
    body = lambda s, j: F.array_join(F.transform(F.slice(lines, s + 1, size(s, j)), lambda x: x["body"]), "\n")
    passage = lambda s, j: F.when(~F.get(lines, s)["blank"], F.struct(F.get(lines, s)["level"].alias("level"), body(s, j).alias("body")))
    return begun.withColumn("passages", F.filter(F.transform(at, passage), lambda x: x.isNotNull())).drop("starts")


def _units(passage: Column) -> Column:
    """The normalised passage and its normalised lines, as (level, hash, size)."""
    body = passage["body"]
    parts = F.filter(F.transform(F.split(body, "\n"), _normalised), lambda x: x != "")
    units = F.when(body.contains("\n"), F.array_distinct(F.concat(F.array(_normalised(body)), parts))).otherwise(F.array(_normalised(body)))
    return F.transform(units, lambda u: F.struct(passage["level"].alias("level"), F.unhex(F.sha2(u, 256)).alias("hash"), F.length(u).alias("size")))


def read_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, max_level, units): each message parsed once.

    ``text`` is without quotes; ``units`` are the hashed passages and lines of its quotes and of itself.
    """
    parsed = parse_quotes(messages.select("conv_id", "turn", "role", "text"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return parsed.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("text").isNotNull(), F.regexp_replace(own, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")).alias("text"),
        F.size(F.filter("passages", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.flatten(F.transform("passages", _units)).alias("units"),
    )


def reply_links(read: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): one row a message that quotes a source."""
    placed = read.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("units").alias("u"))
    hashed = placed.select("conv_id", "turn", "u.level", "u.hash", "u.size")
    sources = hashed.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    met = hashed.where("level > 0").join(sources, ["conv_id", "hash"]).where("source < turn")
    best = met.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("depth"), "size", "source")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.source").alias("reply_to"))


def thread_links(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread_turn, depth) by pointer doubling over the replies."""
    now = cut(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("further"), F.col("depth").alias("more"))
        joined = cut(now.join(up, ["conv_id", "thread_turn"], "left"))
        if joined.where("further IS NOT NULL").isEmpty():
            return now
        now = joined.select("conv_id", "turn", "reply_to", F.coalesce("further", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, thread_turn, depth, turn, reply_to, role, text, n_quotes, max_level), in reply order.

    ``messages`` has ``conv_id, turn, role, text``; the returned text has no quotes and no
    blank lines around it.
    """
    read = cut(read_messages(messages))
    threads = thread_links(reply_links(read))
    joined = read.drop("units").join(threads, ["conv_id", "turn"], "left")
    return joined.select("conv_id", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "turn", "reply_to", "role", "text", "n_quotes", "max_level").orderBy("conv_id", "thread_turn", "turn")
