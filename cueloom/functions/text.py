"""Text shaping as Column functions: words, wrapping, chunks and non-speech."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecode import strip

#: Words that mark the absence of speech when they carry a whole annotation.
NON_SPEECH = ("blank audio", "silence", "silent", "no speech", "inaudible", "unintelligible", "music", "noise", "applause", "laughter", "laughs", "static")
#: Signs that stand for music.
NOTES = "♪♫〽"


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def split_lines(text: Column) -> Column:
    """Lines of a text without the empty ones at its end; an empty text is one empty line."""
    body = F.regexp_replace(text, r"(\r?\n)+\z", "")
    return F.split(body, r"\r?\n")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def line_words(lines: Column) -> Column:
    """Words of all lines of a cue, in order."""
    return words(F.array_join(lines, " "))


def content_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def text_length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))


def wrap_line(text: Column, width: int | None) -> Column:
    """Greedy wrap that leaves long words whole; a text that fits is returned as it is."""
    if width is None or width <= 0:
        return F.array(text)
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        fits = acc["cur"].isNotNull() & (F.length(acc["cur"]) + 1 + F.length(w) <= width)
        done = F.when(acc["cur"].isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat_ws(" ", acc["cur"], w)).otherwise(w).alias("cur"))

    wrapped = F.aggregate(words(text), empty, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))
    return F.when(F.length(text) <= width, F.array(text)).otherwise(wrapped)


def wrapped(tokens: list[str], width: int) -> list[str]:
    """Greedy wrap that cuts a word longer than a line into pieces."""
    out, cur = [], ""
    for w in tokens:
        if cur and len(cur) + 1 + len(w) <= width:
            cur = f"{cur} {w}"
            continue
        if cur:
            out.append(cur)
        while len(w) > width:
            out.append(w[:width])
            w = w[width:]
        cur = w
    return [*out, cur] if cur else out


def wrap_words(tokens: Column, width: int) -> Column:
    """``wrapped`` over batches: a fold in expressions costs some forty times as much a word."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if ws is None else wrapped(list(ws), width) for ws in batch])

    return run(tokens)


def chunked(n: int, tokens: list[str]) -> list[list[str]]:
    """At most n groups of words with about equal numbers of characters."""
    total = sum(map(len, tokens))
    if n <= 1 or len(tokens) < 2 or not total:
        return [tokens]
    groups, cur, size = [], [], 0
    for w in tokens:
        cur.append(w)
        size += len(w)
        if size * n >= total and len(groups) + 1 < n:
            groups.append(cur)
            cur, size = [], 0
    return [*groups, cur] if cur else groups


def chunk_lines(n: Column, tokens: Column, width: int | None) -> Column:
    """Array of (len, lines): the balanced groups of a cue's words, wrapped where a width is given."""

    @F.pandas_udf("array<struct<len:bigint,lines:array<string>>>")
    def run(counts: pd.Series, batch: pd.Series) -> pd.Series:
        made = []
        for k, ws in zip(counts, batch, strict=True):
            groups = chunked(int(k), list(ws))
            made.append([{"len": sum(map(len, g)), "lines": wrapped(g, width) if width else [" ".join(g)]} for g in groups])
        return pd.Series(made)

    return run(n, tokens)


def wrap_lines(lines: Column, width: int) -> Column:
    """The words of all lines, wrapped anew; lines without words stay as they are."""
    tokens = line_words(lines)
    return F.when(F.size(tokens) > 0, wrap_words(tokens, width)).otherwise(lines)


def balanced_chunks(n: Column, tokens: Column) -> Column:
    """At most n groups of words with about equal numbers of characters."""
    # n and the total ride in the accumulator: inside the fold they would be worked out for every word
    empty = F.struct(F.lit(0).cast("bigint").alias("len"), text_length(tokens).alias("total"), n.cast("bigint").alias("n"), F.expr("cast(array() as array<string>)").alias("cur"), F.expr("cast(array() as array<array<string>>)").alias("groups"))

    def step(acc: Column, w: Column) -> Column:
        size, cur = acc["len"] + F.length(w), F.concat(acc["cur"], F.array(w))
        close = (size * acc["n"] >= acc["total"]) & (F.size(acc["groups"]) + 1 < acc["n"])
        return F.struct(
            F.when(close, F.lit(0).cast("bigint")).otherwise(size).alias("len"),
            acc["total"].alias("total"),
            acc["n"].alias("n"),
            F.when(close, F.expr("cast(array() as array<string>)")).otherwise(cur).alias("cur"),
            F.when(close, F.concat(acc["groups"], F.array(cur))).otherwise(acc["groups"]).alias("groups"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["groups"], F.array(acc["cur"]))).otherwise(acc["groups"])

    return F.when((n <= 1) | (F.size(tokens) < 2), F.array(tokens)).otherwise(F.aggregate(tokens, empty, step, finish))


def marker_body(line: Column) -> Column:
    """A line without simple tags, one leading dash and white space around it."""
    bare = strip(F.regexp_replace(line, "</?[ibu]>", ""))
    return strip(F.when(bare.startswith("- "), F.substring(bare, 3, F.length(bare))).otherwise(bare))


def is_marker_body(t: Column) -> Column:
    wrapped = lambda a, b: t.startswith(a) & t.endswith(b)
    return (t == "") | wrapped("(", ")") | wrapped("[", "]") | t.rlike(rf"^[{NOTES}](?s:.*)[{NOTES}]\z") | t.rlike(rf"^[{NOTES}\s]+\z")


def is_marker_line(line: Column) -> Column:
    """A sound cue in brackets, a line of music, or nothing at all."""
    return is_marker_body(marker_body(line))


def is_music_cue(lines: Column) -> Column:
    # the bodies first: inside one lambda each test would strip the line anew
    return (F.size(lines) > 0) & F.forall(F.transform(lines, lambda x: marker_body(x)), is_marker_body)


def is_non_speech(text: Column) -> Column:
    """Blank, or wholly one annotation in brackets or stars that names no speech."""
    note = r"(?s)^\s*[\[(*](.*)[\])*]\s*\z"
    body = strip(F.regexp_replace(F.lower(F.regexp_extract(text, note, 1)), "[^a-z0-9]+", " "))
    marked = body.rlike(r"\b(?:" + "|".join(NON_SPEECH) + r")\b")
    return is_blank(text) | (F.coalesce(text.rlike(note), F.lit(False)) & ((body == "") | marked))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts as sets of words; two texts without words are equal."""
    tokens = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    both, either = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)
