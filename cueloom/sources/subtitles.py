"""SubRip and WebVTT as DataFrames: one row a document in, one row a cue out, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..functions.timecode import clock_to_ms, ms_to_clock, strip

SEPARATORS = {"srt": ",", "vtt": "."}
_BOM = "﻿"


def read_text(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """``paths(uri)`` with ``text``, and ``error`` where a file cannot be read."""
    uris = [r[0] for r in paths.select("uri").distinct().collect()]  # a manifest given by the caller
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = []
    for u in uris:
        p = hadoop(u)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.getFileStatus(p).isFile():
            there.append((u, fs.makeQualified(p).toString()))
    if not there:
        return paths.select("uri", F.lit(None).cast("string").alias("text"), F.lit("source-unreadable").alias("error"))
    named = spark.createDataFrame(there, "uri string, path string")
    files = spark.read.format("binaryFile").load([p for _, p in there]).select("path", F.decode("content", "UTF-8").alias("text"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    got = named.select("uri", same("path").alias("path")).join(files.select(same("path").alias("path"), "text"), "path").select("uri", "text")
    return paths.join(got, "uri", "left").select("uri", "text", F.when(F.col("text").isNull(), "source-unreadable").alias("error"))


def blocks(text: Column) -> Column:
    clean = strip(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(_BOM), F.lit("")))
    return F.split(clean, r"\n[ \t]*\n")


def _index(line: Column) -> Column:
    return F.coalesce(F.expr("cast(null as bigint)"), F.when(strip(line).rlike(r"^[+-]?\d{1,18}\z"), strip(line).try_cast("bigint")), F.lit(0).cast("bigint"))


def _parsed(docs: DataFrame, key: list[str], keep: Column | None, timing: Column, end_of: Callable[[Column], Column], index: Column) -> DataFrame:
    raw = docs.select(*key, F.posexplode(blocks(F.col("text"))).alias("block_no", "block"))
    raw = raw if keep is None else raw.where(keep)
    lined = raw.withColumn("all_lines", split_lines(F.col("block"))).withColumn("at", timing).where("at > 0")
    sides = F.split(F.get("all_lines", F.col("at").cast("int") - 1), "-->")
    cues = lined.withColumn("start_ms", clock_to_ms(F.get(sides, F.lit(0)))).withColumn("end_ms", clock_to_ms(end_of(F.get(sides, F.lit(1))))).withColumn("src_index", index)
    good = cues.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    lines = F.slice("all_lines", F.col("at").cast("int") + 1, F.greatest(F.size("all_lines") - F.col("at").cast("int"), F.lit(0)))
    # block numbers keep the order; pos is dense within a document and needs no shuffle beyond it
    return good.select(*key, "block_no", "src_index", "start_ms", "end_ms", lines.alias("lines"))


def parse_srt(docs: DataFrame, *key: str) -> DataFrame:
    """Cues of ``docs(key..., text)``; malformed blocks are dropped. ``block_no`` gives their order."""
    two = F.when(F.size("all_lines") >= 2, F.lit(2)).otherwise(F.lit(0))
    return _parsed(docs, list(key), None, two, lambda x: x, _index(F.get("all_lines", F.lit(0))))


def parse_vtt(docs: DataFrame, *key: str) -> DataFrame:
    """As ``parse_srt``; header and metadata blocks are skipped and cue settings left out."""
    keep = ~F.col("block").startswith("WEBVTT") & ~F.col("block").rlike(r"^(NOTE|STYLE|REGION)\b")
    timing = F.array_position(F.transform("all_lines", lambda x: x.contains("-->")), F.lit(True))
    before = F.when(F.col("at") > 1, F.get("all_lines", F.col("at").cast("int") - 2))
    return _parsed(docs, list(key), keep, timing, lambda x: F.get(F.split(strip(x), r"\s+"), F.lit(0)), _index(before))


def render(cues: DataFrame, fmt: str, *key: str) -> DataFrame:
    """One text a track from ``cues(key..., idx, start_ms, end_ms, lines)``."""
    if fmt not in SEPARATORS:
        raise ValueError(f"unsupported-format: {fmt}; known: {sorted(SEPARATORS)}")
    sep = SEPARATORS[fmt]
    block = F.concat(F.col("idx").cast("string"), F.lit("\n"), ms_to_clock(F.col("start_ms"), sep), F.lit(" --> "), ms_to_clock(F.col("end_ms"), sep), F.lit("\n"), F.array_join("lines", "\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("idx"), block.alias("block")))), lambda x: x["block"])
    head = "WEBVTT\n\n" if fmt == "vtt" else ""
    return cues.groupBy(*key).agg(F.concat(F.lit(head), F.array_join(ordered, "\n\n"), F.lit("\n")).alias("text"))


#: Format to parser and renderer; ``register`` adds another.
CODECS: dict[str, tuple[Callable, Callable]] = {
    "srt": (parse_srt, lambda cues, *key: render(cues, "srt", *key)),
    "vtt": (parse_vtt, lambda cues, *key: render(cues, "vtt", *key)),
}


def register(codecs: dict, fmt: str, parser: Callable, renderer: Callable) -> dict:
    return {**codecs, fmt: (parser, renderer)}


def codec(fmt: str, codecs: dict | None = None) -> tuple[Callable, Callable]:
    known = CODECS if codecs is None else codecs
    if fmt not in known:
        raise ValueError(f"unsupported-format: {fmt}; known: {sorted(known)}")
    return known[fmt]
