"""Speech post-processing: voice activity, hypotheses, tokens and padded windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import samples_to_ms, strip, to_ms
from . import intervals as I

WINDOW_SAMPLES = {16_000: 512, 8_000: 256}


def raw_speech(probs: Column, length: Column, rate: int, enter: float, leave: float, min_speech: int, min_silence: int) -> Column:
    """Spans of samples where a hysteresis over window probabilities finds speech."""
    size = WINDOW_SAMPLES[rate]
    empty = F.expr("named_struct('i', cast(0 as bigint), 'start', cast(null as bigint), 'quiet', cast(0 as bigint), 'spans', cast(array() as array<struct<s:bigint,e:bigint>>))")

    def step(a: Column, p: Column) -> Column:
        at = a["i"] * size
        on = a["start"].isNotNull()
        loud = p >= enter
        low = (p < leave) & on & ~loud
        quiet = F.when(low & (a["quiet"] == 0), at).when(loud, F.lit(0).cast("bigint")).otherwise(a["quiet"])
        ends = low & (at - quiet >= min_silence)
        long = (quiet - a["start"]) > min_speech
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(loud & ~on, at).when(ends, F.lit(None).cast("bigint")).otherwise(a["start"]).alias("start"),
            F.when(ends, F.lit(0).cast("bigint")).otherwise(quiet).alias("quiet"),
            F.when(ends & long, F.concat(a["spans"], F.array(F.struct(a["start"].alias("s"), quiet.alias("e"))))).otherwise(a["spans"]).alias("spans"),
        )

    def finish(a: Column) -> Column:
        tail = a["start"].isNotNull() & (length - a["start"] > min_speech)
        return F.when(tail, F.concat(a["spans"], F.array(F.struct(a["start"].alias("s"), length.alias("e"))))).otherwise(a["spans"])

    return F.aggregate(probs, empty, step, finish)


def speech_spans(
    df: DataFrame, rate: int, *key: str, enter: float = 0.5, leave: float = 0.35, min_speech_ms: int = 250, min_silence_ms: int = 100, pad_ms: int = 30, max_span_ms: int = 30_000
) -> DataFrame:
    """(key..., start_ms, end_ms) of speech in ``df(key..., probs, n_samples)``; other rates have none."""
    if rate not in WINDOW_SAMPLES:
        return df.select(*key, F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms")).limit(0)
    count = lambda ms: int(rate * (ms / 1000.0))
    spans = raw_speech(F.col("probs"), F.col("n_samples"), rate, enter, leave, count(min_speech_ms), count(min_silence_ms))
    rows = df.select(*key, "n_samples", F.posexplode(spans).alias("pos", "x")).select(*key, "n_samples", "pos", F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))
    padded = I.pad_spans(rows, count(pad_ms), F.col("n_samples"), *key)
    ms = padded.select(*key, samples_to_ms(F.col("start_ms"), rate).alias("start_ms"), samples_to_ms(F.col("end_ms"), rate).alias("end_ms"))
    return I.cap_spans(ms.where("start_ms < end_ms"), max_span_ms)


def normalize_segments(df: DataFrame, *key: str, unit: str = "ms", default_confidence: float = 1.0) -> DataFrame:
    """Raw hypotheses (key..., pos, start, end, text, confidence, language) as ordered, sheared segments.

    Blank and non-speech texts go before the shear, so that a marker over a silence does
    not push real speech aside.
    """
    start = to_ms(F.col("start"), unit)
    clean = df.withColumn("start_ms", F.when(F.col("start").isNotNull(), start)).withColumn("text", strip(F.col("text")))
    clean = clean.withColumn("end_ms", F.greatest("start_ms", F.coalesce(F.when(F.col("end").isNotNull(), to_ms(F.col("end"), unit)), F.col("start_ms"))))
    kept = clean.where(F.col("start_ms").isNotNull() & ~T.is_non_speech(F.col("text")))
    sheared = I.segment_shear(kept.withColumn("confidence", F.coalesce("confidence", F.lit(default_confidence))), *key)
    return sheared.select(*key, "pos", "start_ms", "end_ms", "text", "confidence", "language")


def stub_segments(df: DataFrame, duration: Column, window: Column, language: Column, *key: str) -> DataFrame:
    """Placeholder segments that tile a clip, at least one."""
    dur, win = F.greatest(F.lit(1).cast("bigint"), duration), F.greatest(F.lit(1).cast("bigint"), window)
    starts = F.sequence(F.lit(0).cast("bigint"), dur - 1, win)
    rows = df.select(*key, dur.alias("dur"), win.alias("win"), F.coalesce(language, F.lit("und")).alias("lang"), F.posexplode(starts).alias("pos", "start_ms"))
    return rows.select(*key, (F.col("pos") + 1).cast("bigint").alias("idx"), "start_ms", F.least(F.col("start_ms") + F.col("win"), F.col("dur")).alias("end_ms"), F.format_string("[%s segment %d]", "lang", F.col("pos") + 1).alias("text"))


def group_tokens(df: DataFrame, clip_end: Column, *key: str) -> DataFrame:
    """Words of (key..., pos, token, start_ms): a token that opens with a space or ``▁`` opens a word."""
    w = Window.partitionBy(*key).orderBy("pos")
    opens = F.col("token").rlike("^[ ▁]") | (F.row_number().over(w) == 1)
    numbered = df.withColumn("__end", clip_end).withColumn("word", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")
    grouped = numbered.groupBy(*key, "word").agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max("__end").alias("__end"), text.alias("text"))
    after = F.lead("start_ms").over(Window.partitionBy(*key).orderBy("word"))
    clean = F.trim(F.regexp_replace("text", "▁", " "))
    return grouped.select(*key, F.col("word").cast("bigint").alias("word"), "start_ms", F.coalesce(after, F.col("__end")).alias("end_ms"), clean.alias("text")).where("text <> ''")


def timestamp_segments(df: DataFrame, clip_end: Column, *key: str) -> DataFrame:
    """Segments of a token stream (key..., pos, token) parted by ``<|seconds|>`` tokens; other ``<|x|>`` are left out."""
    seconds = F.when(F.col("token").rlike(r"^<\|\d+(\.\d+)?\|>\z"), F.regexp_extract("token", r"^<\|(\d+(?:\.\d+)?)\|>", 1).cast("double"))
    w = Window.partitionBy(*key).orderBy("pos")
    marked = df.withColumn("__end", clip_end).withColumn("ts", seconds).withColumn("seg", F.count("ts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain = F.when(F.col("ts").isNull() & ~F.col("token").rlike(r"^<\|.*\|>\z"), F.struct("pos", "token"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(plain)), lambda x: x["token"]), "")
    grouped = marked.groupBy(*key, "seg").agg(F.max("ts").alias("start"), F.max("__end").alias("__end"), text.alias("text"))
    end = F.lead("start").over(Window.partitionBy(*key).orderBy("seg"))
    marks = F.max("seg").over(Window.partitionBy(*key))
    # text before the first mark is dropped; a stream without marks is one segment from 0
    out = grouped.withColumn("end", F.coalesce(end, F.col("__end"))).withColumn("__marks", marks).where((F.col("text") != "") & ((F.col("seg") > 0) | (F.col("__marks") == 0)))
    return out.select(*key, F.col("seg").cast("bigint").alias("seg"), F.coalesce("start", F.lit(0.0)).alias("start"), "end", "text")


def argmax_last(values: Column) -> Column:
    """Place from 0 of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of consecutive words in both."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
        best, row = max(best, *new), new
    return best


def is_pad_duplicate(before: list[str], words: list[str]) -> bool:
    """At least two running words are shared and make up half of the words."""
    run = longest_common_run(before, words) if before and words else 0
    return run >= 2 and 2 * run >= len(words)


def pad_duplicates(df: DataFrame, before: str, text: str) -> DataFrame:
    """``run`` and ``duplicate`` for two columns of texts."""
    given = df.select("*", T.content_words(F.col(before)).alias("__a"), T.content_words(F.col(text)).alias("__b"))

    @F.pandas_udf("bigint")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_common_run(list(x), list(y)) if len(x) and len(y) else 0 for x, y in zip(a, b, strict=True)])

    got = given.withColumn("run", run("__a", "__b"))
    return got.withColumn("duplicate", (F.col("run") >= 2) & (2 * F.col("run") >= F.size("__b"))).drop("__a", "__b")


def merge_padded(df: DataFrame, *key: str) -> DataFrame:
    """Segments (key..., window, pos, span_start_ms, start_ms, end_ms, text) without repeats at window seams.

    While a window's segment starts before its span and repeats the last kept one, the
    longer of both stays; from the first that does not, all of the window stay.
    """
    names = [*key, "start_ms", "end_ms", "text"]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        content = lambda t: re.findall(r"(?:[^\W_]|')+", str(t).lower())
        out: list = []
        for _, win in rows.sort_values(["window", "pos"]).groupby("window", sort=True):
            seam = True
            for r in win.itertuples(index=False):
                if seam and out and r.start_ms < r.span_start_ms and is_pad_duplicate(content(out[-1].text), content(r.text)):
                    if len(content(r.text)) > len(content(out[-1].text)):
                        out[-1] = r
                    continue
                seam = False
                out.append(r)
        return pd.DataFrame([[getattr(r, n) for n in names] for r in out], columns=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.groupBy(*key).applyInPandas(merge, schema)


def transcribe_spans(df: DataFrame, backend, schema: str) -> DataFrame:
    """Runs a port's ``backend(rows) -> rows`` over batches of spans; hypotheses are offset by the caller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield backend(b)

    return df.mapInPandas(run, schema)
