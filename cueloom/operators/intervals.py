"""Interval algebra over rows of (key, pos, start_ms, end_ms): windows and generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import snap as snap_ms

_BIG = 9_223_372_036_854_775_807


def _ordered(*key: str):
    return Window.partitionBy(*key).orderBy("start_ms", "end_ms", "pos")


def reindex(df: DataFrame, *key: str) -> DataFrame:
    """``idx`` from 1 in time order; equal times keep the order of ``pos``."""
    return df.withColumn("idx", F.row_number().over(_ordered(*key)).cast("bigint"))


def input_index(df: DataFrame, *key: str) -> DataFrame:
    """``idx`` from 1 in the order of ``pos``."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*key).orderBy("pos")).cast("bigint"))


def extend_duration(df: DataFrame, least: int, gap: int, *key: str) -> DataFrame:
    """Ends at least ``least`` after starts, but ``gap`` before the next start, which may also shorten."""
    ceiling = F.coalesce(F.lead("start_ms").over(_ordered(*key)) - gap, F.lit(_BIG))
    wanted = F.greatest("end_ms", F.col("start_ms") + least)
    return df.withColumn("end_ms", F.least(wanted, F.greatest(F.col("start_ms"), ceiling)))


def enforce_gap(df: DataFrame, gap: int, *key: str) -> DataFrame:
    """Ends pulled back to at least ``gap`` before the next start, never before their own start."""
    last = F.lead("start_ms").over(_ordered(*key)) - gap
    return df.withColumn("end_ms", F.when(last < F.col("end_ms"), F.greatest(F.col("start_ms"), last)).otherwise(F.col("end_ms")))


def cap_duration(df: DataFrame, most: int) -> DataFrame:
    return df.withColumn("end_ms", F.least(F.col("end_ms"), F.col("start_ms") + most))


def snap_grid(df: DataFrame, grid: int) -> DataFrame:
    """Both ends on the nearest grid point, the end after the start."""
    start, end = snap_ms(F.col("start_ms"), grid), snap_ms(F.col("end_ms"), grid)
    return df.select(*[c for c in df.columns if c not in ("start_ms", "end_ms")], start.alias("start_ms"), F.when(end > start, end).otherwise(start + grid).alias("end_ms"))


def segment_shear(df: DataFrame, *key: str) -> DataFrame:
    """Starts moved past every earlier end: ordered, without overlap. Ties keep the order of ``pos``."""
    before = Window.partitionBy(*key).orderBy("start_ms", "pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("start_ms"), F.coalesce(F.max(F.greatest("start_ms", "end_ms")).over(before), F.col("start_ms")))
    return df.withColumn("__start", start).withColumn("end_ms", F.greatest("__start", "end_ms")).withColumn("start_ms", F.col("__start")).drop("__start")


def islands(df: DataFrame, *key: str) -> DataFrame:
    """``island`` numbers runs of intervals that truly overlap; touching ones are apart."""
    before = _ordered(*key).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_ms").over(before)
    return df.withColumn("__new", F.when(reach.isNull() | (F.col("start_ms") >= reach), 1).otherwise(0)).withColumn("island", F.sum("__new").over(_ordered(*key).rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_overlaps(df: DataFrame, *key: str) -> DataFrame:
    """One row an island: the union of the times and the lines one after another."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "pos", "lines")))
    merged = islands(df, *key).groupBy(*key, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("pos").alias("pos"), rows.alias("rows"))
    return merged.withColumn("lines", F.flatten(F.transform("rows", lambda r: r["lines"]))).drop("rows", "island")


def grid_spans(df: DataFrame, duration: Column, window: Column) -> DataFrame:
    """Tiles of [0, duration); the last is cut to fit. No duration or window, no tiles."""
    ok = (duration > 0) & (window > 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(duration, F.lit(1)) - 1, F.greatest(window, F.lit(1)))
    return df.where(ok).withColumn("start_ms", F.explode(starts)).withColumn("end_ms", F.least(F.col("start_ms") + window, duration))


def cap_spans(df: DataFrame, most: int) -> DataFrame:
    """Longer spans in pieces of ``most``; 0 or less changes nothing."""
    if most <= 0:
        return df
    starts = F.sequence(F.col("start_ms"), F.greatest(F.col("start_ms"), F.col("end_ms") - 1), F.lit(most).cast("bigint"))
    return df.withColumn("__s", F.explode(starts)).withColumn("end_ms", F.least(F.col("__s") + most, F.greatest("end_ms", "__s"))).withColumn("start_ms", F.col("__s")).drop("__s")


def pad_spans(df: DataFrame, pad: int, length: Column, *key: str) -> DataFrame:
    """Spans widened by ``pad`` and kept inside [0, length]; short silences are halved instead."""
    w = Window.partitionBy(*key).orderBy("start_ms", "end_ms", "pos")
    after = F.lead("start_ms").over(w) - F.col("end_ms")
    before = F.col("start_ms") - F.lag("end_ms").over(w)
    half = lambda gap: F.when(gap < 0, -F.floor(-gap / 2)).otherwise(F.floor(gap / 2)).cast("bigint")
    end = F.when(after < 2 * pad, F.col("end_ms") + half(after)).otherwise(F.least(length, F.col("end_ms") + pad))
    start = F.greatest(F.lit(0).cast("bigint"), F.when(before < 2 * pad, F.col("start_ms") - half(before)).otherwise(F.col("start_ms") - pad))
    return df.withColumn("__s", start).withColumn("__e", end).drop("start_ms", "end_ms").withColumnsRenamed({"__s": "start_ms", "__e": "end_ms"})


def active_cues(points: DataFrame, cues: DataFrame, *key: str, bucket_ms: int = 10_000) -> DataFrame:
    """Each of ``points(key..., t_ms)`` with the cue that covers it: the first by start, then ``pos``.

    Points and cues meet in buckets of time, so the join is an equi-join that spreads one
    track's cues over many keys; a cue is a row in every bucket that it touches.
    """
    b = F.lit(bucket_ms)
    spread = cues.where("end_ms > start_ms").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / b), F.floor((F.col("end_ms") - 1) / b))))
    near = points.withColumn("bucket", F.floor(F.col("t_ms") / b)).join(spread, [*key, "bucket"], "inner").where("start_ms <= t_ms AND t_ms < end_ms")
    return near.groupBy(*key, "t_ms").agg(F.min(F.struct("start_ms", "pos", "end_ms", "lines")).alias("c")).select(*key, "t_ms", "c.pos", "c.start_ms", "c.end_ms", "c.lines")


def interleave(packets: DataFrame, cues: DataFrame, *key: str) -> DataFrame:
    """Packets in their order with each cue before the first packet at or after its start.

    Packet times may fall back, so a cue goes by the running maximum of packet times.
    ``packets(key..., seq, pts)``; ``cues(key..., pos, start_ms)``.
    """
    upto = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = packets.select(*key, F.max("pts").over(upto).alias("at"), F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("seq"))
    c = cues.select(*key, F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.col("pos").cast("bigint").alias("seq"))
    return p.unionByName(c).withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy("at", "kind", "seq")).cast("bigint"))
