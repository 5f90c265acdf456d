"""Reflow: a table of rules over cues (key..., pos, start_ms, end_ms, lines), in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import half_up
from . import intervals as I


@dataclass(frozen=True)
class Rules:
    """A rule that is None is off; merging and re-indexing always run."""

    drop_music: bool = False
    max_dur_ms: int | None = None
    min_dur_ms: int | None = None
    min_gap_ms: int | None = None
    max_chars_line: int | None = None
    max_lines: int | None = None
    max_cps: float | None = None
    snap: int | None = None


def drop_nonspeech(cues: DataFrame) -> DataFrame:
    return cues.where(~T.is_music_cue(F.col("lines")))


def wrap_cues(cues: DataFrame, width: int) -> DataFrame:
    return cues.withColumn("lines", T.wrap_lines(F.col("lines"), width))


def pieces_needed(start: Column, end: Column, lines: Column, max_cps: float, max_chars: int | None, max_lines: int | None) -> Column:
    """How many cues the text wants: by reading speed and by room, at most one a millisecond."""
    chars, dur = T.text_length(lines), end - start
    by_speed = F.ceil(chars * 1000.0 / dur / float(max_cps)).cast("bigint")
    by_room = F.ceil(chars / float(max_chars * max_lines)).cast("bigint") if max_chars and max_lines else F.lit(1).cast("bigint")
    n = F.least(F.greatest(F.lit(1).cast("bigint"), by_speed, by_room), dur)
    return F.when((dur <= 0) | (chars <= 0), F.lit(1).cast("bigint")).otherwise(n)


def split_cues(cues: DataFrame, max_cps: float, max_chars: int | None, max_lines: int | None) -> DataFrame:
    """Cues read too fast become several, their times in proportion to their characters.

    ``part`` numbers the pieces of a cue from 0.
    """
    n = pieces_needed(F.col("start_ms"), F.col("end_ms"), F.col("lines"), max_cps, max_chars, max_lines)
    counted = cues.withColumn("__n", n)
    # only cues that are split pay for the trip through Python
    one, many = counted.where("__n <= 1"), counted.where("__n > 1")
    grouped = many.withColumn("__groups", T.chunk_lines(F.col("__n"), T.line_words(F.col("lines")), max_chars))
    sized = grouped.withColumn("__cum", F.aggregate("__groups", F.array(F.lit(0).cast("bigint")), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["len"]))))
    total = F.greatest(F.lit(1).cast("bigint"), F.element_at("__cum", -1))
    span = F.col("end_ms") - F.col("start_ms")
    raw = F.transform("__cum", lambda c: F.col("start_ms") + half_up(span * (c.cast("double") / total)))
    g = F.size("__groups")

    def clamp(acc: Column, x: Column) -> Column:
        low = F.when(F.size(acc) == 0, x).otherwise(F.try_element_at(acc, F.lit(-1)) + 1)
        return F.concat(acc, F.array(F.least(F.greatest(x, low), F.col("end_ms") - (g - F.size(acc)))))

    bounds = F.aggregate(raw, F.expr("cast(array() as array<bigint>)"), clamp)
    bounded = sized.withColumn("__bounds", bounds)
    parts = F.transform("__groups", lambda x, i: F.struct(i.alias("part"), F.element_at("__bounds", i + 1).alias("start_ms"), F.element_at("__bounds", i + 2).alias("end_ms"), x["lines"].alias("lines")))
    keep = [c for c in cues.columns if c not in ("start_ms", "end_ms", "lines")]
    whole = one.select(*keep, F.lit(0).alias("part"), "start_ms", "end_ms", "lines")
    return whole.unionByName(bounded.select(*keep, F.inline(parts)))


def reflow(cues: DataFrame, rules: Rules, *key: str) -> DataFrame:
    """Cues by the rules, with ``idx`` from 1 in time order. ``pos`` breaks ties of time."""
    out = cues
    if rules.drop_music:
        out = drop_nonspeech(out)
    out = I.merge_overlaps(out, *key)
    if rules.max_dur_ms is not None:
        out = I.cap_duration(out, rules.max_dur_ms)
    if rules.min_dur_ms is not None:
        out = I.extend_duration(out, rules.min_dur_ms, rules.min_gap_ms or 0, *key)
    if rules.min_gap_ms is not None:
        out = I.enforce_gap(out, rules.min_gap_ms, *key)
    if rules.max_chars_line is not None:
        out = wrap_cues(out, rules.max_chars_line)
    if rules.max_cps is not None:
        out = split_cues(out, rules.max_cps, rules.max_chars_line, rules.max_lines)
        out = out.withColumn("pos", F.struct("pos", "part")).drop("part")
    if rules.snap is not None:
        out = I.snap_grid(out, rules.snap)
    return I.reindex(out, *key)
