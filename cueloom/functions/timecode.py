"""Clocks and units of time as Column functions. Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"^(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[,.](\d{1,3})\z"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def ms_to_clock(ms: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``; from 100 hours on, the hour has three digits."""
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.expr("1") * _div(ms, 3_600_000), _div(ms % 3_600_000, 60_000), _div(ms % 60_000, 1000), ms % 1000)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def clock_to_ms(text: Column) -> Column:
    """Milliseconds of ``[HH:]MM:SS[,.]m``, or null. The fraction is read as an integer, not scaled."""
    s = strip(text)
    part = lambda k: F.coalesce(F.expr("try_cast(null as bigint)"), F.nullif(F.regexp_extract(s, CLOCK, k), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(s.rlike(CLOCK), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def us_to_ms(us: Column) -> Column:
    """Microseconds rounded half up; negative ones (unknown durations) are 0."""
    return F.when(us < 0, F.lit(0).cast("bigint")).otherwise(half_up(us / 1000.0))


def to_ms(t: Column, unit: str = "ms") -> Column:
    """A time in seconds or milliseconds as milliseconds of 0 or more."""
    return F.greatest(F.lit(0).cast("bigint"), half_up(t * 1000.0 if unit == "s" else t * 1.0))


def samples_to_ms(samples: Column, rate: Column | int) -> Column:
    return half_up(samples * 1000.0 / (F.lit(rate) if isinstance(rate, int) else rate))


def sample_range(start_ms: Column, end_ms: Column, pad_ms: int, rate: int, n: Column) -> tuple[Column, Column]:
    """First and last sample (exclusive) of a padded span, inside [0, n]."""
    inside = lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(n, x.cast("bigint")))
    return inside(F.floor((start_ms - pad_ms) * rate / 1000.0)), inside(F.ceil((end_ms + pad_ms) * rate / 1000.0))


def snap(ms: Column, grid: int) -> Column:
    return (F.lit(grid) * half_up(ms / float(grid))).cast("bigint")
