"""Locators, output paths, encoding plans and caption layout as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecode import half_up

#: Heights of the named qualities, and limits.
PRESETS = {"2160p": 2160, "1440p": 1440, "1080p": 1080, "720p": 720, "480p": 480, "360p": 360}
BITS_PER_PIXEL, MIN_VIDEO_BITRATE, AUDIO_BITRATE = 0.10, 400_000, 128_000
#: The caption style where nothing is asked for.
STYLE = {"size_pct": 4.2, "min_size_px": 18, "y_position": 0.94, "wrap": 42, "text_color": "#ffffff", "outline_color": "#000000", "plate_color": "#000000", "plate_opacity": 0.55}


def is_remote(uri: Column) -> Column:
    return F.coalesce(uri.rlike(r"(?i)^(https?|ftps?|rtmpe?|rtsp)://"), F.lit(False))


def source_extension(uri: Column) -> Column:
    segment = F.element_at(F.split(F.element_at(F.split(uri, "[?#]"), 1), "/"), -1)
    return F.when(segment.contains("."), F.nullif(F.lower(F.element_at(F.split(F.regexp_replace(segment, r"\.+\z", ""), r"\."), -1)), F.lit("")))


def infer_kind(uri: Column) -> Column:
    return F.when(F.coalesce(source_extension(uri).isin("srt", "vtt", "ass"), F.lit(False)), "subtitle").otherwise("video")


def sibling_output(uri: Column, suffix: Column | str) -> Column:
    """The path with its extension replaced; a name that opens with its only dot has none."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.regexp_replace(uri, r"(?<=[^/])\.[^./]*\z", ""), suffix)


def language_variant(uri: Column, language: Column) -> Column:
    lang = F.trim(F.coalesce(language, F.lit("")))
    name = F.element_at(F.split(uri, "/"), -1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)\z", 1)
    return F.when(lang == "", uri).otherwise(sibling_output(uri, F.concat(F.lit("."), lang, ext)))


def _even(n: Column) -> Column:
    return n + F.pmod(n, F.lit(2))


def target_dimensions(width: Column, height: Column, quality: Column) -> tuple[Column, Column]:
    """Even width and height of the output: never enlarged, the aspect kept."""
    target = F.lit(None).cast("bigint")
    for k, v in PRESETS.items():
        target = F.when(quality == k, F.lit(v).cast("bigint")).otherwise(target)
    same = F.coalesce((target >= height) | (height <= 0), F.lit(True))
    w = F.when(same, width).otherwise(half_up(width.cast("double") * (target.cast("double") / height)))
    return _even(w).cast("bigint"), _even(F.when(same, height).otherwise(target)).cast("bigint")


def video_bitrate(source: Column, source_width: Column, source_height: Column, width: Column, height: Column, frame_rate: Column) -> Column:
    pixels, before = width * height, source_width * source_height
    estimated = (F.lit(BITS_PER_PIXEL) * pixels * F.greatest(F.lit(1.0), F.coalesce(frame_rate, F.lit(30.0)))).cast("bigint")
    base = F.when(F.coalesce(source, F.lit(0)) > 0, source).otherwise(estimated)
    scaled = F.when((before > 0) & (pixels > 0) & (pixels < before), (base * (pixels.cast("double") / before)).cast("bigint")).otherwise(base)
    return F.greatest(F.lit(MIN_VIDEO_BITRATE).cast("bigint"), scaled)


def audio_bitrate(source: Column) -> Column:
    return F.when(F.coalesce(source, F.lit(0)) > 0, source).otherwise(F.lit(AUDIO_BITRATE).cast("bigint"))


def font_size(height: Column, size_px: Column, size_pct: Column) -> Column:
    sized = (F.coalesce(size_pct, F.lit(STYLE["size_pct"])) / 100.0 * height).cast("bigint")
    return F.when(F.coalesce(size_px, F.lit(0)) > 0, size_px.cast("bigint")).otherwise(F.greatest(F.lit(STYLE["min_size_px"]).cast("bigint"), sized))


def block_bottom(height: Column, y_position: Column) -> Column:
    y = (F.coalesce(y_position, F.lit(STYLE["y_position"])) * height).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(height.cast("bigint"), y))


def baseline(bottom: Column, count: Column, line_height: Column, index: Column) -> Column:
    return bottom - line_height * (count - 1 - index)


def plate_alpha(opacity: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(255).cast("bigint"), half_up(255.0 * F.coalesce(opacity, F.lit(STYLE["plate_opacity"])))))


def hex_rgb(color: Column) -> Column:
    """Red, green and blue of six or three hex digits; anything else is white."""
    s = F.trim(F.replace(color, F.lit("#"), F.lit("")))
    pair = lambda k: F.conv(F.substring(s, k, 2), 16, 10).cast("int")
    one = lambda k: F.conv(F.repeat(F.substring(s, k, 1), F.lit(2)), 16, 10).cast("int")
    white = F.array(*[F.lit(255)] * 3)
    return F.when(s.rlike(r"^[0-9a-fA-F]{6}\z"), F.array(pair(1), pair(3), pair(5))).when(s.rlike(r"^[0-9a-fA-F]{3}\z"), F.array(one(1), one(2), one(3))).otherwise(white)


def mov_text(text: Column) -> Column:
    """A two-byte big-endian length and the text in UTF-8."""
    body = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.length(body)), 4, "0")), body)
