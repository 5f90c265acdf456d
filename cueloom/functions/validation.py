"""Fallible projections: each function gives an error code or null, the first fault first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

#: Supported language tags.
LANGUAGES = ("und", "en", "en-us", "pt", "pt-BR", "es", "es-419", "fr", "de", "ru", "zh", "zh-hans", "zh-cn", "zh-tw", "ja", "ar", "he", "fa")
#: Formats, kinds of media, and states of a job in order.
FORMATS = ("srt", "vtt", "ass")
MEDIA_KINDS = ("video", "audio", "subtitle")
JOB_STATES = ("pending", "ingesting", "transcribing", "translating", "rendering", "completed")
#: How a job's state is described.
DESCRIPTIONS = {"pending": "pending", "ingesting": "extracting audio", "transcribing": "transcribing", "translating": "translating", "rendering": "rendering subtitles", "completed": "completed", "failed": "failed"}
INGRESS = {"video": "demux-asr", "audio": "asr", "subtitle": "parse"}
_AUTO = ("", "auto", "multi", "und")


def source_error(uri: Column) -> Column:
    return F.when(is_blank(uri), "invalid-source")


def language_error(tag: Column) -> Column:
    return F.when(F.coalesce(~tag.isin(*LANGUAGES), F.lit(True)), "unsupported-language")


def optional_language_error(tag: Column) -> Column:
    return F.when(tag.isNotNull(), language_error(tag))


def timecode_error(ms: Column) -> Column:
    return F.when(F.coalesce(ms < 0, F.lit(True)), "invalid-timecode")


def range_error(start: Column, end: Column) -> Column:
    return F.coalesce(timecode_error(start), timecode_error(end), F.when(start > end, "inverted-time-range"))


def confidence_error(score: Column) -> Column:
    return F.when(~F.coalesce(score.between(0.0, 1.0) & ~F.isnan(score), F.lit(False)), "invalid-confidence")


def segment_error(start: Column, end: Column, confidence: Column, language: Column, index: Column, text: Column) -> Column:
    return F.coalesce(range_error(start, end), confidence_error(confidence), optional_language_error(language), F.when(F.coalesce(index <= 0, F.lit(True)), "asr-failed"), F.when(is_blank(text), "asr-failed"))


def unit_error(start: Column, end: Column, language: Column, target: Column) -> Column:
    return F.coalesce(range_error(start, end), optional_language_error(language), F.when(is_blank(target), "translation-failed"))


def translation_error(source: Column, target: Column) -> Column:
    return F.coalesce(language_error(source), language_error(target), F.when(source == target, "translation-failed"))


def cue_error(start: Column, end: Column, index: Column, lines: Column) -> Column:
    some = F.coalesce(F.exists(lines, lambda x: ~is_blank(x)), F.lit(False))
    return F.coalesce(range_error(start, end), F.when(F.coalesce(index <= 0, F.lit(True)), "render-failed"), F.when(~some, "render-failed"))


def track_error(language: Column, fmt: Column) -> Column:
    return F.coalesce(language_error(language), F.when(F.coalesce(~fmt.isin(*FORMATS), F.lit(True)), "unsupported-format"))


def asset_error(kind: Column, uri: Column) -> Column:
    return F.coalesce(F.when(F.coalesce(~kind.isin(*MEDIA_KINDS), F.lit(True)), "unsupported-format"), source_error(uri))


def ready_error(kind: Column, has_audio: Column) -> Column:
    return F.when(~((kind == "subtitle") | F.coalesce(has_audio, F.lit(False))), "no-audio-stream")


def ingress_path(kind: Column) -> Column:
    out = F.when(kind.isNull(), F.lit(None).cast("string"))
    for k, v in INGRESS.items():
        out = out.when(kind == k, v)
    return out


def describe_state(state: Column) -> Column:
    out = F.when(state.isNull(), F.lit(None).cast("string"))
    for k, v in DESCRIPTIONS.items():
        out = out.when(state == k, v)
    return out


def is_auto_language(tag: Column) -> Column:
    return tag.isNull() | tag.isin(*_AUTO)


def explicit_language(tag: Column) -> Column:
    return F.when(~is_auto_language(tag), tag)


def segment_language(*chain: Column) -> Column:
    """The segment's own language, else the fallback's, else the transcript's, else ``und``."""
    return F.coalesce(*chain, F.lit("und"))


def missing_keys(required: dict[str, Column]) -> Column:
    """Names of the required values that are null."""
    return F.filter(F.array(*[F.when(c.isNull(), k) for k, c in required.items()]), lambda k: k.isNotNull())


def normalize_targets(one: Column, many: Column) -> Column:
    """Target languages of a job: trimmed, without blanks and repeats; many win over one."""
    chosen = F.when(F.coalesce(F.size(many), F.lit(0)) > 0, many).otherwise(F.array(one))
    return F.array_distinct(F.filter(F.transform(chosen, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def advance_state(state: Column) -> Column:
    """The next state of a job, or null where it has come to an end."""
    out = F.when(state.isNull(), F.lit(None).cast("string"))
    for a, b in zip(JOB_STATES, JOB_STATES[1:], strict=False):
        out = out.when(state == a, b)
    return out


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def muxed(language: Column, languages: Column) -> Column:
    return languages.isNull() | F.array_contains(languages, language)


def clobbered(extra: Column, reserved: list[str]) -> Column:
    """Reserved keys that a result's extra map would overwrite."""
    return F.array_intersect(F.map_keys(extra), F.array(*[F.lit(k) for k in reserved]))
