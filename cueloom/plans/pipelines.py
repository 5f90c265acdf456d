"""The three ways in: subtitle files, transcription only, and media with translation.

Jobs are rows. A failed stage sets ``error`` and later stages leave the row as it is,
so a bad document never takes others with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validation as V
from ..operators import asr, batching, intervals
from ..operators.reflow import Rules, reflow
from ..sources import subtitles


def run_stages(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Applies stages in order; a stage is any ``DataFrame -> DataFrame``."""
    for _, stage in stages:
        df = df.transform(stage)
    return df


def guarded(run: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None]:
    """Whatever is thrown becomes the error ``uncaught``."""
    try:
        return run(), None
    except Exception as e:  # noqa: BLE001
        return None, f"uncaught: {type(e).__name__}"


def translate_texts(rows: DataFrame, translator: Callable, *key: str, size: int = 40, around: int = 4) -> tuple[DataFrame, DataFrame]:
    """``rows(key..., idx, source_text)`` translated in windows with context.

    Returns (key..., idx, target_text) and (key..., error), the first error of each key.
    """
    windows = batching.context_windows(rows, size, around, "idx", "source_text", *key)
    done = translator(windows)
    whole = F.coalesce(F.size("ok") == F.size("texts"), F.lit(False))
    checked = done.withColumn("error", F.coalesce("error", F.when(~whole, "translation-failed")))
    errors = checked.where("error IS NOT NULL").groupBy(*key).agg(F.min_by("error", "win_idx").alias("error"))
    flat = checked.where("error IS NULL").select(*key, "win_idx", F.posexplode("ok").alias("at", "target_text"))
    return flat.select(*key, (F.col("win_idx") * size + F.col("at") + 1).cast("bigint").alias("idx"), "target_text"), errors


def render_tracks(cues: DataFrame, fmt: str, *key: str) -> DataFrame:
    """(key..., text, error): a track, or the code of its first bad cue."""
    fault = V.cue_error(F.col("start_ms"), F.col("end_ms"), F.col("idx"), F.col("lines"))
    marked = cues.withColumn("fault", fault)
    errors = marked.where("fault IS NOT NULL").groupBy(*key).agg(F.min_by("fault", "idx").alias("error"))
    texts = subtitles.codec(fmt)[1](marked.where("fault IS NULL"), *key)
    return marked.select(*key).distinct().join(texts, list(key), "left").join(errors, list(key), "left").select(*key, F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def subtitle_job(cues: DataFrame, targets: list[str], translator: Callable, key: str, rules: Rules = Rules(), fmt: str = "srt") -> DataFrame:
    """(key, target_language, text, error) from parsed cues (key, pos, start_ms, end_ms, lines).

    All target languages are validated before any work.
    """
    bad = [t for t in targets if t not in V.LANGUAGES]
    if bad or not targets:
        raise ValueError(f"unsupported-language: {bad}" if bad else "no target language")
    shaped = reflow(cues, rules, key)
    texts = shaped.select(key, "idx", F.array_join("lines", "\n").alias("source_text"))
    fanned = texts.withColumn("target_language", F.explode(F.array(*[F.lit(t) for t in targets])))
    done, errors = translate_texts(fanned, translator, key, "target_language")
    units = shaped.select(key, "idx", "start_ms", "end_ms").join(done, [key, "idx"]).withColumn("lines", T.split_lines(F.col("target_text")))
    tracks = render_tracks(units, fmt, key, "target_language")
    both = tracks.join(errors.withColumnRenamed("error", "failed"), [key, "target_language"], "full")
    return both.select(key, "target_language", F.when(F.col("failed").isNull(), F.col("text")).alias("text"), F.coalesce("failed", "error").alias("error"))


def subtitle_documents(docs: DataFrame, in_format: str, targets: list[str], translator: Callable, key: str, rules: Rules = Rules(), out_format: str | None = None) -> DataFrame:
    """As ``subtitle_job``, from ``docs(key, text)``. Documents without a cue fail as ``render-failed``."""
    cues = subtitles.codec(in_format)[0](docs, key).withColumnRenamed("block_no", "pos")
    out = subtitle_job(cues.select(key, "pos", "start_ms", "end_ms", "lines"), targets, translator, key, rules, out_format or in_format)
    empty = docs.select(key).join(out, key, "left_anti").withColumn("target_language", F.explode(F.array(*[F.lit(t) for t in targets])))
    return out.unionByName(empty.select(key, "target_language", F.lit(None).cast("string").alias("text"), F.lit("render-failed").alias("error")))


def transcription_job(assets: DataFrame, transcriber: Callable, fmt: str = "srt") -> DataFrame:
    """(asset_id, text, error) for ``assets(asset_id, kind, has_audio, duration_ms, language)``, without translation."""
    checked = assets.withColumn("error", F.coalesce(V.language_error(V.segment_language(V.explicit_language(F.col("language")))), V.ready_error(F.col("kind"), F.col("has_audio"))))
    segments = transcriber(checked.where("error IS NULL"))
    cues = segments.select("asset_id", "idx", "start_ms", "end_ms", F.array("text").alias("lines"))
    tracks = render_tracks(cues, fmt, "asset_id")
    return checked.select("asset_id", F.col("error").alias("failed")).join(tracks, "asset_id", "left").select("asset_id", "text", F.coalesce("failed", "error", F.when(F.col("text").isNull(), "asr-failed")).alias("error"))


def routed_translation(segments: DataFrame, translators: dict[str, Callable], default: Callable, *key: str) -> tuple[DataFrame, DataFrame]:
    """``segments(key..., idx, source_text, source_language)``, each language by its own translator.

    Windows lie within one language, so the context of a segment is its neighbours in
    that language. Places are kept, which puts everything back in order.
    """
    out = errors = None
    routes = {**{k: (F.col("source_language") == k) for k in translators}, None: ~F.col("source_language").isin(*translators) if translators else F.lit(True)}
    for name, where in routes.items():
        own = segments.where(where).withColumn("__p", F.col("idx"))
        ranked = intervals.input_index(own.withColumn("pos", F.col("__p")), *key, "source_language").select(*key, "source_language", F.col("__p").alias("place"), "idx", "source_text")
        done, bad = translate_texts(ranked, translators.get(name, default), *key, "source_language")
        placed = ranked.join(done, [*key, "source_language", "idx"]).select(*key, F.col("place").alias("idx"), "source_language", "target_text")
        out, errors = (placed, bad) if out is None else (out.unionByName(placed), errors.unionByName(bad))
    return out, errors


def media_job(assets: DataFrame, hypotheses: DataFrame, targets: list[str], translators: dict[str, Callable], default: Callable, rules: Rules = Rules(), fmt: str = "srt") -> DataFrame:
    """(asset_id, target_language, text, error) from hypotheses (asset_id, pos, start, end, text, confidence, language).

    A transcript may not be translated into its own language.
    """
    bad = [t for t in targets if t not in V.LANGUAGES]
    if bad or not targets:
        raise ValueError(f"unsupported-language: {bad}" if bad else "no target language")
    transcript = V.segment_language(V.explicit_language(F.col("asset_language")))
    ready = assets.select("asset_id", F.col("language").alias("asset_language"), V.ready_error(F.col("kind"), F.col("has_audio")).alias("failed"))
    segments = intervals.input_index(asr.normalize_segments(hypotheses, "asset_id").withColumn("pos", F.struct("start_ms", "pos")), "asset_id")
    known = segments.join(ready.where("failed IS NULL"), "asset_id").withColumn("source_language", F.coalesce("language", transcript))
    fanned = known.select("asset_id", "idx", "start_ms", "end_ms", F.col("text").alias("source_text"), "source_language", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target_language"))
    done, errors = routed_translation(fanned, translators, default, "asset_id", "target_language")
    units = fanned.join(done.drop("source_language"), ["asset_id", "target_language", "idx"])
    cues = units.select("asset_id", "target_language", F.col("idx").alias("pos"), "start_ms", "end_ms", T.split_lines(F.col("target_text")).alias("lines"))
    tracks = render_tracks(reflow(cues, rules, "asset_id", "target_language"), fmt, "asset_id", "target_language")
    worst = errors.groupBy("asset_id", "target_language").agg(F.min("error").alias("broke"))
    jobs = ready.withColumn("target_language", F.explode(F.array(*[F.lit(t) for t in targets])))
    same = F.when(transcript == F.col("target_language"), "translation-failed")
    joined = jobs.join(tracks, ["asset_id", "target_language"], "left").join(worst, ["asset_id", "target_language"], "left")
    error = F.coalesce("failed", same, "broke", "error", F.when(F.col("text").isNull(), "asr-failed"))
    return joined.withColumn("fault", error).select("asset_id", "target_language", F.when(F.col("fault").isNull(), F.col("text")).alias("text"), F.col("fault").alias("error"))
