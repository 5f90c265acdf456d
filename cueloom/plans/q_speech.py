"""Queries: speech post-processing, render planning, evaluation and the two other ways in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import text as T
from ..operators import asr, evaluation
from ..operators.ports import segmenters, transcribers, translators
from ..operators.reflow import Rules
from . import pipelines
from . import views as V
from .views import CUE, RAW, clock_sql, query


@query()
def vad_spans(spark: SparkSession, sf: str) -> DataFrame:
    probs = F.transform("embedding", lambda x: F.abs(x) * 3)
    clips = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"), probs.alias("probs"), (F.size("embedding") * 512).cast("bigint").alias("n_samples"))
    return asr.speech_spans(clips, 16000, "asset_id", min_speech_ms=60, min_silence_ms=64, max_span_ms=500).select("asset_id", "start_ms", "end_ms")


@query()
def padded_window_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as decode windows of a conversation: each repeats the end of the one before."""
    talk = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("window"), "text")
    w = Window.partitionBy("asset_id").orderBy("window")
    seams = talk.select("asset_id", "window", F.array_join(T.words(F.col("text")), " ").alias("own")).withColumn("before", F.coalesce(F.lag("own").over(w), F.col("own")))
    rows = seams.select("asset_id", "window", F.posexplode(F.array("before", "own")).alias("pos", "text"))
    at = F.col("window") * 1000 + F.col("pos") * 400
    timed = rows.select("asset_id", "window", "pos", (F.col("window") * 1000 + 300).alias("span_start_ms"), at.alias("start_ms"), (at + 400).alias("end_ms"), "text")
    return asr.merge_padded(timed, "asset_id")


_TOKENS = "t AS (SELECT conv_id, turn, i - 1 AS pos, CASE WHEN i % 3 = 1 THEN '▁' || w ELSE w END AS token FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations)))"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    return rows.select("conv_id", "turn", "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("▁"), "w")).otherwise(F.col("w")).alias("token"), (F.col("pos") * 100).cast("bigint").alias("start_ms"))


@query(f"""WITH {_TOKENS}, n AS (SELECT *, sum(CASE WHEN starts_with(token, '▁') OR starts_with(token, ' ') OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS word FROM t),
g AS (SELECT conv_id, turn, word, min(pos) * 100 AS start_ms, string_agg(token, '' ORDER BY pos) AS text FROM n GROUP BY ALL)
SELECT conv_id, turn, CAST(word AS BIGINT) AS word, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY conv_id, turn ORDER BY word), 1000000) AS end_ms, trim(replace(text, '▁', ' ')) AS text FROM g QUALIFY trim(replace(text, '▁', ' ')) <> ''""")
def token_words(spark: SparkSession, sf: str) -> DataFrame:
    return asr.group_tokens(_tokens(spark, sf), F.lit(1_000_000).cast("bigint"), "conv_id", "turn")


@query("""WITH t AS (SELECT conv_id, turn, i - 1 AS pos, CASE WHEN i % 7 = 3 THEN printf('<|%d.5|>', i) WHEN i % 11 = 0 THEN '<|en|>' ELSE ' ' || w END AS token FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations))),
m AS (SELECT *, CASE WHEN regexp_full_match(token, '<\\|\\d+(\\.\\d+)?\\|>') THEN CAST(regexp_extract(token, '<\\|(\\d+(?:\\.\\d+)?)\\|>', 1) AS DOUBLE) END AS ts FROM t),
s AS (SELECT *, count(ts) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS seg FROM m),
g AS (SELECT conv_id, turn, seg, max(ts) AS st, coalesce(string_agg(CASE WHEN ts IS NULL AND NOT regexp_full_match(token, '<\\|.*\\|>') THEN token END, '' ORDER BY pos), '') AS text FROM s GROUP BY ALL),
e AS (SELECT *, coalesce(lead(st) OVER (PARTITION BY conv_id, turn ORDER BY seg), 9999.0) AS en, max(seg) OVER (PARTITION BY conv_id, turn) AS marks FROM g)
SELECT conv_id, turn, seg, coalesce(st, 0.0) AS start, en AS "end", text FROM e WHERE text <> '' AND (seg > 0 OR marks = 0)""".replace("\\\\", "\\"))
def timestamp_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    i = F.col("pos") + 1
    token = F.when(i % 7 == 3, F.format_string("<|%d.5|>", i)).when(i % 11 == 0, "<|en|>").otherwise(F.concat(F.lit(" "), "w"))
    return asr.timestamp_segments(rows.select("conv_id", "turn", "pos", token.alias("token")), F.lit(9999.0), "conv_id", "turn")


_STUB = "s AS (SELECT doc_id AS asset_id, lang, dur, unnest(range(0, dur, 5000)) AS s FROM (SELECT doc_id, lang, greatest(1, n_chars * 60) AS dur FROM documents)), st AS (SELECT asset_id, s // 5000 + 1 AS idx, s AS start_ms, least(s + 5000, dur) AS end_ms, printf('[%s segment %d]', lang, s // 5000 + 1) AS text FROM s)"


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), F.lit("audio").alias("kind"), F.lit(True).alias("has_audio"), (F.col("n_chars") * 60).alias("duration_ms"), F.col("lang").alias("language"))


@query(f"WITH {_STUB} SELECT * FROM st")
def stub_transcribe(spark: SparkSession, sf: str) -> DataFrame:
    return transcribers.make("stub")(_assets(spark, sf))


@query("SELECT doc_id AS asset_id, s AS start_ms, least(s + 30000, n_chars * 60) AS end_ms FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars * 60, 30000)) AS s FROM documents WHERE n_chars > 0)")
def grid_segmenter(spark: SparkSession, sf: str) -> DataFrame:
    return segmenters.make("grid")(_assets(spark, sf)).select("asset_id", "start_ms", "end_ms")


@query(f"WITH {_STUB} SELECT asset_id, string_agg(idx || chr(10) || {clock_sql('start_ms')} || ' --> ' || {clock_sql('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY idx) || chr(10) AS text, CAST(NULL AS VARCHAR) AS error FROM st GROUP BY asset_id")
def ingress_transcribe(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.transcription_job(_assets(spark, sf), transcribers.make("stub"))


@query()
def ingress_media(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.raw_segments(spark, sf)
    lang = F.when(F.col("pos") % 3 == 0, "fr").when(F.col("pos") % 3 == 1, "de")
    base = raw.groupBy("asset_id").agg(F.min("start_ms").alias("t0"))
    hyps = raw.join(base, "asset_id").select("asset_id", "pos", (F.col("start_ms") - F.col("t0")).cast("double").alias("start"), (F.col("end_ms") - F.col("t0")).cast("double").alias("end"), F.concat_ws(" ", F.lit("said"), "text").alias("text"), F.lit(None).cast("double").alias("confidence"), lang.alias("language"))
    assets = base.select("asset_id", F.when(F.col("asset_id") % 7 == 0, "audio").otherwise("video").alias("kind"), (F.col("asset_id") % 11 != 0).alias("has_audio"), F.when(F.col("asset_id") % 5 == 0, "es").alias("language"))
    return pipelines.media_job(assets, hyps, ["en", "es"], {"fr": translators.make("upper")}, translators.make("identity"), Rules(max_dur_ms=7000))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS token FROM embeddings")
def argmax_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "embeddings").select("vec_id", asr.argmax_last(F.col("embedding")).alias("token"))


@query("""WITH b AS (SELECT p_partkey, 640 + p_size * 37 AS w, 360 + p_size * 23 AS h, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey * 1000 END AS vb, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 96000 END AS ab, 24.0 + p_size % 7 AS fps, ['source', '2160p', '1080p', '720p', '480p', '360p'][p_partkey % 6 + 1] AS q FROM part),
t AS (SELECT *, CASE q WHEN '2160p' THEN 2160 WHEN '1080p' THEN 1080 WHEN '720p' THEN 720 WHEN '480p' THEN 480 WHEN '360p' THEN 360 END AS target FROM b),
d AS (SELECT *, coalesce(target >= h, true) AS same FROM t), e AS (SELECT *, CASE WHEN same THEN w ELSE CAST(floor(w::DOUBLE * (target::DOUBLE / h) + 0.5) AS BIGINT) END AS w1, CASE WHEN same THEN h ELSE target END AS h1 FROM d),
f AS (SELECT *, w1 + w1 % 2 AS w2, h1 + h1 % 2 AS h2 FROM e), g AS (SELECT *, CASE WHEN vb > 0 THEN vb ELSE CAST(trunc(0.10::DOUBLE * (w2 * h2) * fps::DOUBLE) AS BIGINT) END AS base FROM f)
SELECT p_partkey, w2 AS width, h2 AS height, greatest(400000, CASE WHEN w2 * h2 < w * h THEN CAST(trunc(base * ((w2 * h2)::DOUBLE / (w * h))) AS BIGINT) ELSE base END) AS video_bitrate, coalesce(ab, 128000) AS audio_bitrate FROM g""")
def encoding_plan(spark: SparkSession, sf: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    base = V.table(spark, sf, "part").select(
        "p_partkey",
        (640 + size * 37).alias("w"),
        (360 + size * 23).alias("h"),
        F.when(p % 4 == 0, F.lit(0).cast("bigint")).otherwise(p * 1000).alias("vb"),
        F.when(p % 3 != 0, F.lit(96000).cast("bigint")).alias("ab"),
        (24.0 + size % 7).alias("fps"),
        F.element_at(F.array(*map(F.lit, ("source", "2160p", "1080p", "720p", "480p", "360p"))), (p % 6 + 1).cast("int")).alias("q"),
    )
    w, h = M.target_dimensions(F.col("w"), F.col("h"), F.col("q"))
    sized = base.withColumn("width", w).withColumn("height", h)
    rate = M.video_bitrate(F.col("vb"), F.col("w"), F.col("h"), F.col("width"), F.col("height"), F.col("fps"))
    return sized.select("p_partkey", "width", "height", rate.alias("video_bitrate"), M.audio_bitrate(F.col("ab")).alias("audio_bitrate"))


@query("""WITH b AS (SELECT p_partkey, 360 + p_size * 20 AS h, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE NULL END AS px, CASE WHEN p_partkey % 5 = 0 THEN 2.5 ELSE 4.2 END::DOUBLE AS pct, CASE WHEN p_partkey % 7 = 0 THEN 1.5 ELSE 0.94 END::DOUBLE AS y, p_size / 40.0::DOUBLE AS op FROM part)
SELECT p_partkey, CASE WHEN px > 0 THEN px ELSE greatest(18, CAST(trunc(pct / 100.0::DOUBLE * h) AS BIGINT)) END AS font_px, greatest(0, least(h, CAST(trunc(y * h) AS BIGINT))) AS bottom, greatest(0, least(h, CAST(trunc(y * h) AS BIGINT))) - 30 * (2 - 1 - 0) AS first_baseline, greatest(0, least(255, CAST(floor(255.0::DOUBLE * op + 0.5) AS BIGINT))) AS alpha FROM b""")
def caption_layout(spark: SparkSession, sf: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    h = 360 + size * 20
    bottom = M.block_bottom(h, F.when(p % 7 == 0, 1.5))
    return V.table(spark, sf, "part").select(
        "p_partkey",
        M.font_size(h, F.when(p % 3 == 0, size), F.when(p % 5 == 0, 2.5)).alias("font_px"),
        bottom.alias("bottom"),
        M.baseline(bottom, F.lit(2).cast("bigint"), F.lit(30).cast("bigint"), F.lit(0).cast("bigint")).alias("first_baseline"),
        M.plate_alpha(size / 40.0).alias("alpha"),
    )


_HEX = "CASE p_partkey % 4 WHEN 0 THEN '#' || printf('%06x', p_partkey * 7919 % 16777216) WHEN 1 THEN printf('%03x', p_partkey % 4096) WHEN 2 THEN '#zzz' ELSE NULL END"


@query(f"""WITH c AS (SELECT p_partkey, replace({_HEX}, '#', '') AS s FROM part), d AS (SELECT *, CASE WHEN regexp_full_match(s, '[0-9a-fA-F]{{6}}') THEN s WHEN regexp_full_match(s, '[0-9a-fA-F]{{3}}') THEN s[1] || s[1] || s[2] || s[2] || s[3] || s[3] ELSE 'ffffff' END AS f FROM c)
SELECT p_partkey, [CAST('0x' || f[1:2] AS INTEGER), CAST('0x' || f[3:4] AS INTEGER), CAST('0x' || f[5:6] AS INTEGER)] AS rgb FROM d""")
def hex_rgb(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    color = F.when(p % 4 == 0, F.concat(F.lit("#"), F.format_string("%06x", p * 7919 % 16777216))).when(p % 4 == 1, F.format_string("%03x", p % 4096)).when(p % 4 == 2, "#zzz")
    return V.table(spark, sf, "part").select("p_partkey", M.hex_rgb(color).alias("rgb"))


@query(r"""WITH u AS (SELECT page_id, 'out/v1.2/' || page_id || CASE page_id % 3 WHEN 0 THEN '.tar.mp4' WHEN 1 THEN '' ELSE '.mkv' END AS uri FROM pages), s AS (SELECT *, regexp_replace(uri, '([^/])\.[^./]*$', '\1') AS base, regexp_extract(uri, '[^/](\.[^./]*)$', 1) AS ext FROM u)
SELECT page_id, base || '.subbed.mp4' AS sibling, base || '.fr' || ext AS variant, base || '.soft.mp4' AS soft, base || '.hard.mp4' AS hard FROM s""")
def output_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    uri = F.concat(F.lit("out/v1.2/"), k.cast("string"), F.when(k % 3 == 0, ".tar.mp4").when(k % 3 == 1, "").otherwise(".mkv"))
    return V.table(spark, sf, "pages").select("page_id", M.sibling_output(uri, ".subbed.mp4").alias("sibling"), M.language_variant(uri, F.lit(" fr ")).alias("variant"), M.sibling_output(uri, ".soft.mp4").alias("soft"), M.sibling_output(uri, ".hard.mp4").alias("hard"))


@query("SELECT conv_id, turn, printf('%04X', octet_length(encode(text))) || hex(encode(text)) AS sample FROM conversations")
def mov_text_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.hex(M.mov_text(F.col("text"))).alias("sample"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns against the next turn of their conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("hyp"), F.lead("text").over(w).alias("ref"))


_PAIRS = "pr AS (SELECT conv_id, turn, text AS hyp, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations)"


def _chrf_sql(pairs: str) -> str:
    gram = lambda c, h, r: f"SELECT conv_id, turn, n, substr(s, i, n) AS g, {h} AS h, {r} AS r FROM (SELECT conv_id, turn, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM (SELECT conv_id, turn, regexp_replace(coalesce({c}, ''), '\\s+', '', 'g') AS s, unnest(range(1, 7)) AS n FROM {pairs}) WHERE length(s) >= n)"
    return f"""gr AS ({gram('hyp', 1, 0)} UNION ALL {gram('ref', 0, 1)}), ct AS (SELECT conv_id, turn, n, g, sum(h) AS h, sum(r) AS r FROM gr GROUP BY ALL),
od AS (SELECT conv_id, turn, n, sum(least(h, r)) / sum(h) AS p, sum(least(h, r)) / sum(r) AS q FROM ct GROUP BY ALL HAVING sum(h) > 0 AND sum(r) > 0),
mn AS (SELECT conv_id, turn, avg(p) AS p, avg(q) AS q FROM od GROUP BY ALL),
sc AS (SELECT conv_id, turn, coalesce(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) END, 0.0) AS chrf FROM (SELECT DISTINCT conv_id, turn FROM {pairs}) LEFT JOIN mn USING (conv_id, turn))"""


@query(f"WITH {_PAIRS}, {_chrf_sql('pr')} SELECT conv_id, turn, round(chrf, 6) AS chrf FROM sc")
def chrf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.chrf(_pairs(spark, sf), "hyp", "ref", "conv_id", "turn").withColumn("chrf", F.round("chrf", 6))


@query(f"WITH {_PAIRS}, mv AS (SELECT conv_id, turn, hyp, coalesce(lead(hyp) OVER (PARTITION BY conv_id ORDER BY turn), first(hyp) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ref FROM pr), {_chrf_sql('mv')} SELECT conv_id, round(avg(chrf), 6) AS chance FROM sc GROUP BY conv_id")
def chance_level(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).select("conv_id", "turn", "hyp", F.col("hyp").alias("ref"))
    return evaluation.chance_level(rows, "hyp", "ref", "turn", "conv_id").withColumn("chance", F.round("chance", 6))


@query(r"WITH p AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 9) AS jaccard FROM p")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    t = V.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.col("other")), 9).alias("jaccard"))


@query(f"WITH {CUE}, h AS (SELECT doc_id, pos, start_ms + pos % 50 AS s2, end_ms - pos % 30 AS e2 FROM v_cue WHERE array_to_string(lines, '') <> '') SELECT doc_id, count(c.start_ms) AS n_reference, count(s2) AS n_hypothesis, count(CASE WHEN abs(start_ms - s2) <= 20 AND abs(end_ms - e2) <= 20 THEN 1 END) AS n_within FROM v_cue c LEFT JOIN h USING (doc_id, pos) GROUP BY doc_id")
def timing_report(spark: SparkSession, sf: str) -> DataFrame:
    ref = V.cues(spark, sf)
    hyp = ref.where("array_join(lines, '') <> ''").select("doc_id", "pos", (F.col("start_ms") + F.col("pos") % 50).alias("start_ms"), (F.col("end_ms") - F.col("pos") % 30).alias("end_ms"))
    return evaluation.timing_report(ref, hyp, 20, "doc_id")


@query(f"WITH {RAW} SELECT asset_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, count(*) AS n FROM v_raw GROUP BY asset_id")
def total_duration(spark: SparkSession, sf: str) -> DataFrame:
    return V.raw_segments(spark, sf).groupBy("asset_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count("*").alias("n"))
