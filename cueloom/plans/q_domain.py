"""Queries: the domain's small projections, lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import timecode as C
from ..functions import validation as B
from ..operators import jobs, telemetry
from . import views as V
from .views import RAW, query

#: Written out once more, so that a wrong entry of the library's table shows.
_LANGS = "'und', 'en', 'en-us', 'pt', 'pt-BR', 'es', 'es-419', 'fr', 'de', 'ru', 'zh', 'zh-hans', 'zh-cn', 'zh-tw', 'ja', 'ar', 'he', 'fa'"


@query("SELECT page_id, CASE WHEN trim(CASE WHEN page_id % 3 = 0 THEN '  ' ELSE url END) = '' THEN 'invalid-source' END AS error FROM pages")
def source_validation(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "pages").select("page_id", B.source_error(F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.col("url"))).alias("error"))


@query("SELECT l_orderkey, l_linenumber, score, CASE WHEN score IS NULL OR score < 0 OR score > 1 THEN 'invalid-confidence' END AS error FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 12 - 0.1 END AS score FROM lineitem)")
def confidence_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 12 - 0.1).alias("score"))
    return rows.withColumn("error", B.confidence_error(F.col("score")))


@query(f"SELECT doc_id, CASE WHEN s NOT IN ({_LANGS}) THEN 'unsupported-language' WHEN t NOT IN ({_LANGS}) THEN 'unsupported-language' WHEN s = t THEN 'translation-failed' END AS error FROM (SELECT doc_id, lang AS s, ['en', 'fr', 'xx'][doc_id % 3 + 1] AS t FROM documents)")
def translation_validation(spark: SparkSession, sf: str) -> DataFrame:
    target = F.element_at(F.array(*map(F.lit, ("en", "fr", "xx"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return V.table(spark, sf, "documents").select("doc_id", B.translation_error(F.col("lang"), target).alias("error"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'inverted-time-range' WHEN role = 'system' THEN 'unsupported-language' WHEN turn % 3 = 2 THEN 'translation-failed' END AS error FROM conversations")
def unit_validation(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    end = F.when(t % 4 == 3, t - 1).otherwise(t)
    return V.table(spark, sf, "conversations").select("conv_id", "turn", B.unit_error(t, end, F.when(F.col("role") == "system", "tlh"), F.when(t % 3 != 2, F.col("text"))).alias("error"))


_KINDS = "['video', 'audio', 'subtitle', 'image'][page_id % 4 + 1]"


@query(f"SELECT page_id, kind, CASE WHEN kind = 'image' THEN 'unsupported-format' END AS error, CASE WHEN kind = 'subtitle' OR page_id % 5 = 0 THEN NULL ELSE 'no-audio-stream' END AS not_ready, CASE kind WHEN 'video' THEN 'demux-asr' WHEN 'audio' THEN 'asr' WHEN 'subtitle' THEN 'parse' END AS path FROM (SELECT page_id, {_KINDS} AS kind FROM pages)")
def media_assets(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("video", "audio", "subtitle", "image"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = V.table(spark, sf, "pages").select("page_id", "url", kind.alias("kind"))
    return rows.select("page_id", "kind", B.asset_error(F.col("kind"), F.col("url")).alias("error"), B.ready_error(F.col("kind"), F.col("page_id") % 5 == 0).alias("not_ready"), B.ingress_path(F.col("kind")).alias("path"))


#: Written out once more, so that a wrong entry of the library's table shows.
_REMAP_SQL = """CASE code WHEN 'collect/source-not-found' THEN 'source-unreadable' WHEN 'fs/check-failed' THEN 'source-unreadable'
 WHEN 'collect/probe-failed' THEN 'probe-failed' WHEN 'collect/probe-timeout' THEN 'probe-failed'
 WHEN 'collect/extract-failed' THEN 'audio-extract-failed' ELSE code END"""
_CODES = ["collect/source-not-found", "fs/check-failed", "collect/probe-failed", "collect/probe-timeout", "collect/extract-failed", "probe/failed", "other"]


@query(f"SELECT event_id, {_REMAP_SQL} AS code FROM (SELECT event_id, [{', '.join(repr(x) for x in _CODES)}][event_id % 7 + 1] AS code FROM events)")
def error_remap(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % len(_CODES) + 1).cast("int"))
    return V.table(spark, sf, "events").select("event_id", L.remap_error(code).alias("code"))


_NAME_SQL = """CASE lower(split_part(trim(tag), '-', 1)) WHEN 'en' THEN 'English' WHEN 'zh' THEN 'Chinese' WHEN 'yue' THEN 'Cantonese'
 WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'pt' THEN 'Portuguese' WHEN 'it' THEN 'Italian'
 WHEN 'nl' THEN 'Dutch' WHEN 'ru' THEN 'Russian' WHEN 'ja' THEN 'Japanese' WHEN 'ko' THEN 'Korean' WHEN 'ar' THEN 'Arabic'
 WHEN 'hi' THEN 'Hindi' WHEN 'tr' THEN 'Turkish' WHEN 'vi' THEN 'Vietnamese' WHEN 'th' THEN 'Thai' WHEN 'id' THEN 'Indonesian'
 WHEN 'pl' THEN 'Polish' WHEN 'uk' THEN 'Ukrainian' WHEN 'sv' THEN 'Swedish' END"""
_TAGS = "en zh yue de fr es pt it nl ru ja ko ar hi tr vi th id pl uk sv he fa tlh".split()


@query(
    f"""SELECT doc_id, {_NAME_SQL} AS name FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(t) || '-' || source WHEN doc_id % 3 = 1 THEN ' ' || t ELSE t END AS tag
 FROM (SELECT doc_id, source, [{', '.join(repr(x) for x in _TAGS)}][doc_id % 24 + 1] AS t FROM documents))"""
)
def language_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every tag that has a name and some that have none, bare, with a region and with blanks."""
    t = F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("doc_id") % len(_TAGS) + 1).cast("int"))
    tag = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper(t), F.lit("-"), F.col("source"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), t)).otherwise(t)
    return V.table(spark, sf, "documents").select("doc_id", L.language_name(tag).alias("name"))


@query("SELECT o_orderkey, j.asset, c_name AS owner, n_name AS place FROM (SELECT o_orderkey, o_custkey, o_orderkey || '-asset' AS asset FROM orders) j JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def job_references(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates refer to one another by id, so they meet in equi-joins."""
    j = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("-asset")).alias("asset"))
    c, n = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    return j.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "asset", F.col("c_name").alias("owner"), F.col("n_name").alias("place"))


@query("WITH a AS (SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt, o_orderkey % 100 AS i, o_orderkey % 7 AS o FROM orders) SELECT c_custkey AS job_id, list(i ORDER BY attempt) FILTER (attempt IS NOT NULL) AS inputs, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens FROM customer LEFT JOIN a ON a.job_id = c_custkey GROUP BY c_custkey")
def attach_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Results with their attempts in order and their usage, failed ones too."""
    raw = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 100).alias("input_tokens"), (F.col("o_orderkey") % 7).alias("output_tokens"), F.lit(0).cast("bigint").alias("cost_micros"))
    tried = telemetry.number_attempts(raw.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")), ["o_orderdate", "o_orderkey"], "job_id").drop("o_orderkey", "o_orderdate")
    results = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))
    return telemetry.attach(results, tried).select("job_id", F.transform("attempts", lambda x: x["input_tokens"]).alias("inputs"), "input_tokens", "total_tokens")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'empty' ELSE 'complete' END AS status, coalesce(n, 0) AS members, CASE WHEN n IS NULL THEN 'asr-failed' END AS error FROM (SELECT c_custkey, (SELECT nullif(count(*), 0) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)")
def aggregate_seal(spark: SparkSession, sf: str) -> DataFrame:
    """A transcript without segments cannot be completed."""
    c = V.table(spark, sf, "customer").select("c_custkey", F.lit("empty").alias("status"))
    members = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.seal(c, members, "asr-failed", "c_custkey")


@query("SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CAST(regexp_extract(p_name || ' ' || p_size, '(\\d+)$', 1) AS INTEGER) DESC, p_partkey) = 1".replace("\\\\", "\\"))
def newest_version(spark: SparkSession, sf: str) -> DataFrame:
    """The highest version by number, not by text."""
    version = F.regexp_extract(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), r"(\d+)$", 1).cast("int")
    return V.table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-version, F.col("p_partkey"))).alias("p_partkey")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['font-size'] ELSE [] END AS clobbered FROM part")
def result_clobber(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("font-size"), F.lit("1"), F.lit("x"), F.lit("2"))).otherwise(F.create_map(F.lit("x"), F.lit("2")))
    return V.table(spark, sf, "part").select("p_partkey", B.clobbered(extra, ["font-size", "output"]).alias("clobbered"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size / 10.0 END::DOUBLE, 4.2) AS size_pct, coalesce(CASE WHEN p_size % 5 = 0 THEN '#000' END, '#ffffff') AS color FROM part")
def style_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Requested styles over defaults, a null counting as absent."""
    return V.table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 10.0), F.lit(4.2)).alias("size_pct"), F.coalesce(F.when(F.col("p_size") % 5 == 0, "#000"), F.lit("#ffffff")).alias("color"))


@query(f"WITH {RAW}, z AS (SELECT pos, (start_ms - min(start_ms) OVER (PARTITION BY asset_id)) % 100000 AS s, end_ms - start_ms AS d FROM v_raw) SELECT pos, greatest(0, least(800000, CAST(floor((s - 200) * 16000 / 1000.0) AS BIGINT))) AS a, greatest(0, least(800000, CAST(ceil((s + d + 200) * 16000 / 1000.0) AS BIGINT))) AS b FROM z")
def sample_ranges(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    raw = V.raw_segments(spark, sf)
    s = (F.col("start_ms") - F.min("start_ms").over(Window.partitionBy("asset_id"))) % 100000
    rows = raw.select("pos", s.alias("s"), (F.col("end_ms") - F.col("start_ms")).alias("d"))
    a, b = C.sample_range(F.col("s"), F.col("s") + F.col("d"), 200, 16000, F.lit(800000).cast("bigint"))
    return rows.select("pos", a.alias("a"), b.alias("b"))


@query("SELECT vec_id, embedding[17:32] AS part, 16 * 1000 // 8 AS offset_ms FROM embeddings")
def sample_slices(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 17, 16).alias("part"), F.lit(2000).alias("offset_ms"))


@query(
    """SELECT * FROM (VALUES ('pending', 'pending', 'ingesting', NULL), ('ingesting', 'extracting audio', 'transcribing', NULL), ('transcribing', 'transcribing', 'translating', NULL),
 ('translating', 'translating', 'rendering', NULL), ('rendering', 'rendering subtitles', 'completed', NULL), ('completed', 'completed', NULL, 'illegal-transition'), ('failed', 'failed', NULL, 'illegal-transition')) t(state, label, next, error)"""
)
def state_table(spark: SparkSession, sf: str) -> DataFrame:
    states = spark.createDataFrame([(s,) for s in B.DESCRIPTIONS], "state string")
    return states.select("state", B.describe_state(F.col("state")).alias("label"), B.advance_state(F.col("state")).alias("next"), jobs.guard_transition(F.col("state"), *B.JOB_STATES[:-1]).alias("error"))


@query("SELECT doc_id, lang, CASE WHEN lang IN ('', 'auto', 'multi', 'und') THEN NULL ELSE lang END AS explicit, coalesce(CASE WHEN lang IN ('', 'auto', 'multi', 'und') THEN NULL ELSE lang END, 'und') AS resolved FROM (SELECT doc_id, ['auto', '', 'und', lang, lang][doc_id % 5 + 1] AS lang FROM documents)")
def auto_language(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.element_at(F.array(F.lit("auto"), F.lit(""), F.lit("und"), F.col("lang"), F.col("lang")), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = V.table(spark, sf, "documents").select("doc_id", lang.alias("lang"))
    explicit = B.explicit_language(F.col("lang"))
    return rows.select("doc_id", "lang", explicit.alias("explicit"), B.segment_language(explicit).alias("resolved"))


@query("SELECT t.transcriber, s.segmenter, t.transcriber IN ('canary', 'parakeet', 'qwen3-asr') AND s.segmenter = 'grid' AS refused FROM (SELECT unnest(['stub', 'canary', 'parakeet', 'qwen3-asr']) AS transcriber) t, (SELECT unnest(['grid', 'silero-vad', 'none']) AS segmenter) s")
def routing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of the two small capability tables, and whether it is refused."""
    from ..operators.ports import incompatible

    pairs = [(t, s, incompatible(t, s)) for t in ("stub", "canary", "parakeet", "qwen3-asr") for s in ("grid", "silero-vad", "none")]
    return spark.createDataFrame(pairs, "transcriber string, segmenter string, refused boolean")
