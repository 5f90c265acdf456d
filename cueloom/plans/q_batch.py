"""Queries: batching, translation, validation, cache and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import validation as B
from ..operators import batching, jobs, store, telemetry
from ..operators.ports import translators
from . import pipelines
from . import views as V
from .views import LINE, RAW, query


def _talk(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


_RANKED = "r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations)"


@query(f"""WITH {_RANKED}, a AS (SELECT conv_id, list(text ORDER BY p) AS v FROM r GROUP BY conv_id), w AS (SELECT conv_id, v, unnest(range(0, len(v), 3)) AS s FROM a)
SELECT conv_id, s // 3 AS win_idx, v[s + 1 : s + 3] AS texts, v[greatest(s - 2, 0) + 1 : s] AS before, v[s + 4 : s + 5] AS after FROM w""")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    return batching.context_windows(_talk(spark, sf), 3, 2, "turn", "text", "conv_id")


@query(f"WITH {_RANKED} SELECT conv_id, p // 4 AS chunk, list(text ORDER BY p) AS texts FROM r GROUP BY conv_id, p // 4")
def chunk_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batching.chunks(_talk(spark, sf), 4, "turn", "text", "conv_id")


_GROUPS = "g AS (SELECT conv_id, role, list(turn ORDER BY turn) AS indices, list(text ORDER BY turn) AS items, min(turn) AS first FROM conversations GROUP BY conv_id, role)"


@query(f"WITH {_GROUPS} SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS grp_idx, indices, items FROM g")
def language_groups(spark: SparkSession, sf: str) -> DataFrame:
    return batching.index_groups(_talk(spark, sf), "role", "turn", "text", "conv_id")


@query("SELECT conv_id, list(text ORDER BY turn) AS texts, CAST(NULL AS VARCHAR) AS error FROM conversations GROUP BY conv_id")
def scatter_order(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by role put back in order."""
    talk = _talk(spark, sf)
    groups = batching.index_groups(talk, "role", "turn", "text", "conv_id")
    return batching.scatter(groups, talk.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")


@query(f"""WITH {_RANKED}, d AS (SELECT conv_id, p, replace(upper(text), 'ẞ', 'SS') AS target FROM r), j AS (SELECT * FROM r FULL JOIN d USING (conv_id, p))
SELECT conv_id, p, text, target, CASE WHEN bool_or(text IS NULL OR target IS NULL) OVER (PARTITION BY conv_id) THEN 'translation-failed' END AS error FROM j""")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and translations by position; where one is missing the whole conversation fails."""
    from pyspark.sql import Window

    ranked = _talk(spark, sf).select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("bigint").alias("p"), "text")
    done = ranked.select("conv_id", "p", F.upper("text").alias("target"))
    return batching.zip_positions(ranked, done, ["conv_id", "p"], ["conv_id"]).select("conv_id", "p", "text", "target", "error")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    lang = F.when(F.col("turn") % 3 == 0, "fr").when(F.col("turn") % 3 == 1, "de").otherwise("en")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint")
    return _talk(spark, sf).select("conv_id", idx.alias("idx"), F.col("text").alias("source_text"), lang.alias("source_language"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, text AS target_text FROM conversations")
def translate_identity(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.translate_texts(_segments(spark, sf), translators.make("identity"), "conv_id", size=3, around=1)[0]


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, CASE turn % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'en' END AS source_language, CASE turn % 3 WHEN 2 THEN text ELSE replace(upper(text), 'ẞ', 'SS') END AS target_text FROM conversations")
def translate_routed_upper(spark: SparkSession, sf: str) -> DataFrame:
    upper = translators.make("upper")
    return pipelines.routed_translation(_segments(spark, sf), {"fr": upper, "de": upper}, translators.make("identity"), "conv_id")[0]


@query("SELECT conv_id, t.target, count(*) AS units, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations, (SELECT unnest(['pt', 'ja', 'es']) AS target) t GROUP BY ALL")
def multi_target_fanout(spark: SparkSession, sf: str) -> DataFrame:
    fanned = _talk(spark, sf).withColumn("target", F.explode(F.array(*map(F.lit, ("pt", "ja", "es")))))
    return fanned.groupBy("conv_id", "target").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("chars"))


@query("SELECT conv_id, CASE WHEN min(CASE WHEN turn % 4 = 3 THEN turn END) IS NULL THEN list(text ORDER BY turn) END AS texts, 'turn ' || min(CASE WHEN turn % 4 = 3 THEN turn END) AS error FROM conversations GROUP BY conv_id")
def first_error_wins(spark: SparkSession, sf: str) -> DataFrame:
    results = _talk(spark, sf).select("conv_id", F.col("turn").alias("win_idx"), F.when(F.col("turn") % 4 == 3, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("error"), F.array("text").alias("ok"))
    return batching.reassemble(results, "win_idx", "conv_id")


@query(f"WITH {_RANKED} SELECT conv_id, p // 2 AS win_idx, CASE WHEN p // 2 % 2 = 1 THEN list(replace(upper(text), 'ẞ', 'SS') ORDER BY p) ELSE list(text ORDER BY p) END AS ok FROM r GROUP BY conv_id, p // 2")
def chunk_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Odd chunks fail with the first translator and are given to the second."""
    from ..operators.ports import chunk_fallback as either

    primary = lambda b: b.withColumn("ok", F.when(F.col("win_idx") % 2 == 0, F.col("texts"))).withColumn("error", F.when(F.col("win_idx") % 2 == 1, "http 503"))
    batches = batching.context_windows(_talk(spark, sf), 2, 1, "turn", "text", "conv_id")
    return either(primary, translators.make("upper"))(batches).select("conv_id", "win_idx", "ok")


#: Written out once more, so that a wrong entry of the library's table shows.
_LANGS = "'und', 'en', 'en-us', 'pt', 'pt-BR', 'es', 'es-419', 'fr', 'de', 'ru', 'zh', 'zh-hans', 'zh-cn', 'zh-tw', 'ja', 'ar', 'he', 'fa'"


@query(f"SELECT doc_id, tag, CASE WHEN tag IS NULL OR tag NOT IN ({_LANGS}) THEN 'unsupported-language' END AS error FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '-xx' ELSE lang END AS tag FROM documents)")
def language_validation(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("doc_id") % 4 == 0, F.upper("lang")).when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit("-xx"))).otherwise(F.col("lang"))
    return V.table(spark, sf, "documents").select("doc_id", tag.alias("tag")).withColumn("error", B.language_error(F.col("tag")))


_RANGE = "CASE WHEN s IS NULL OR s < 0 THEN 'invalid-timecode' WHEN e IS NULL OR e < 0 THEN 'invalid-timecode' WHEN s > e THEN 'inverted-time-range' END"


@query(f"SELECT k, s, e, {_RANGE} AS error FROM (SELECT o_orderkey AS k, o_custkey % 100 - 5 AS s, o_orderkey % 100 - 2 AS e FROM orders)")
def range_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100 - 5).alias("s"), (F.col("o_orderkey") % 100 - 2).alias("e"))
    return rows.withColumn("error", B.range_error(F.col("s"), F.col("e")))


@query(f"""WITH {RAW}, x AS (SELECT pos, start_ms - CASE WHEN pos % 11 = 0 THEN 4000000000000 ELSE 0 END AS s, end_ms AS e, pos % 13 - 1 AS idx, CASE WHEN pos % 7 = 0 THEN ' ' ELSE text END AS text, pos % 6 / 4.0 AS conf, CASE pos % 5 WHEN 0 THEN NULL WHEN 1 THEN 'xx' ELSE 'en' END AS lang FROM v_raw)
SELECT pos, coalesce({_RANGE}, CASE WHEN NOT conf BETWEEN 0 AND 1 THEN 'invalid-confidence' END, CASE WHEN lang IS NOT NULL AND lang NOT IN ({_LANGS}) THEN 'unsupported-language' END, CASE WHEN idx <= 0 OR trim(text) = '' THEN 'asr-failed' END) AS error FROM x""")
def segment_validation(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pos")
    s = F.col("start_ms") - F.when(p % 11 == 0, 4_000_000_000_000).otherwise(0)
    lang = F.when(p % 5 == 0, F.lit(None).cast("string")).when(p % 5 == 1, "xx").otherwise("en")
    return V.raw_segments(spark, sf).select("pos", B.segment_error(s, F.col("end_ms"), p % 6 / 4.0, lang, p % 13 - 1, F.when(p % 7 == 0, " ").otherwise(F.col("text"))).alias("error"))


@query(f"WITH {LINE} SELECT doc_id, pos, CASE WHEN pos % 6 = 0 OR trim(line) = '' THEN 'render-failed' END AS error FROM v_line")
def cue_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.cues(spark, sf)
    return rows.select("doc_id", "pos", B.cue_error(F.col("start_ms"), F.col("end_ms"), F.col("pos") % 6, F.col("lines")).alias("error"))


@query(f"SELECT doc_id, coalesce(CASE WHEN lang NOT IN ({_LANGS}) THEN 'unsupported-language' END, CASE WHEN fmt NOT IN ('srt', 'vtt', 'ass') THEN 'unsupported-format' END) AS error FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'tlh' ELSE lang END AS lang, ['srt', 'vtt', 'ass', 'txt'][doc_id % 4 + 1] AS fmt FROM documents)")
def track_validation(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.when(F.col("doc_id") % 5 == 0, "tlh").otherwise(F.col("lang"))
    fmt = F.element_at(F.array(*map(F.lit, ("srt", "vtt", "ass", "txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return V.table(spark, sf, "documents").select("doc_id", B.track_error(lang, fmt).alias("error"))


_URI = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/media.d/film ' || page_id || '.Srt' WHEN 2 THEN 'ftp://host.tv/clip.vtt?x=1.mp4#a.srt' ELSE 'dir.srt/movie' END"


def _uris(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 4
    uri = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/media.d/film "), F.col("page_id").cast("string"), F.lit(".Srt"))).when(k == 2, "ftp://host.tv/clip.vtt?x=1.mp4#a.srt").otherwise("dir.srt/movie")
    return V.table(spark, sf, "pages").select("page_id", uri.alias("uri"))


@query(f"""WITH u AS (SELECT page_id, {_URI} AS uri FROM pages), s AS (SELECT *, string_split(regexp_split_to_array(uri, '[?#]')[1], '/')[-1] AS seg FROM u),
x AS (SELECT *, CASE WHEN contains(seg, '.') THEN nullif(lower(string_split(regexp_replace(seg, '\\.+$', ''), '.')[-1]), '') END AS ext FROM s) SELECT page_id, ext, CASE WHEN ext IN ('srt', 'vtt', 'ass') THEN 'subtitle' ELSE 'video' END AS kind FROM x""")
def infer_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _uris(spark, sf).select("page_id", M.source_extension(F.col("uri")).alias("ext"), M.infer_kind(F.col("uri")).alias("kind"))


@query(f"SELECT page_id, regexp_matches(uri, '(?i)^(https?|ftps?|rtmpe?|rtsp)://') AS remote FROM (SELECT page_id, {_URI} AS uri FROM pages)")
def remote_source(spark: SparkSession, sf: str) -> DataFrame:
    return _uris(spark, sf).select("page_id", M.is_remote(F.col("uri")).alias("remote"))


@query("SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'job-id' END, CASE WHEN doc_id % 3 = 0 THEN 'source' END, CASE WHEN doc_id % 5 = 0 THEN 'target-language' END], lambda k: k IS NOT NULL) AS missing FROM documents")
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    given = lambda n: F.when(F.col("doc_id") % n != 0, F.col("doc_id").cast("string"))
    return V.table(spark, sf, "documents").select("doc_id", B.missing_keys({"job-id": given(2), "source": given(3), "target-language": given(5)}).alias("missing"))


_ACTION = "CASE WHEN event_id % 17 = 0 THEN 'complete' WHEN event_id % 19 = 0 THEN 'fail' ELSE 'advance' END"


def actions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return V.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), k.alias("seq"), F.when(k % 17 == 0, "complete").when(k % 19 == 0, "fail").otherwise("advance").alias("action"))


_STATES = "'pending', 'ingesting', 'transcribing', 'translating', 'rendering', 'completed'"
JOB_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, {_ACTION} AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT DISTINCT job_id, 0 AS n, 0 AS st, 0 AS refused FROM e UNION ALL
SELECT f.job_id, e.n, CASE WHEN st >= 5 THEN st WHEN a = 'advance' THEN st + 1 WHEN a = 'complete' THEN 5 ELSE 6 END, refused + CASE WHEN st >= 5 THEN 1 ELSE 0 END FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1)
SELECT job_id, [{_STATES}, 'failed'][st + 1] AS state, CAST(refused AS BIGINT) AS refused FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1"""


@query(JOB_SQL)
def job_fsm(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.final_states(actions(spark, sf), "job_id")


@query("SELECT doc_id, list_distinct_ordered AS targets FROM (SELECT doc_id, list(t ORDER BY i) AS list_distinct_ordered FROM (SELECT doc_id, trim(t) AS t, min(i) AS i FROM (SELECT doc_id, unnest([lang, ' ', lang || ' ', 'ja', ' ja']) AS t, unnest([1, 2, 3, 4, 5]) AS i FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE doc_id % 2 = 1) WHERE trim(t) <> '' GROUP BY doc_id, trim(t)) GROUP BY doc_id)")
def normalize_targets(spark: SparkSession, sf: str) -> DataFrame:
    many = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit(" "), F.concat("lang", F.lit(" ")), F.lit("ja"), F.lit(" ja"))).otherwise(F.expr("cast(array() as array<string>)"))
    return V.table(spark, sf, "documents").select("doc_id", B.normalize_targets(F.col("lang"), many).alias("targets"))


_KEY = "sha256(coalesce(sha256(text), '') || ' ' || coalesce(source, '') || ' ' || '' || ' ' || coalesce(lang, '') || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'grid' ELSE '' END || ' ' || CASE WHEN doc_id % 3 = 0 THEN '200' ELSE '' END)"


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    key = store.transcript_key(store.content_sha(F.col("text").cast("binary")), F.col("source"), none, F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "grid"), F.when(F.col("doc_id") % 3 == 0, 200))
    return V.table(spark, sf, "documents").select("doc_id", key.alias("key"))


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def transcript_key(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf)


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_sha(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", store.content_sha(F.col("text").cast("binary")).alias("sha"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf: str) -> DataFrame:
    return content_sha(spark, sf).groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_CACHE = f"c AS (SELECT {_KEY} AS key, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 10 END AS cached_at, doc_id * 10 AS mtime, 'p' || doc_id AS payload FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    labelled = V.table(spark, sf, "labels").select("doc_id")
    return _keyed(spark, sf).join(labelled, "doc_id", "left_semi").select("key", F.when(d % 5 != 0, d * 10).alias("cached_at"), (d * 10).alias("mtime"), F.concat(F.lit("p"), d.cast("string")).alias("payload"))


@query(f"WITH {_CACHE}, k AS (SELECT doc_id, {_KEY} AS key FROM documents) SELECT k.doc_id, k.key, payload, payload IS NOT NULL AS cached FROM k LEFT JOIN c USING (key)")
def cache_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return store.fetch(_keyed(spark, sf), _cache(spark, sf))


@query(f"WITH {_CACHE} SELECT key, payload FROM c WHERE cached_at IS NULL OR 5000 - cached_at <= 2000")
def cache_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return store.live(_cache(spark, sf), 5000, 2000).select("key", "payload")


@query(f"WITH {_CACHE} SELECT key, mtime FROM c WHERE 8000 - mtime <= 3000")
def cache_evict(spark: SparkSession, sf: str) -> DataFrame:
    return store.evict(_cache(spark, sf), 8000, 3000).select("key", "mtime")


@query(f"WITH {_CACHE}, k AS (SELECT doc_id, {_KEY} AS key FROM documents) SELECT doc_id FROM k WHERE key NOT IN (SELECT key FROM c)")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return store.misses(_keyed(spark, sf), _cache(spark, sf)).select("doc_id")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("provider"),
        F.col("l_linestatus").alias("model"),
        F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity").cast("bigint")).alias("input_tokens"),
        F.col("l_linenumber").cast("bigint").alias("output_tokens"),
        (F.col("l_quantity").cast("bigint") + F.col("l_linenumber")).alias("total_tokens"),
        telemetry.usd_to_micros(F.round(F.col("l_extendedprice") * 100).cast("bigint") / F.lit(100).cast("decimal(10,0)")).alias("cost_micros"),
    )


@query("SELECT l_returnflag AS provider, l_linestatus AS model, CAST(sum(CASE WHEN l_partkey % 7 > 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber) AS BIGINT) AS output_tokens, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS total_tokens, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * 10000) AS BIGINT) AS cost_micros, count(*) AS attempts FROM lineitem GROUP BY ALL")
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.usage_rollup(_attempts(spark, sf), "provider", "model")


@query("SELECT o_custkey AS job_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt FROM orders")
def attempt_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.number_attempts(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "job_id").drop("o_orderdate")


_BODY = """CASE event_id % 4 WHEN 0 THEN printf('{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"cost":0.%03d5}}', event_id % 50, event_id % 9, event_id % 1000)
WHEN 1 THEN printf('{"usage":{"input_tokens":%d,"output_tokens":%d,"total_tokens":%d,"cost_micros":%d}}', event_id % 50, event_id % 9, event_id, event_id % 77) WHEN 2 THEN printf('{"usage":{"prompt_tokens":%d}}', event_id % 50) ELSE '{"model":"m"}' END"""


@query(f"""WITH b AS (SELECT event_id, {_BODY} AS body FROM events), u AS (SELECT event_id, coalesce(body->>'$.usage.prompt_tokens', body->>'$.usage.input_tokens')::BIGINT AS i, coalesce(body->>'$.usage.completion_tokens', body->>'$.usage.output_tokens')::BIGINT AS o, (body->>'$.usage.total_tokens')::BIGINT AS t,
coalesce((body->>'$.usage.cost_micros')::BIGINT, CAST(round((body->>'$.usage.cost')::DECIMAL(30,12) * 1000000, 0) AS BIGINT)) AS c FROM b) SELECT event_id, i AS input_tokens, o AS output_tokens, coalesce(t, i + o) AS total_tokens, c AS cost_micros FROM u""")
def usage_normalize(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    body = (
        F.when(k % 4 == 0, F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"cost":0.%03d5}}', k % 50, k % 9, k % 1000))
        .when(k % 4 == 1, F.format_string('{"usage":{"input_tokens":%d,"output_tokens":%d,"total_tokens":%d,"cost_micros":%d}}', k % 50, k % 9, k, k % 77))
        .when(k % 4 == 2, F.format_string('{"usage":{"prompt_tokens":%d}}', k % 50))
        .otherwise('{"model":"m"}')
    )
    return V.table(spark, sf, "events").select("event_id", body.alias("body")).select("event_id", telemetry.normalize_usage(F.col("body")).alias("u")).select("event_id", "u.*")


@query("SELECT o_orderkey, o_orderkey % 6 AS attempt, CAST(250 * pow(2, o_orderkey % 6) AS BIGINT) AS delay_ms, (s = 429 OR s BETWEEN 500 AND 599) AS retry FROM (SELECT o_orderkey, 400 + o_custkey % 220 AS s FROM orders)")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    return V.table(spark, sf, "orders").select("o_orderkey", k.alias("attempt"), telemetry.retry_delay(250, k).alias("delay_ms"), B.retryable(400 + F.col("o_custkey") % 220).alias("retry"))
