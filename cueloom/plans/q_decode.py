"""Queries: from what speech models give to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as L
from ..operators import decoding as D
from . import views as V
from .views import query


@query(
    """WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN 503 ELSE 200 END AS status FROM conversations)
SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, CAST(1.5 * turn AS DOUBLE) AS start, CAST(1.5 * turn + 1 AS DOUBLE) AS "end", coalesce(text, '') AS text, NULL AS error FROM r WHERE status = 200 AND turn % 5 < 2
UNION ALL SELECT conv_id, turn, 1, CAST(1.5 * turn + 1 AS DOUBLE), CAST(1.5 * turn + 2 AS DOUBLE), 'second', NULL FROM r WHERE status = 200 AND turn % 5 < 2
UNION ALL SELECT conv_id, turn, 0, CAST(0 AS DOUBLE), CAST(2.5 AS DOUBLE), coalesce(text, ''), NULL FROM r WHERE turn % 5 = 2
UNION ALL SELECT conv_id, turn, 0, NULL, NULL, NULL, 'asr-failed' FROM r WHERE turn % 5 IN (3, 4)"""
)
def response_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with segments, with text alone, with a body that is no JSON, and with an error status."""
    rows = V.table(spark, sf, "conversations")
    at = 1.5 * F.col("turn")
    text = F.coalesce("text", F.lit(""))
    one = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), t.alias("text"))
    segmented = F.to_json(F.struct(F.array(one(at, at + 1, text), one(at + 1, at + 2, F.lit("second"))).alias("segments")))
    k = F.col("turn") % 5
    body = F.when(k < 2, segmented).when(k == 2, F.to_json(F.struct(text.alias("text")))).when(k == 3, "<html>busy</html>").otherwise(segmented)
    replies = rows.select("conv_id", "turn", F.when(k == 4, 503).otherwise(200).alias("status"), body.alias("body"))
    found = D.response_segments(replies, F.col("status"), F.col("body"), F.lit(2500), "conv_id", "turn")
    return found.select("conv_id", "turn", "pos", "start", "end", "text", "error")


@query("SELECT doc_id, k AS chunk, k * 480000 AS \"offset\", least(480000, n - k * 480000) AS size FROM (SELECT doc_id, n, unnest(range(0, (greatest(n, 1) + 479999) // 480000)) AS k FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars * 700 END AS n FROM documents))")
def sample_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Clips in chunks of 30 s at 16 kHz."""
    clips = V.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("n_chars") * 700).alias("n"))
    return D.sample_chunks(clips, F.col("n"), 16_000, "doc_id")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN turn * 1000 END + 30000 * (turn // 2) AS start_ms, turn * 1000 + 500 + 30000 * (turn // 2) AS end_ms FROM conversations")
def offset_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of chunks with the times of the whole clip."""
    t = F.col("turn").cast("bigint")
    rows = V.table(spark, sf, "conversations").select("conv_id", "turn", F.when(t % 4 != 3, t * 1000).alias("start_ms"), (t * 1000 + 500).alias("end_ms"))
    return D.offset_segments(rows, 30_000 * F.floor(F.col("turn") / 2))


@query(
    """WITH c AS (SELECT DISTINCT conv_id, CASE WHEN hash_free % 2 = 0 THEN 'en' END AS language FROM (SELECT conv_id, length(CAST(conv_id AS VARCHAR)) AS hash_free FROM conversations)),
s AS (SELECT conv_id, turn AS pos, turn * 2000 AS a, turn * 2000 + turn % 3 * 700 AS b, CASE WHEN role = 'user' THEN 'fr' END AS own FROM conversations WHERE turn % 4 < 3 AND turn > 0),
j AS (SELECT c.conv_id, coalesce(pos, 0) AS pos, own, language, pos IS NULL AS whole,
 CASE WHEN pos IS NULL THEN 0 ELSE greatest(0, least(160000, CAST(floor((a - 0) * 16000 / 1000.0) AS BIGINT))) END AS first,
 CASE WHEN pos IS NULL THEN 160000 ELSE greatest(0, least(160000, CAST(ceil((b + 0) * 16000 / 1000.0) AS BIGINT))) END AS last FROM c LEFT JOIN s ON s.conv_id = c.conv_id)
SELECT conv_id, pos, first, last, CAST(floor(1000.0 * first / 16000 + 0.5) AS BIGINT) AS offset_ms, coalesce(own, language) AS language FROM j WHERE whole OR first < last"""
)
def span_slices(spark: SparkSession, sf: str) -> DataFrame:
    """What is recognised of each clip: spans with samples and their own language, or the whole clip."""
    rows = V.table(spark, sf, "conversations")
    clips = rows.select("conv_id").distinct().select("conv_id", F.lit(160_000).alias("n_samples"), F.when(F.length(F.col("conv_id").cast("string")) % 2 == 0, "en").alias("language"))
    t = F.col("turn").cast("bigint")
    spans = rows.where((F.col("turn") % 4 < 3) & (F.col("turn") > 0)).select("conv_id", t.alias("pos"), (t * 2000).alias("start_ms"), (t * 2000 + t % 3 * 700).alias("end_ms"), F.when(F.col("role") == "user", "fr").alias("language"))
    return D.span_slices(clips, spans, 16_000, 0, "conv_id")


@query(
    """WITH RECURSIVE d AS (SELECT p_partkey, [p_partkey % 50] AS toks, 0 AS n FROM part
UNION ALL SELECT p_partkey, list_append(toks, (toks[-1] * 7 + 3) % 50), n + 1 FROM d WHERE n < 12 AND (toks[-1] * 7 + 3) % 50 <> 0)
SELECT p_partkey, toks[2:] AS tokens FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC) = 1"""
)
def greedy_decode(spark: SparkSession, sf: str) -> DataFrame:
    """A token loop with a stub model, an end token and a limit."""
    rows = V.table(spark, sf, "part").select("p_partkey", F.array((F.col("p_partkey") % 50).cast("bigint")).alias("prompt"))
    tokens = D.greedy_decode(lambda so_far: (F.element_at(so_far, -1) * 7 + 3) % 50, F.col("prompt"), 0, 12)
    return rows.select("p_partkey", tokens.alias("tokens"))


@query("SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM (" + "SELECT doc_id, i - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))")
def detokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as byte-level tokens between special ones, and back."""
    rows = V.lines(spark, sf)
    tokens = F.concat(F.array(F.lit("<|startoftranscript|>")), D.byte_tokens(F.col("line")), F.array(F.lit("<|endoftext|>")))
    return rows.select("doc_id", "pos", D.detokenize(tokens, ["<|startoftranscript|>", "<|endoftext|>"]).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 6 <> 0 THEN length(url) END AS value, CASE WHEN page_id % 6 = 0 THEN 'probe-failed' END AS error FROM pages")
def probe_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every source probed on its own; a failing one is an error of its row, named as the domain names it."""

    def probe(uri: str) -> int:
        if uri.startswith("broken:"):
            raise OSError(uri)
        return len(uri)

    rows = V.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("broken:"), "url")).otherwise(F.col("url")).alias("uri"))
    found = D.probe_all(rows, probe, 30.0, "page_id")
    return found.select("page_id", "value", L.remap_error(F.col("error")).alias("error"))
