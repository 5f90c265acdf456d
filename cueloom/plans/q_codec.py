"""Queries: clocks, codecs and interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timecode as C
from ..operators import asr
from ..operators import intervals as I
from ..sources import subtitles
from . import views as V
from .views import CUE, RAW, SPAN, clock_sql, millis_sql, query


@query(f"SELECT o_orderkey, {clock_sql('o_orderkey * 977')} AS srt, {clock_sql('o_orderkey * 977', '.')} AS vtt FROM orders")
def timecode_format(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.col("o_orderkey") * 977
    return V.table(spark, sf, "orders").select("o_orderkey", C.ms_to_clock(ms).alias("srt"), C.ms_to_clock(ms, ".").alias("vtt"))


_CLOCKS = "CASE k % 5 WHEN 0 THEN printf('%d:%02d:%02d,%03d', k % 100, k % 60, k % 60, k % 1000) WHEN 1 THEN printf(' %d:%02d.%d ', k % 60, k % 60, k % 10) WHEN 2 THEN printf('%d:%d,5', k % 60, k % 60) WHEN 3 THEN printf('%03d:00:00,000', k % 200) ELSE 'garbage' END"


@query(f"SELECT k, {millis_sql('trim(s)')} AS ms FROM (SELECT o_orderkey AS k, {_CLOCKS.replace('k %', 'o_orderkey %')} AS s FROM orders)")
def timecode_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = (
        F.when(k % 5 == 0, F.format_string("%d:%02d:%02d,%03d", k % 100, k % 60, k % 60, k % 1000))
        .when(k % 5 == 1, F.format_string(" %d:%02d.%d ", k % 60, k % 60, k % 10))
        .when(k % 5 == 2, F.format_string("%d:%d,5", k % 60, k % 60))
        .when(k % 5 == 3, F.format_string("%03d:00:00,000", k % 200))
        .otherwise("garbage")
    )
    return V.table(spark, sf, "orders").select(k.alias("k"), C.clock_to_ms(s).alias("ms"))


@query("SELECT l_orderkey AS k, CASE WHEN us < 0 THEN 0 ELSE CAST(floor(us / 1000.0 + 0.5) AS BIGINT) END AS ms, greatest(0, CAST(floor(sec * 1000.0 + 0.5) AS BIGINT)) AS from_s, CAST(floor(us * 1000.0 / 16000 + 0.5) AS BIGINT) AS from_samples FROM (SELECT l_orderkey, (l_partkey * 37 - 5000) AS us, l_extendedprice / 100 - 20 AS sec FROM lineitem)")
def unit_conversions(spark: SparkSession, sf: str) -> DataFrame:
    us, sec = F.col("l_partkey") * 37 - 5000, F.col("l_extendedprice") / 100 - 20
    return V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), C.us_to_ms(us).alias("ms"), C.to_ms(sec, "s").alias("from_s"), C.samples_to_ms(us, 16000).alias("from_samples"))


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    return I.reindex(V.cues(spark, sf), "doc_id")


def _render_sql(sep: str, head: str, cue: str = "v_cue") -> str:
    block = f"printf('%d', idx) || chr(10) || {clock_sql('start_ms', sep)} || ' --> ' || {clock_sql('end_ms', sep)} || chr(10) || array_to_string(lines, chr(10))"
    return f"i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, pos) AS idx FROM {cue}), doc AS (SELECT doc_id, {head} || string_agg({block}, chr(10) || chr(10) ORDER BY idx) || chr(10) AS text FROM i GROUP BY doc_id)"


_SRT, _VTT = _render_sql(",", "''"), _render_sql(".", "'WEBVTT' || chr(10) || chr(10)")


@query(f"WITH {CUE}, {_SRT} SELECT * FROM doc")
def srt_render(spark: SparkSession, sf: str) -> DataFrame:
    return subtitles.render(_indexed(spark, sf), "srt", "doc_id")


@query(f"WITH {CUE}, {_VTT} SELECT * FROM doc")
def vtt_render(spark: SparkSession, sf: str) -> DataFrame:
    return subtitles.render(_indexed(spark, sf), "vtt", "doc_id")


_BLOCKS = r"""b AS (SELECT doc_id, k, string_split(regexp_replace(block, '\n+$', ''), chr(10)) AS l FROM (
  SELECT doc_id, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS k FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(65279), ''), '^\s+|\s+$', '', 'g'), '\n[ \t]*\n') AS bs FROM doc)) WHERE keep_block)"""


def _parse_sql(at: str, index: str, end: str, keep: str) -> str:
    return (
        _BLOCKS.replace("keep_block", keep)
        + f", t AS (SELECT *, {at} AS tl FROM b), s AS (SELECT doc_id, k, l, tl, trim(split_part(l[tl], '-->', 1)) AS s1, {end} AS s2, {index} AS src FROM t WHERE tl > 0), "
        + f"p AS (SELECT doc_id, CAST(k AS INTEGER) AS block_no, coalesce(try_cast(CASE WHEN regexp_full_match(src, '[+-]?\\d{{1,18}}') THEN src END AS BIGINT), 0) AS src_index, {millis_sql('s1')} AS start_ms, {millis_sql('s2')} AS end_ms, l[tl + 1 :] AS lines FROM s) SELECT * FROM p WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL"
    )


@query(f"WITH {CUE}, {_SRT}, " + _parse_sql("CASE WHEN len(l) >= 2 THEN 2 ELSE 0 END", "trim(l[1])", "trim(split_part(l[tl], '-->', 2))", "true"))
def srt_parse(spark: SparkSession, sf: str) -> DataFrame:
    return subtitles.parse_srt(subtitles.render(_indexed(spark, sf), "srt", "doc_id"), "doc_id")


@query(f"WITH {CUE}, {_VTT}, " + _parse_sql("coalesce(list_position(list_transform(l, lambda x: contains(x, '-->')), true), 0)", "CASE WHEN tl > 1 THEN trim(l[tl - 1]) END", r"regexp_split_to_array(trim(split_part(l[tl], '-->', 2)), '\s+')[1]", "NOT starts_with(block, 'WEBVTT') AND NOT regexp_matches(block, '^(NOTE|STYLE|REGION)\\b')"))
def vtt_parse(spark: SparkSession, sf: str) -> DataFrame:
    return subtitles.parse_vtt(subtitles.render(_indexed(spark, sf), "vtt", "doc_id"), "doc_id")


@query(f"WITH {CUE}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, pos) AS idx FROM v_cue) SELECT doc_id, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM i WHERE array_to_string(lines, '') <> '' GROUP BY doc_id")
def srt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered, parsed again, counted: what was written comes back."""
    filled = _indexed(spark, sf).where(F.array_join("lines", "") != "")
    back = subtitles.parse_srt(subtitles.render(filled, "srt", "doc_id"), "doc_id")
    return back.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


@query("SELECT o_orderkey, s AS start_ms, least(s + win, dur) AS end_ms FROM (SELECT o_orderkey, dur, win, unnest(range(0, dur, win)) AS s FROM (SELECT o_orderkey, o_orderkey % 7919 AS dur, 1 + o_custkey % 997 AS win FROM orders) WHERE dur > 0)")
def grid_spans(spark: SparkSession, sf: str) -> DataFrame:
    base = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7919).alias("dur"), (1 + F.col("o_custkey") % 997).alias("win"))
    return I.grid_spans(base, F.col("dur"), F.col("win")).select("o_orderkey", "start_ms", "end_ms")


@query(f"WITH {CUE} SELECT doc_id, pos, s AS start_ms, least(s + 5000, greatest(end_ms, s)) AS end_ms FROM (SELECT *, unnest(range(start_ms, greatest(start_ms, end_ms - 1) + 1, 5000)) AS s FROM v_cue)")
def cap_spans(spark: SparkSession, sf: str) -> DataFrame:
    return I.cap_spans(V.cues(spark, sf).drop("lines"), 5000).select("doc_id", "pos", "start_ms", "end_ms")


_ISLANDS = "o AS (SELECT *, max(end_ms) OVER (PARTITION BY {k} ORDER BY start_ms, end_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}), isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY start_ms, end_ms, pos ROWS UNBOUNDED PRECEDING) AS island FROM o)"


@query(f"WITH {RAW}, {_ISLANDS.format(k='asset_id', t='v_raw')} SELECT asset_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(pos) AS pos, string_agg(text, '|' ORDER BY start_ms, end_ms, pos) AS text FROM isl GROUP BY asset_id, island")
def overlap_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = I.merge_overlaps(V.raw_segments(spark, sf).withColumn("lines", F.array("text")), "asset_id")
    return merged.select("asset_id", "start_ms", "end_ms", "pos", F.array_join("lines", "|").alias("text"))


_SHEAR = "m AS (SELECT *, max(greatest(start_ms, end_ms)) OVER (PARTITION BY asset_id ORDER BY start_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t})"


@query(f"WITH {RAW}, {_SHEAR.format(t='v_raw')} SELECT asset_id, pos, greatest(start_ms, coalesce(reach, start_ms)) AS start_ms, greatest(start_ms, coalesce(reach, start_ms), end_ms) AS end_ms FROM m")
def segment_shear(spark: SparkSession, sf: str) -> DataFrame:
    return I.segment_shear(V.raw_segments(spark, sf), "asset_id").select("asset_id", "pos", "start_ms", "end_ms")


@query(f"WITH {RAW}, v AS (SELECT * FROM (SELECT * REPLACE (CASE pos % 5 WHEN 0 THEN '[ ' || text || ' music ]' WHEN 1 THEN '  ' ELSE text END AS text, greatest(start_ms, end_ms) AS end_ms) FROM v_raw) WHERE trim(text) <> '' AND NOT starts_with(text, '[ ')), {_SHEAR.format(t='v')} SELECT asset_id, pos, greatest(start_ms, coalesce(reach, start_ms)) AS start_ms, greatest(start_ms, coalesce(reach, start_ms), end_ms) AS end_ms, text FROM m")
def normalize_segments(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("[ "), "text", F.lit(" music ]"))).when(F.col("pos") % 5 == 1, F.lit("  ")).otherwise(F.col("text"))
    raw = V.raw_segments(spark, sf).select("asset_id", "pos", F.col("start_ms").cast("double").alias("start"), F.col("end_ms").cast("double").alias("end"), text.alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("language"))
    return asr.normalize_segments(raw, "asset_id").select("asset_id", "pos", "start_ms", "end_ms", "text")


_LEAD = "w AS (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, pos) AS nxt FROM v_cue)"


@query(f"WITH {CUE} SELECT doc_id, pos, start_ms, least(end_ms, start_ms + 1500) AS end_ms FROM v_cue")
def cap_duration(spark: SparkSession, sf: str) -> DataFrame:
    return I.cap_duration(V.cues(spark, sf).drop("lines"), 1500)


@query(f"WITH {CUE}, {_LEAD} SELECT doc_id, pos, start_ms, least(greatest(end_ms, start_ms + 1800), greatest(start_ms, coalesce(nxt - 300, 9223372036854775807))) AS end_ms FROM w")
def extend_duration(spark: SparkSession, sf: str) -> DataFrame:
    return I.extend_duration(V.cues(spark, sf), 1800, 300, "doc_id").select("doc_id", "pos", "start_ms", "end_ms")


@query(f"WITH {CUE}, {_LEAD} SELECT doc_id, pos, start_ms, CASE WHEN nxt - 120 < end_ms THEN greatest(start_ms, nxt - 120) ELSE end_ms END AS end_ms FROM w")
def enforce_gap(spark: SparkSession, sf: str) -> DataFrame:
    return I.enforce_gap(V.cues(spark, sf), 120, "doc_id").select("doc_id", "pos", "start_ms", "end_ms")


@query(f"WITH {CUE}, s AS (SELECT doc_id, pos, 250 * CAST(floor(start_ms / 250.0 + 0.5) AS BIGINT) AS a, 250 * CAST(floor(end_ms / 250.0 + 0.5) AS BIGINT) AS b FROM v_cue) SELECT doc_id, pos, a AS start_ms, CASE WHEN b > a THEN b ELSE a + 250 END AS end_ms FROM s")
def snap_grid(spark: SparkSession, sf: str) -> DataFrame:
    return I.snap_grid(V.cues(spark, sf).drop("lines"), 250)


@query(f"WITH {RAW} SELECT asset_id, pos, row_number() OVER (PARTITION BY asset_id ORDER BY start_ms, end_ms, pos) AS idx, row_number() OVER (PARTITION BY asset_id ORDER BY pos) AS input_idx FROM v_raw")
def reindex(spark: SparkSession, sf: str) -> DataFrame:
    first = I.input_index(V.raw_segments(spark, sf), "asset_id").withColumnRenamed("idx", "input_idx")
    return I.reindex(first, "asset_id").select("asset_id", "pos", "idx", "input_idx")


@query(f"""WITH {SPAN}, w AS (SELECT *, lead(start_ms) OVER d - end_ms AS aft, start_ms - lag(end_ms) OVER d AS bef FROM v_span WINDOW d AS (PARTITION BY doc_id ORDER BY start_ms, end_ms, pos))
SELECT doc_id, pos, greatest(0, CASE WHEN bef < 200 THEN start_ms - CAST(trunc(bef / 2) AS BIGINT) ELSE start_ms - 100 END) AS start_ms, CASE WHEN aft < 200 THEN end_ms + CAST(trunc(aft / 2) AS BIGINT) ELSE least(60000, end_ms + 100) END AS end_ms FROM w""")
def vad_pad(spark: SparkSession, sf: str) -> DataFrame:
    return I.pad_spans(V.spans(spark, sf), 100, F.lit(60000).cast("bigint"), "doc_id").select("doc_id", "pos", "start_ms", "end_ms")


@query(f"""WITH {CUE}, pt AS (SELECT doc_id, pos * 2000 + (pos * 7919) % 2000 AS t_ms FROM v_line),
m AS (SELECT pt.doc_id, pt.t_ms, c.pos, c.start_ms, c.end_ms, c.lines FROM pt JOIN v_cue c ON c.doc_id = pt.doc_id AND c.start_ms <= t_ms AND t_ms < c.end_ms QUALIFY row_number() OVER (PARTITION BY pt.doc_id, t_ms ORDER BY c.start_ms, c.pos) = 1) SELECT * FROM m""")
def active_lines_join(spark: SparkSession, sf: str) -> DataFrame:
    points = V.lines(spark, sf).select("doc_id", (F.col("pos") * 2000 + F.col("pos") * 7919 % 2000).alias("t_ms"))
    return I.active_cues(points, V.cues(spark, sf), "doc_id")


@query(f"""WITH {RAW}, p AS (SELECT asset_id, max(pts) OVER (PARTITION BY asset_id ORDER BY pos) AS t, 1 AS kind, pos AS seq FROM (SELECT asset_id, pos, start_ms - pos % 7 * 100000 AS pts FROM v_raw)),
c AS (SELECT asset_id, start_ms AS t, 0 AS kind, pos AS seq FROM v_raw), u AS (SELECT * FROM p UNION ALL SELECT * FROM c)
SELECT asset_id, t AS "at", kind, seq, row_number() OVER (PARTITION BY asset_id ORDER BY t, kind, seq) AS ord FROM u""")
def mux_interleave(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.raw_segments(spark, sf)
    packets = raw.select("asset_id", F.col("pos").alias("seq"), (F.col("start_ms") - F.col("pos") % 7 * 100000).alias("pts"))
    return I.interleave(packets, raw, "asset_id")
