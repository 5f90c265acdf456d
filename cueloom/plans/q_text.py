"""Queries: text shaping and reflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asr, reflow
from ..operators.reflow import Rules
from . import views as V
from .views import CUE, LINE, clock_sql, query

_MARK = "CASE pos % 9 WHEN 0 THEN '[' || {0} || ']' WHEN 1 THEN '- (laughs)' WHEN 2 THEN '♪ ' || {0} || ' ♪' WHEN 3 THEN '<i></i>' WHEN 4 THEN '♪ ♫' ELSE {0} END"


def _marked(line: str = "line"):
    p, x = F.col("pos") % 9, F.col(line)
    return F.when(p == 0, F.concat(F.lit("["), x, F.lit("]"))).when(p == 1, F.lit("- (laughs)")).when(p == 2, F.concat(F.lit("♪ "), x, F.lit(" ♪"))).when(p == 3, F.lit("<i></i>")).when(p == 4, F.lit("♪ ♫")).otherwise(x)


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BARE = _STRIP.format("regexp_replace(line, '</?[ibu]>', '', 'g')")


@query(f"""WITH {LINE}, m AS (SELECT doc_id, pos, {_MARK.format('line')} AS line FROM v_line),
b AS (SELECT *, {_BARE} AS bare FROM m), t AS (SELECT doc_id, pos, line, {_STRIP.format("CASE WHEN starts_with(bare, '- ') THEN substr(bare, 3) ELSE bare END")} AS t FROM b)
SELECT doc_id, pos, line FROM t WHERE NOT (t = '' OR (starts_with(t, '(') AND ends_with(t, ')')) OR (starts_with(t, '[') AND ends_with(t, ']')) OR regexp_full_match(t, '(?s)[♪♫〽].*[♪♫〽]') OR regexp_full_match(t, '[♪♫〽\\s]+'))""".replace("\\\\", "\\"))
def drop_nonspeech(spark: SparkSession, sf: str) -> DataFrame:
    marked = V.lines(spark, sf).select("doc_id", "pos", F.array(_marked()).alias("lines"))
    return reflow.drop_nonspeech(marked).select("doc_id", "pos", F.element_at("lines", 1).alias("line"))


@query(rf"""WITH {LINE}, m AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN '[ ' || line || ' MUSIC_playing ]' WHEN 1 THEN '*Silence*' WHEN 2 THEN '(---)' WHEN 3 THEN '[' || line || ']' ELSE line END AS text FROM v_line),
n AS (SELECT *, trim(regexp_replace(lower(regexp_extract(text, '(?s)^\s*[\[(*](.*)[\])*]\s*$', 1)), '[^a-z0-9]+', ' ', 'g')) AS body, regexp_full_match(text, '(?s)\s*[\[(*](.*)[\])*]\s*') AS noted FROM m)
SELECT doc_id, pos, trim(text) = '' OR (noted AND (body = '' OR regexp_matches(body, '\b({"|".join(T.NON_SPEECH)})\b'))) AS non_speech FROM n""")
def nonspeech_text(spark: SparkSession, sf: str) -> DataFrame:
    p, x = F.col("pos") % 5, F.col("line")
    text = F.when(p == 0, F.concat(F.lit("[ "), x, F.lit(" MUSIC_playing ]"))).when(p == 1, F.lit("*Silence*")).when(p == 2, F.lit("(---)")).when(p == 3, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)
    return V.lines(spark, sf).select("doc_id", "pos", T.is_non_speech(text).alias("non_speech"))


@query(r"SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents")
def word_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("words"))


@query(r"SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}'']+') AS words FROM conversations")
def content_words(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select("conv_id", "turn", T.content_words(F.col("text")).alias("words"))


@query(rf"""WITH {LINE} SELECT doc_id, pos, CASE WHEN length(line) <= 42 THEN [line] ELSE list_reduce(list_transform(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> ''), lambda w: [w]),
lambda acc, w: CASE WHEN length(acc[-1]) + 1 + length(w[1]) <= 42 THEN list_concat(acc[:-2], [acc[-1] || ' ' || w[1]]) ELSE list_concat(acc, w) END) END AS wrapped FROM v_line""")
def wrap_line(spark: SparkSession, sf: str) -> DataFrame:
    return V.lines(spark, sf).select("doc_id", "pos", T.wrap_line(F.col("line"), 42).alias("wrapped"))


@query()
def wrap_lines(spark: SparkSession, sf: str) -> DataFrame:
    return V.lines(spark, sf).select("doc_id", "pos", T.wrap_lines(F.array("line"), 12).alias("wrapped"))


@query()
def balanced_chunks(spark: SparkSession, sf: str) -> DataFrame:
    n = (1 + F.col("pos") % 5).cast("bigint")
    return V.lines(spark, sf).select("doc_id", "pos", T.balanced_chunks(n, T.words(F.col("line"))).alias("groups"))


@query()
def split_cps(spark: SparkSession, sf: str) -> DataFrame:
    cues = V.cues(spark, sf).withColumn("end_ms", F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) / 2).withColumn("end_ms", F.col("end_ms").cast("bigint"))
    return reflow.split_cues(cues, 17.0, 42, 2).select("doc_id", "pos", "part", "start_ms", "end_ms", "lines")


@query()
def pad_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    talk = V.table(spark, sf, "conversations").where("conv_id IS NOT NULL")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = talk.select("conv_id", "turn", F.lag("text").over(w).alias("before"), "text").where("before IS NOT NULL")
    return asr.pad_duplicates(pairs, "before", "text").select("conv_id", "turn", "run", "duplicate")


def reflow_sql(cap: int, least: int, gap: int, tail: str) -> str:
    """Merge, cap, extend, gap and re-index in SQL, over v_cue."""
    order = "(PARTITION BY doc_id ORDER BY start_ms, end_ms, pos)"
    return f"""o AS (SELECT *, max(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_cue),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, pos ROWS UNBOUNDED PRECEDING) AS island FROM o),
mg AS (SELECT doc_id, min(pos) AS pos, min(start_ms) AS start_ms, max(end_ms) AS end_ms, flatten(list(lines ORDER BY start_ms, end_ms, pos)) AS lines FROM isl GROUP BY doc_id, island),
cp AS (SELECT doc_id, pos, start_ms, least(end_ms, start_ms + {cap}) AS end_ms, lines FROM mg),
ex AS (SELECT doc_id, pos, start_ms, least(greatest(end_ms, start_ms + {least}), greatest(start_ms, coalesce(lead(start_ms) OVER {order} - {gap}, 9223372036854775807))) AS end_ms, lines FROM cp),
gp AS (SELECT doc_id, pos, start_ms, CASE WHEN lead(start_ms) OVER {order} - {gap} < end_ms THEN greatest(start_ms, lead(start_ms) OVER {order} - {gap}) ELSE end_ms END AS end_ms, lines FROM ex),
rf AS (SELECT doc_id, row_number() OVER {order} AS idx, start_ms, end_ms, lines FROM gp) {tail}"""


@query(f"WITH {CUE}, {reflow_sql(7000, 1000, 80, 'SELECT doc_id, idx, start_ms, end_ms, lines FROM rf')}")
def reflow_basic(spark: SparkSession, sf: str) -> DataFrame:
    return reflow.reflow(V.cues(spark, sf), Rules(max_dur_ms=7000, min_dur_ms=1000, min_gap_ms=80), "doc_id").select("doc_id", "idx", "start_ms", "end_ms", "lines")


@query()
def reflow_full(spark: SparkSession, sf: str) -> DataFrame:
    rules = Rules(drop_music=True, max_dur_ms=7000, min_dur_ms=1000, min_gap_ms=80, max_chars_line=42, max_lines=2, max_cps=17.0, snap=40)
    return reflow.reflow(V.cues(spark, sf), rules, "doc_id").select("doc_id", "idx", "start_ms", "end_ms", "lines")


@query(f"""WITH {CUE}, {reflow_sql(7000, 1000, 80, ', ')} x AS (SELECT * FROM rf), bad AS (SELECT doc_id FROM x GROUP BY doc_id HAVING bool_or(NOT list_bool_or(list_transform(lines, lambda l: trim(l) <> ''))))
SELECT doc_id, 'en' AS target_language, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN NULL ELSE string_agg(idx || chr(10) || {clock_sql('start_ms')} || ' --> ' || {clock_sql('end_ms')} || chr(10) || regexp_replace(array_to_string(lines, chr(10)), '\n+$', ''), chr(10) || chr(10) ORDER BY idx) || chr(10) END AS text,
CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN 'render-failed' END AS error FROM x GROUP BY doc_id""")
def ingress_subtitle(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ports import translators
    from .pipelines import subtitle_job

    return subtitle_job(V.cues(spark, sf), ["en"], translators.make("identity"), "doc_id", Rules(max_dur_ms=7000, min_dur_ms=1000, min_gap_ms=80))
