"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import find_contamination
from .html_extraction import extract_pages
from .language_id import identify_language
from .line_dedup import line_components
from .near_duplicates import near_duplicates
from .packing import pack_documents
from .quality_classifier import classify_quality
from .quality_rules import apply_quality_rules
from .quotation import link_quotations
from .toxicity import classify_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 2-word shingles are similar at 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order, without their quotes."""
    return link_quotations(table(spark, sf_dir, "conversations"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with the line that its component keeps."""
    return line_components(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces, with a checksum in place of their ids."""
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words and the items that hit it."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_near_duplicates, op3_quotation_linking, op4_line_dedup, op5_quality_classifier, op6_quality_rules, op7_language_id, op8_html_extraction, op9_packing, op10_decontamination)
}
ORACLE_SQL: dict[str, str] = {}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op10_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORDS}'), []) AS w FROM documents
), i AS (
  SELECT item_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORDS}'), []) AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw
), dw AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT DISTINCT dw.r, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)
), words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLE_SQL["op3_quotation_linking"] = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations
), l AS (
  SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(x, '^[ \t]*(?:>[ \t]?)+', '') AS body
  FROM (SELECT r, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM m)
), b AS (SELECT *, trim(regexp_replace(body, '[\t\r]', ' ', 'g')) = '' AS blank FROM l
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN lag(level) OVER w = level AND lag(blank) OVER w = blank THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY r ORDER BY i))
), p AS (
  SELECT r, conv_id, turn, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM s WHERE NOT blank GROUP BY ALL
), u AS (
  SELECT DISTINCT r, conv_id, turn, run, level, trim(regexp_replace(lower(x), '[ \t\r\n]+', ' ', 'g')) AS unit
  FROM (SELECT *, unnest(list_concat([body], string_split(body, chr(10)))) AS x FROM p) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), o AS (SELECT conv_id, unit, min(turn) AS source FROM u WHERE level = 0 AND unit <> '' GROUP BY ALL
), k AS (
  SELECT conv_id, turn, source AS reply_to FROM u JOIN o USING (conv_id, unit) WHERE level > 0 AND source < turn
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, length(unit) DESC, source DESC) = 1
), t AS (
  SELECT conv_id, turn, reply_to, reply_to AS thread_turn, 1 AS depth FROM k
  UNION ALL SELECT t.conv_id, t.turn, t.reply_to, k.reply_to, t.depth + 1 FROM t JOIN k ON k.conv_id = t.conv_id AND k.turn = t.thread_turn
), e AS (SELECT conv_id, turn, reply_to, min(thread_turn) AS thread_turn, max(depth) AS depth FROM t GROUP BY ALL
), own AS (SELECT r, string_agg(body, chr(10) ORDER BY i) AS body FROM l WHERE level = 0 GROUP BY r
), q AS (SELECT r, count(*) FILTER (level > 0) AS n FROM p GROUP BY r
), top AS (SELECT r, max(level) AS n FROM l GROUP BY r
)
SELECT m.conv_id, coalesce(e.thread_turn, m.turn) AS thread_turn, CAST(coalesce(e.depth, 0) AS BIGINT) AS depth, m.turn, e.reply_to, m.role,
  CASE WHEN m.text IS NOT NULL THEN regexp_replace(coalesce(own.body, ''), '\A[ \t\r\n]+|[ \t\r\n]+\z', '', 'g') END AS text,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_quotes, CAST(coalesce(top.n, 0) AS BIGINT) AS max_level
FROM m LEFT JOIN e USING (conv_id, turn) LEFT JOIN own USING (r) LEFT JOIN q USING (r) LEFT JOIN top USING (r)
"""
