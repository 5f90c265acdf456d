"""Canonical timed-text inputs, derived alike in Spark and in SQL from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL where there is one."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("bigint")


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hypotheses of one asset a user."""
    start = epoch_ms("ts")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("pos"), start.alias("start_ms"), (start + F.floor(F.col("value") * 100000).cast("bigint")).alias("end_ms"), F.col("event_type").alias("text"))


RAW = "v_raw AS (SELECT user_id AS asset_id, event_id AS pos, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 100000) AS BIGINT) AS end_ms, event_type AS text FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", "lang", F.col("p").cast("bigint").alias("pos"), "line")


LINE = "v_line AS (SELECT doc_id, lang, i - 1 AS pos, line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cue a line of a document, two seconds apart, as long as its text."""
    start = F.col("pos") * 2000
    return lines(spark, sf_dir).select("doc_id", "pos", start.alias("start_ms"), (start + 40 * F.length("line")).alias("end_ms"), F.array("line").alias("lines"))


CUE = LINE + ", v_cue AS (SELECT doc_id, pos, pos * 2000 AS start_ms, pos * 2000 + 40 * length(line) AS end_ms, [line] AS lines FROM v_line)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues' times without overlap: each ends at the latest when the next begins."""
    return cues(spark, sf_dir).select("doc_id", "pos", "start_ms", F.least(F.col("end_ms"), F.col("start_ms") + 2000 - F.col("pos") % 3 * 40).alias("end_ms"))


SPAN = CUE + ", v_span AS (SELECT doc_id, pos, start_ms, least(end_ms, start_ms + 2000 - pos % 3 * 40) AS end_ms FROM v_cue)"


def clock_sql(ms: str, sep: str = ",") -> str:
    return f"printf('%02d:%02d:%02d{sep}%03d', ({ms}) // 3600000, ({ms}) % 3600000 // 60000, ({ms}) % 60000 // 1000, ({ms}) % 1000)"


def millis_sql(s: str) -> str:
    """The clock in a trimmed string, or null."""
    part = lambda k: f"coalesce(try_cast(nullif(regexp_extract({s}, '^(?:(\\d{{1,2}}):)?(\\d{{1,2}}):(\\d{{2}})[,.](\\d{{1,3}})$', {k}), '') AS BIGINT), 0)"
    return f"CASE WHEN regexp_full_match({s}, '(?:\\d{{1,2}}:)?\\d{{1,2}}:\\d{{2}}[,.]\\d{{1,3}}') THEN {part(1)} * 3600000 + {part(2)} * 60000 + {part(3)} * 1000 + {part(4)} END"
