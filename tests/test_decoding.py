"""Errors and edges of what speech models give."""

import time

from pyspark.sql import functions as F

from cueloom.functions import language as L
from cueloom.operators import decoding as D


def test_bytes_of_any_text_come_back(spark):
    texts = ["plain", "ß é ☃ 漢字 🙂", " \t\n ", "", "a  b", None, "\x00\x7f\xad"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.t for r in df.select("k", D.detokenize(D.byte_tokens(F.col("t")), []).alias("t")).orderBy("k").collect()]
    assert got == ["plain", "ß é ☃ 漢字 🙂", "", "", "a  b", None, "\x00\x7f\xad"]
    cut = spark.range(1).select(D.detokenize(F.array(F.lit("Ã"), F.lit("a")), []).alias("t")).first().t
    assert cut == "�a"


def test_probe_times_out_by_itself(spark):
    def probe(uri):
        if uri == "slow":
            time.sleep(2)
        if uri == "bad":
            raise OSError(uri)
        return len(uri)

    df = spark.createDataFrame([(k, u) for k, u in enumerate(["one", "slow", "bad", "three"])], "k int, uri string").coalesce(1)
    got = D.probe_all(df, probe, 0.5, "k").withColumn("code", L.remap_error(F.col("error"))).collect()
    assert [(r.k, r.value, r.error, r.code) for r in got] == [(0, 3, None, None), (1, None, "collect/probe-timeout", "probe-failed"), (2, None, "collect/probe-failed", "probe-failed"), (3, 5, None, None)]


def test_responses(spark):
    bodies = [(200, '{"text": "all"}'), (200, "[1]"), (200, None), (500, '{"text": "x"}'), (None, '{"text": "x"}'), (204, '{"segments": [], "text": "t"}'), (200, '{"segments": [{"start": 1, "end": 2.5, "text": "a"}]}')]
    df = spark.createDataFrame([(k, *b) for k, b in enumerate(bodies)], "k int, status int, body string")
    got = D.response_segments(df, F.col("status"), F.col("body"), F.lit(None).cast("int"), "k").orderBy("k").collect()
    assert [(r.k, r.start, r.end, r.text, r.error) for r in got] == [(0, 0.0, 0.0, "all", None), *((k, None, None, None, "asr-failed") for k in (1, 2, 3, 4)), (5, 0.0, 0.0, "t", None), (6, 1.0, 2.5, "a", None)]


def test_chunks_and_loops(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 480_000), (3, 480_001)], "k int, n int")
    got = [(r.k, r.chunk, r.offset, r.size) for r in D.sample_chunks(df, F.col("n"), 16_000, "k").orderBy("k", "chunk").collect()]
    assert got == [(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 480_000), (3, 0, 0, 480_000), (3, 1, 480_000, 1)]
    loop = spark.range(1).select(D.greedy_decode(lambda a: F.element_at(a, -1) + 1, F.array(F.lit(1), F.lit(2)), 9, 4).alias("t"), D.greedy_decode(lambda a: F.element_at(a, -1) + 1, F.array(F.lit(7)), 9, 4).alias("u")).first()
    assert loop.t == [3, 4, 5, 6] and loop.u == [8]


def test_unmapped_languages_have_no_name(spark):
    df = spark.createDataFrame([("en-US",), (" YUE ",), ("he",), ("",), (None,)], "tag string")
    assert [r.n for r in df.select(L.language_name(F.col("tag")).alias("n")).collect()] == ["English", "Cantonese", None, None, None]
