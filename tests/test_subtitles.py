import pytest

from cueloom.operators.ports import translators
from cueloom.operators.reflow import Rules
from cueloom.plans import pipelines
from cueloom.sources import subtitles as S


def srt(spark, text):
    return [(r.src_index, r.start_ms, r.end_ms, r.lines) for r in S.parse_srt(spark.createDataFrame([(1, text)], "d bigint, text string"), "d").orderBy("block_no").collect()]


def vtt(spark, text):
    return [(r.src_index, r.start_ms, r.end_ms, r.lines) for r in S.parse_vtt(spark.createDataFrame([(1, text)], "d bigint, text string"), "d").orderBy("block_no").collect()]


ONE = "1\n00:00:01,000 --> 00:00:02,000\nhello\nthere"


def test_srt(spark):
    assert srt(spark, "﻿" + ONE.replace("\n", "\r\n") + "\r\n") == [(1, 1000, 2000, ["hello", "there"])]
    assert srt(spark, "x" + ONE[1:]) == [(0, 1000, 2000, ["hello", "there"])]
    assert srt(spark, ONE + "\n\n\n2\n00:00:03,000 --> 00:00:04,000\nlost") == [(1, 1000, 2000, ["hello", "there"])]
    assert srt(spark, ONE.replace("2,000", "2,000 X1:5")) == []
    assert srt(spark, "") == [] and srt(spark, "1") == []


def test_vtt(spark):
    doc = "WEBVTT\n\nNOTE a --> b\n\nSTYLE\nx\n\n00:01.000 --> 00:02.000 align:start\nhi\n\nid\n00:00:03,5 --> 00:00:04.000\nyo"
    assert vtt(spark, doc) == [(0, 1000, 2000, ["hi"]), (0, 3005, 4000, ["yo"])]
    assert vtt(spark, "WEBVTT\n00:01.000 --> 00:02.000\nlost") == []
    assert vtt(spark, "NOTEBOOK\n00:01.000 --> 00:02.000\nkept") == [(0, 1000, 2000, ["kept"])]


def test_render_round_trip(spark):
    cues = spark.createDataFrame([(1, 2, 5000, 6000, ["b"]), (1, 1, 0, 1500, ["a", "c"])], "d bigint, idx bigint, start_ms bigint, end_ms bigint, lines array<string>")
    text = S.render(cues, "srt", "d").first().text
    assert text == "1\n00:00:00,000 --> 00:00:01,500\na\nc\n\n2\n00:00:05,000 --> 00:00:06,000\nb\n"
    assert srt(spark, text) == [(1, 0, 1500, ["a", "c"]), (2, 5000, 6000, ["b"])]
    assert S.render(cues, "vtt", "d").first().text.startswith("WEBVTT\n\n1\n00:00:00.000 --> ")
    with pytest.raises(ValueError, match="unsupported-format"):
        S.codec("ass")
    assert "x" in S.register(S.CODECS, "x", S.parse_srt, S.CODECS["srt"][1]) and "x" not in S.CODECS


def test_read_text(spark, tmp_path):
    (tmp_path / "a.srt").write_text(ONE)
    got = {r.uri: (r.text, r.error) for r in S.read_text(spark, spark.createDataFrame([(str(tmp_path / "a.srt"),), (str(tmp_path / "no.srt"),)], "uri string")).collect()}
    assert got == {str(tmp_path / "a.srt"): (ONE, None), str(tmp_path / "no.srt"): (None, "source-unreadable")}


def test_subtitle_documents(spark):
    docs = spark.createDataFrame([(1, ONE), (2, "nothing"), (3, ONE.replace("hello\nthere", " "))], "d bigint, text string")
    got = {(r.d, r.target_language): (r.text, r.error) for r in pipelines.subtitle_documents(docs, "srt", ["fr", "de"], translators.make("upper"), "d", Rules()).collect()}
    assert got[1, "fr"] == ("1\n00:00:01,000 --> 00:00:02,000\nHELLO\nTHERE\n", None)
    assert got[2, "de"] == (None, "render-failed") and got[3, "de"] == (None, "render-failed") and len(got) == 6
    with pytest.raises(ValueError, match="unsupported-language"):
        pipelines.subtitle_documents(docs, "srt", ["xx"], translators.make("identity"), "d")


def test_media_job(spark):
    assets = spark.createDataFrame([(1, "video", True, "fr"), (2, "video", False, None)], "asset_id bigint, kind string, has_audio boolean, language string")
    hyps = spark.createDataFrame([(1, 0, 0.0, 900.0, "un", None, None), (1, 1, 800.0, 2000.0, "eins", None, "de"), (1, 2, 100.0, 700.0, "[music]", None, None)], "asset_id bigint, pos bigint, start double, end double, text string, confidence double, language string")
    got = {(r.asset_id, r.target_language): (r.text, r.error) for r in pipelines.media_job(assets, hyps, ["en", "fr"], {"de": translators.make("upper")}, translators.make("identity")).collect()}
    assert got[1, "en"] == ("1\n00:00:00,000 --> 00:00:00,900\nun\n\n2\n00:00:00,900 --> 00:00:02,000\nEINS\n", None)
    assert got[1, "fr"] == (None, "translation-failed") and got[2, "en"] == (None, "no-audio-stream")
