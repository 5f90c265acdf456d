import random

from pyspark.sql import functions as F

from cueloom.functions import media as M
from cueloom.functions import text as T
from cueloom.functions import timecode as C
from cueloom.functions import validation as V


def values(spark, rows, schema, **cols):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in cols.items()]).collect()]


def test_clock_round_trip_and_quirks(spark):
    cases = {"00:00:00,000": 0, " 1:02:03.5 ": 3_723_005, "0:01,5": 1005, "10:00:00.250": 36_000_250, "100:00:00,000": None, "garbage": None, "": None, "00:01,5\n": 1005, "0:1:5,0": None}
    got = values(spark, [(k,) for k in cases], "s string", s=F.col("s"), ms=C.clock_to_ms(F.col("s")))
    assert {r["s"]: r["ms"] for r in got} == cases
    assert values(spark, [(360_000_000,)], "ms bigint", a=C.ms_to_clock(F.col("ms")))[0]["a"] == "100:00:00,000"


def test_units(spark):
    got = values(spark, [(-5,), (499,), (500,), (1500,), (121_858_000,)], "us bigint", ms=C.us_to_ms(F.col("us")))
    assert [r["ms"] for r in got] == [0, 0, 1, 2, 121_858]


def wrap(words, width):
    out, cur = [], ""
    todo = list(words)
    while todo:
        w = todo.pop(0)
        if len(cur) + (1 if cur else 0) + len(w) <= width:
            cur = f"{cur} {w}" if cur else w
        elif cur:
            out.append(cur)
            cur = ""
            todo.insert(0, w)
        else:
            out.append(w[:width])
            todo.insert(0, w[width:])
    return [*out, cur] if cur else out


def chunk(n, words):
    total = sum(map(len, words))
    if n <= 1 or len(words) < 2 or not total:
        return [words]
    groups, cur, size = [], [], 0
    for w in words:
        cur = [*cur, w]
        size += len(w)
        if size * n >= total and len(groups) + 1 < n:
            groups.append(cur)
            cur, size = [], 0
    return [*groups, cur] if cur else groups


def test_wrapping_and_chunks_match_plain_python(spark):
    rng = random.Random(5)
    rows = [(" ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(0, 25))), rng.randint(1, 6)) for _ in range(150)]
    got = values(spark, rows, "t string, n bigint", t=F.col("t"), n=F.col("n"), lines=T.wrap_lines(F.array("t"), 7), groups=T.balanced_chunks(F.col("n"), T.words(F.col("t"))))
    for r in got:
        words = r["t"].split()
        assert r["lines"] == (wrap(words, 7) if words else [r["t"]])
        assert r["groups"] == chunk(r["n"], words)


def test_wrap_line_leaves_what_fits(spark):
    got = values(spark, [("  a b ",), ("aaaaaaaaaaaa b c",)], "t string", x=T.wrap_line(F.col("t"), 8), y=T.wrap_line(F.col("t"), None))
    assert [r["x"] for r in got] == [["  a b "], ["aaaaaaaaaaaa", "b c"]]
    assert got[1]["y"] == ["aaaaaaaaaaaa b c"]


def test_non_speech(spark):
    cases = {"[BLANK_AUDIO]": True, "(upbeat music)": True, "*laughs*": True, "[ Silence ]": True, "[en segment 1]": False, "hello": False, " ": True, "[---]": True, "(musical)": False}
    got = values(spark, [(k,) for k in cases], "t string", t=F.col("t"), x=T.is_non_speech(F.col("t")))
    assert {r["t"]: r["x"] for r in got} == cases
    lines = {"♪ la la ♪": True, "- [door]": True, "<i>(sigh)</i>": True, "♪ ♫": True, "": True, "- hello": False, "(a) b": False}
    got = values(spark, [(k,) for k in lines], "t string", t=F.col("t"), x=T.is_marker_line(F.col("t")))
    assert {r["t"]: r["x"] for r in got} == lines


def test_media(spark):
    uris = {"a/b.SRT": ("srt", "subtitle"), "https://h.tv/watch?v=x.srt": (None, "video"), "dir.srt/x": (None, "video"), "x.vtt#f": ("vtt", "subtitle")}
    got = values(spark, [(k,) for k in uris], "u string", u=F.col("u"), e=M.source_extension(F.col("u")), k=M.infer_kind(F.col("u")))
    assert {r["u"]: (r["e"], r["k"]) for r in got} == uris
    w, h = M.target_dimensions(F.col("w"), F.col("h"), F.lit("720p"))
    row = values(spark, [(1920, 1080)], "w bigint, h bigint", w=w, h=h, r=M.video_bitrate(F.lit(8_000_000).cast("bigint"), F.col("w"), F.col("h"), w, h, F.lit(25.0)))[0]
    assert row == {"w": 1280, "h": 720, "r": 3_555_555}
    got = values(spark, [("#ff0080",), ("0f8",), ("oops",), (None,)], "c string", x=M.hex_rgb(F.col("c")))
    assert [r["x"] for r in got] == [[255, 0, 128], [0, 255, 136], [255] * 3, [255] * 3]
    row = values(spark, [("out/v1.2/f.tar.mp4", ".hidden")], "u string, v string", a=M.sibling_output(F.col("u"), ".x"), b=M.language_variant(F.col("u"), F.lit("fr")), c=M.sibling_output(F.col("v"), ".x"))[0]
    assert row == {"a": "out/v1.2/f.tar.x", "b": "out/v1.2/f.tar.fr.mp4", "c": ".hidden.x"}


def test_validation(spark):
    rows = [(0, 10, 0.5, None, 1, "x"), (-1, 10, 0.5, None, 1, "x"), (5, 1, 0.5, None, 1, "x"), (0, 1, 1.5, None, 1, "x"), (0, 1, 0.5, "xx", 1, "x"), (0, 1, 0.5, "en", 0, "x"), (0, 1, 0.5, "en", 1, " ")]
    got = values(spark, rows, "s bigint, e bigint, c double, l string, i bigint, t string", x=V.segment_error(*map(F.col, "secl"), F.col("i"), F.col("t")))
    assert [r["x"] for r in got] == [None, "invalid-timecode", "inverted-time-range", "invalid-confidence", "unsupported-language", "asr-failed", "asr-failed"]
    got = values(spark, [("en", ["fr", " fr", "", None, "de"]), (" en ", None), ("en", [])], "a string, b array<string>", x=V.normalize_targets(F.col("a"), F.col("b")))
    assert [r["x"] for r in got] == [["fr", "de"], ["en"], ["en"]]
