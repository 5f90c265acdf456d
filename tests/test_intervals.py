import random

from pyspark.sql import functions as F

from cueloom.operators import intervals as I
from cueloom.operators.reflow import Rules, reflow

CUES = "d bigint, pos bigint, start_ms bigint, end_ms bigint, lines array<string>"


def cues(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], CUES)


def times(df):
    return [(r.start_ms, r.end_ms) for r in df.orderBy("idx").collect()]


def test_timing_rules(spark):
    df = cues(spark, [(0, 990, ["a"]), (1000, 5000, ["b"])])
    assert times(reflow(df, Rules(max_dur_ms=2000, min_gap_ms=120), "d")) == [(0, 880), (1000, 3000)]


def test_split_is_proportional_and_covers(spark):
    df = cues(spark, [(0, 1000, ["aaaa bbbb cccc dddd eeee ffff"])])
    got = reflow(df, Rules(max_cps=10), "d").orderBy("idx").collect()
    assert got[0].start_ms == 0 and got[-1].end_ms == 1000
    assert all(a.end_ms == b.start_ms and a.end_ms > a.start_ms for a, b in zip(got, got[1:], strict=False))
    assert " ".join(" ".join(r.lines) for r in got) == "aaaa bbbb cccc dddd eeee ffff"


def test_music_goes_only_when_asked(spark):
    df = cues(spark, [(0, 1000, ["♪ la ♪"]), (2000, 3000, ["hi"])])
    assert reflow(df, Rules(), "d").count() == 2
    assert reflow(df, Rules(drop_music=True), "d").count() == 1


def test_merge_and_shear_match_folds(spark):
    rng = random.Random(3)
    rows = [(s := rng.randint(0, 400), s + rng.randint(0, 40), [f"w{k}"]) for k in range(60)]
    df = cues(spark, rows)
    merged = []
    for k, (s, e, lines) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][1], x[0])):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2] + lines)
        else:
            merged.append((s, e, lines))
    got = I.merge_overlaps(df, "d").orderBy("start_ms", "end_ms", "pos").collect()
    assert [(r.start_ms, r.end_ms, r.lines) for r in got] == merged
    out, reach = [], None
    for k, (s, e, _) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        s = s if reach is None else max(s, reach)
        e = max(s, e)
        reach = e
        out.append((s, e))
    got = I.segment_shear(df.drop("lines"), "d").orderBy("start_ms", "end_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == sorted(out)


def test_pads_match_fold(spark):
    rng = random.Random(9)
    spans, at = [], 0
    for _ in range(40):
        at += rng.randint(0, 120)
        spans.append((at, at + rng.randint(1, 90)))
        at = spans[-1][1]
    n, pad = at + 20, 30
    want = [list(s) for s in spans]
    for i, (s, e) in enumerate(spans):
        if i == 0:
            want[0][0] = max(0, s - pad)
        if i + 1 < len(spans):
            gap = spans[i + 1][0] - e
            want[i][1], want[i + 1][0] = (e + gap // 2, max(0, spans[i + 1][0] - gap // 2)) if gap < 2 * pad else (min(n, e + pad), max(0, spans[i + 1][0] - pad))
        else:
            want[i][1] = min(n, e + pad)
    df = spark.createDataFrame([(1, k, *s) for k, s in enumerate(spans)], "d bigint, pos bigint, start_ms bigint, end_ms bigint")
    got = I.pad_spans(df, pad, F.lit(n).cast("bigint"), "d").orderBy("pos").collect()
    assert [[r.start_ms, r.end_ms] for r in got] == want


def test_grid_and_caps(spark):
    df = spark.createDataFrame([(10, 4), (8, 4), (0, 4), (5, 0)], "dur bigint, win bigint")
    got = sorted((r.dur, r.start_ms, r.end_ms) for r in I.grid_spans(df, F.col("dur"), F.col("win")).collect())
    assert got == [(8, 0, 4), (8, 4, 8), (10, 0, 4), (10, 4, 8), (10, 8, 10)]
    spans = spark.createDataFrame([(0, 25), (30, 30)], "start_ms bigint, end_ms bigint")
    assert sorted((r.start_ms, r.end_ms) for r in I.cap_spans(spans, 10).collect()) == [(0, 10), (10, 20), (20, 25), (30, 30)]


def test_active_cue_is_the_first_by_start(spark):
    df = cues(spark, [(0, 30_000, ["long"]), (100, 200, ["short"]), (40_000, 40_000, ["empty"])])
    points = spark.createDataFrame([(1, 150), (1, 25_000), (1, 30_000), (1, 40_000)], "d bigint, t_ms bigint")
    assert sorted((r.t_ms, r.lines[0]) for r in I.active_cues(points, df, "d").collect()) == [(150, "long"), (25_000, "long")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], CUES)
    assert reflow(df, Rules(drop_music=True, max_dur_ms=1, min_dur_ms=1, min_gap_ms=1, max_chars_line=5, max_lines=2, max_cps=3, snap=10), "d").count() == 0
