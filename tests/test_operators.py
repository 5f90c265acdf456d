import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.operators import asr, batching, evaluation, jobs, ports, store, telemetry
from cueloom.sources import wav


def test_windows(spark):
    texts = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "g bigint, p bigint, t string")
    for size, pad in ((2, 1), (0, 0), (9, 3), (2, -4)):
        got = [(r.texts, r.before, r.after) for r in batching.context_windows(df, size, pad, "p", "t", "g").orderBy("win_idx").collect()]
        s, q = max(1, size), max(0, pad)
        assert got == [(texts[k : k + s], texts[max(0, k - q) : k], texts[k + s : k + s + q]) for k in range(0, 5, s)]


def fsm(probs, length, rate, enter=0.5, leave=0.35, min_speech=250, min_silence=100):
    size = asr.WINDOW_SAMPLES[rate]
    ms, mq = int(rate * min_speech / 1000), int(rate * min_silence / 1000)
    on, quiet, spans = None, 0, []
    for i, p in enumerate(probs):
        at = i * size
        if p >= enter:
            quiet = 0
            on = at if on is None else on
        elif p < leave and on is not None:
            quiet = quiet or at
            if at - quiet >= mq:
                if quiet - on > ms:
                    spans.append((on, quiet))
                on, quiet = None, 0
    if on is not None and length - on > ms:
        spans.append((on, length))
    return spans


def test_voice_activity_matches_fold(spark):
    rng = random.Random(1)
    rows = [(k, [rng.random() if rng.random() < 0.4 else (0.9 if (j // 9) % 2 else 0.1) for j in range(rng.randint(0, 120))]) for k in range(40)]
    df = spark.createDataFrame([(k, p, len(p) * 512) for k, p in rows], "a bigint, probs array<double>, n bigint")
    got = {r.a: [(x.s, x.e) for x in r.spans] for r in df.select("a", asr.raw_speech(F.col("probs"), F.col("n"), 16000, 0.5, 0.35, 4000, 1600).alias("spans")).collect()}
    assert got == {k: fsm(p, len(p) * 512, 16000) for k, p in rows}
    short = spark.createDataFrame([(1, [0.1, 0.6, 0.7, 0.1, 0.1], 2560)], "a bigint, probs array<double>, n_samples bigint")
    got = asr.speech_spans(short, 16000, "a", min_speech_ms=0, min_silence_ms=0, pad_ms=0).collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(32, 96)]
    assert asr.speech_spans(short, 44100, "a").count() == 0


def test_pad_duplicates():
    assert asr.is_pad_duplicate("and then he said".split(), "then he said".split())
    assert not asr.is_pad_duplicate("and then".split(), "then".split())
    assert not asr.is_pad_duplicate("a b".split(), "a b c d e".split())
    assert asr.longest_common_run(list("abcde"), list("xbcdy")) == 3


def test_merge_padded(spark):
    rows = [(1, 0, 0, 0, 0, 900, "we went to the"), (1, 1, 0, 1000, 800, 1500, "went to the sea today"), (1, 1, 1, 1000, 1500, 1900, "and back"), (1, 2, 0, 2000, 1900, 2400, "new words")]
    df = spark.createDataFrame(rows, "a bigint, window bigint, pos bigint, span_start_ms bigint, start_ms bigint, end_ms bigint, text string")
    assert [r.text for r in asr.merge_padded(df, "a").orderBy("start_ms").collect()] == ["went to the sea today", "and back", "new words"]


def test_timestamps_without_marks(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, " b")], "k bigint, pos bigint, token string")
    assert [tuple(r) for r in asr.timestamp_segments(df, F.lit(3.0), "k").collect()] == [(1, 0, 0.0, 3.0, "a b")]


def test_job_states(spark):
    events = [(1, 1, "advance"), (1, 2, "fail"), (1, 3, "advance"), (2, 1, "complete"), (3, 1, "advance"), *[(4, k, "advance") for k in range(7)]]
    got = {r.job: (r.state, r.refused) for r in jobs.final_states(spark.createDataFrame(events, "job bigint, seq bigint, action string"), "job").collect()}
    assert got == {1: ("failed", 1), 2: ("completed", 0), 3: ("ingesting", 0), 4: ("completed", 2)}


def test_seal(spark):
    a = spark.createDataFrame([(1, "partial"), (2, "empty"), (3, "complete")], "k bigint, status string")
    m = spark.createDataFrame([(1,), (1,), (3,)], "k bigint")
    got = {r.k: (r.status, r.error) for r in jobs.seal(a, m, "asr-failed", "k").collect()}
    assert got == {1: ("complete", None), 2: ("empty", "asr-failed"), 3: ("complete", "illegal-transition")}


def test_cache(spark):
    cache = spark.createDataFrame([("a", None, 1, "x"), ("b", 10, 10, "y")], "key string, cached_at bigint, mtime bigint, payload string")
    assert {r.key for r in store.live(cache, 100, 50).collect()} == {"a"}
    assert store.live(cache, 100, 0).count() == 2
    new = store.store(cache, spark.createDataFrame([("b", "z"), ("c", "w")], "key string, payload string"), 99)
    assert {(r.key, r.payload) for r in new.collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert {r.key for r in store.evict(cache, 15, 6).collect()} == {"b"}
    assert store.forget(cache, spark.createDataFrame([("a",)], "key string")).count() == 1


def test_usage(spark):
    bodies = ['{"usage":{"prompt_tokens":10,"completion_tokens":4}}', '{"usage":{"cost":"0.0000015"}}', "{}"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [tuple(r.u) for r in df.select(telemetry.normalize_usage(F.col("b"), F.lit("0.000001"), F.lit("0.000002")).alias("u")).collect()]
    assert got == [(10, 4, 14, 18), (None, None, None, 2), (None, None, None, None)]


def test_chat_translation(spark):
    calls = []

    def call(request):
        texts = json.loads(request["messages"][1]["content"])["texts"]
        calls.append(len(texts))
        if len(texts) > 1 and "bad" in texts:
            return 200, json.dumps({"choices": [{"message": {"content": "[]"}}]})
        return 200, json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps({"t": [t.upper() for t in texts]}) + "\n```"}}]})

    df = spark.createDataFrame([(0, ["a", "bad", "c"], [], [])], "win_idx bigint, texts array<string>, before array<string>, after array<string>")
    row = ports.chat_translate(df, call, {"retry_base_ms": 0}).first()
    assert row.ok == ["A", "BAD", "C"] and row.error is None
    failing = ports.chat_translate(df, lambda r: (400, ""), {}).first()
    assert failing.ok is None and failing.error == "translation-failed: http 400"
    seen = iter([429, 503, 200])
    assert ports.call_with_retry(lambda r: (next(seen), "x"), {}, 2, 0) == (200, "x", [429, 503, 200])


def test_replies():
    assert ports.parse_translations('["a","b"]', 2) == (["a", "b"], None)
    assert ports.parse_translations('{"x":["a"]}', 1) == (["a"], None)
    assert ports.parse_translations("[1]", 1)[1] == "model returned wrong shape/length"
    assert ports.parse_translations("oops", 1)[1] == "unparseable model output"


def test_registry():
    with pytest.raises(ports.PortError, match="known"):
        ports.translators.make("nobody")
    assert ports.translators.first(["nobody", "identity"])[0] == "identity"
    with pytest.raises(ports.PortError, match="http"):
        ports.translators.first(["http"])
    assert ports.incompatible("canary", "grid") and not ports.incompatible("stub", "grid") and not ports.incompatible(None, "grid")
    assert ports.load_addons(["json", "no.such.module"]) ["json"] == "ok"
    assert ports.resolve_config({"a": None}, {"CUELOOM_A": "env"}, {"a": "file", "b": "file"}, {"a": 1, "b": 2, "c": 3}) == {"a": "env", "b": "file", "c": 3}


def test_wav(spark):
    x = np.sin(np.arange(1600) / 7).astype(np.float32)
    data = wav.encode_mono(x, 16000)
    assert wav.probe_bytes(data) == ("wav", 100, True, "pcm_s16le", 16000, 1)
    assert np.abs(wav.decode_mono(data) - x).max() < 1e-4
    df = spark.createDataFrame([(data,), (b"no",), (None,)], "c binary")
    got = df.select(wav.probe(F.col("c")).alias("p"), wav.decode(F.col("c")).alias("s")).collect()
    assert got[0].p.duration_ms == 100 and len(got[0].s) == 1600 and got[1].p.container is None and got[2].s is None
    assert wav.log_mel(x).shape == (80, 11) and np.allclose(wav.mel_to_hz(wav.hz_to_mel(np.array([0.0, 440.0, 4000.0]))), [0, 440, 4000])


def test_chrf(spark):
    df = spark.createDataFrame([(1, "abcdef", "abcdef"), (2, "", "x"), (3, "ab cd", "abcd")], "k bigint, h string, r string")
    got = {r.k: r.chrf for r in evaluation.chrf(df, "h", "r", "k").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0}
    floors = evaluation.ship_floor(spark.createDataFrame([(0.6, 0.2, 0.2), (0.3, 0.2, 0.2)], "chrf double, chance double, source_chrf double")).collect()
    assert [r.ships for r in floors] == [True, False]
