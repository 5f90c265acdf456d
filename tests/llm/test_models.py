import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from cueloom.llm import language_id as LI
from cueloom.llm import quality_rules as QR
from cueloom.llm.common import slices
from cueloom.llm.hashing import TokenHashes, ngram_features, presence_features
from cueloom.llm.quality_classifier import FtrlParams, classify_quality, ftrl_fit
from cueloom.llm.toxicity import NnpuParams, PuModel, classify_toxicity, document_counts, nnpu_fit, score_toxicity
from tests.llm import fixtures as X


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def area(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# ---- quality rules


def brute_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(wins)
    hit = {k + j for k, w in enumerate(wins) if many[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def brute_counts(texts, p):
    out = Counter()
    for t in texts:
        b = (t or "").encode()
        b = b + b"\0" * (p.gram_bytes - len(b)) if 0 < len(b) < p.gram_bytes else b
        out.update(b[k : k + p.gram_bytes] for k in range(len(b) - p.gram_bytes + 1))
    return out


def test_quality_rules_equal_brute_force(spark):
    given = X.rows() + [(900, "junk### " * 40), (901, "aa bb cc dd ee ff gg hh ii jj kk\nx\nx\nx"), (902, "a b c d e f a b c d e x y z q")]
    p = QR.RuleParams(bucket_bits=22, threshold=-0.2)
    good = [i for i, t in given if i < 40]
    lab = X.labels(spark, [(i, 1, 0) for i in good] + [(900, 0, 0), (5, None, None), (99999, 1, 0)])
    got = QR.apply_quality_rules(X.clashing(X.documents(spark, given)), lab, p).collect()
    assert len(got) == len(given)
    raw, target = brute_counts([t for _, t in given], p), brute_counts([t for i, t in given if i in good], p)
    size = 1 << p.bucket_bits
    logp = lambda c, n: math.log(c + p.smoothing) - math.log(n + p.smoothing * size)
    texts = {}
    for i, t in given:
        texts[i] = t
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        bad = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == bad
        grams = brute_counts([texts[r.doc_id]], p)
        n = sum(grams.values())
        llr = sum(c * (logp(target[g], target.total()) - logp(raw[g], raw.total())) for g, c in grams.items()) / n if n else 0.0
        assert abs(r.llr - llr) < 2e-3  # buckets may be shared
        assert r.kept == (not bad and r.llr >= p.threshold)
    assert not next(r for r in got if r.doc_id == 900).kept


def test_quality_rules_edges(spark):
    e, lab = X.empty(spark), X.labels(spark, [])
    assert QR.apply_quality_rules(e, lab).count() == 0
    docs = X.clashing(X.documents(spark))
    none = QR.apply_quality_rules(docs, lab).collect()
    assert all(r.llr == 0 and r.kept != r.base_failed for r in none)
    kept = QR.keep_quality(docs, lab)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in none if r.kept)


def test_repeats_in_windows():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert QR.n_repeat_words(words, 5) == brute_base(b" ".join(words).decode())[4]


# ---- classifiers


def test_features_are_deterministic():
    cache = TokenHashes(limit=4)
    a = ngram_features("one two two THREE ## ##", cache, 18)
    b = ngram_features("one two two THREE ## ##", TokenHashes(), 18)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and abs((a[1] ** 2).sum() - 1) < 1e-9
    assert not len(ngram_features("", cache, 18)[0]) and not len(presence_features(" ", cache, 18, (4,)))
    assert (presence_features("b a a", cache, 18, (4,)) == presence_features("a b", TokenHashes(), 18, (4,))).all()


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(50, 8, replace=False)) + (50 if k % 3 == 0 else 0), np.full(8, 8**-0.5)) for k in range(300)]
    y = np.array([1.0 if k % 3 else 0.0 for k in range(300)])
    m = ftrl_fit(rows, y, FtrlParams(bits=7))
    s = np.array([m.bias + m.weights[i] @ v for i, v in rows])
    assert ((s > 0) == (y == 1)).mean() > 0.99
    assert ftrl_fit([], np.array([]), FtrlParams(bits=4)).bias == 0
    assert ftrl_fit(rows[:3], np.ones(3), FtrlParams(bits=7)).bias > 2


def test_nnpu_finds_positives_hidden_in_unlabelled_text():
    rng = np.random.default_rng(1)
    doc = lambda toxic: np.unique(np.append(rng.choice(500, 20, replace=False), rng.choice(np.arange(500, 510), 3) if toxic else []).astype(np.int64))
    pos, unl = [doc(True) for _ in range(150)], [doc(k % 5 == 0) for k in range(1000)]
    m = nnpu_fit(pos, unl, 0.2, NnpuParams(bits=10, prefixes=()))
    s = np.array([m.bias + m.weights[f].sum() for f in unl])
    assert ((s > 0) == (np.arange(1000) % 5 == 0)).mean() > 0.97
    assert not nnpu_fit([], unl, 0.2, NnpuParams(bits=10)).weights.any()


def test_toxicity_equals_brute_force(spark, sf):
    """Counts over all documents, and every score, from each text's whole list of features."""
    docs, p = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), NnpuParams(n_features=300)
    docs = docs.unionByName(X.documents(spark).select("doc_id", "text"))
    feats = [(r.doc_id, presence_features(r.text or "", TokenHashes(), p.bits, p.prefixes)) for r in docs.collect()]
    rng = np.random.default_rng(2)
    wanted = rng.random(1 << p.bits) < 0.3
    counts, n = document_counts(docs, wanted, p)
    brute = np.zeros(1 << p.bits, dtype=np.int64)
    for _, f in feats:
        brute[f] += 1
    assert n == len(feats) and (counts == brute * wanted).all()
    model = PuModel(np.where(wanted, rng.normal(size=1 << p.bits), 0).astype(np.float32), -1.0)
    score = lambda f: 1 / (1 + math.exp(-float(np.clip(-1.0 + model.weights[f].astype(np.float64).sum(), -35, 35))))
    got = sorted((r.doc_id, r.score) for r in score_toxicity(docs, model, p).collect())
    assert np.allclose([s for _, s in got], [s for _, s in sorted((i, score(f)) for i, f in feats)], atol=1e-9)


@pytest.mark.parametrize(("name", "run", "least"), [("quality", classify_quality, 0.97), ("toxic", classify_toxicity, 0.9)])
def test_held_out_area(spark, name, run, least):
    import os

    top = "/root/testdata/sf0.1"
    if not os.path.isdir(top):
        pytest.skip("no test data")
    docs, lab = (spark.read.parquet(f"{top}/{t}.parquet") for t in ("documents", "labels"))
    got = run(docs, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and area(got["score"].to_numpy(), got[name].to_numpy()) > least


@pytest.mark.parametrize("run", [classify_quality, classify_toxicity])
def test_classifier_edges(spark, run):
    given = X.rows()
    docs = X.clashing(X.documents(spark))
    lab = X.labels(spark, [(i, i % 2, i % 2) for i in range(30)] + [(5, 1, 1), (6, None, None), (12345, 1, 1)])
    got = run(docs, lab).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in given)
    assert all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    # held-out labels are not read: turning them over changes nothing
    other = X.labels(spark, [(i, i % 2 if fold(i, 4) != 2 else 1 - i % 2, i % 2 if fold(i, 4) != 2 else 1 - i % 2) for i in range(30)] + [(5, 1, 1), (6, None, None), (12345, 1, 1)])
    assert sorted((r.doc_id, r.score) for r in run(docs, other).collect()) == sorted((r.doc_id, r.score) for r in got)
    assert run(X.empty(spark), lab).count() == 0
    assert all(0 <= r.score <= 1 for r in run(docs, X.labels(spark, [])).collect())


# ---- language


def test_forward_sums_all_segmentations():
    p = LI.LanguageParams()
    names = {"▁": 2, "▁a": 3, "a": 4, "ab": 5, "b": 6, "bab": 7, "▁ab": 8}
    pieces = LI.Pieces(names)
    probs = np.array([0, p.unknown, 0.1, 0.2, 0.15, 0.05, 0.3, 0.02, 0.18])[:, None]
    for word in ("a", "ab", "abab", "bz", "zz"):
        text = "▁" + word
        total = 0.0
        for k in range(len(text)):
            for cuts in combinations(range(1, len(text)), k):
                parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)), strict=True)]
                total += math.prod(probs[names.get(x, LI._UNKNOWN if len(x) == 1 else 0), 0] for x in parts)
        n, cells = LI._lattice([word, word], pieces)
        assert np.allclose(LI.forward(n, cells, probs)[n], total, rtol=1e-9)
        assert np.allclose(LI.log_forward(word, probs, pieces), math.log(total), rtol=1e-9)
    counts = LI.expected_counts(["ab"], np.array([3.0]), pieces, p)
    assert counts[0] == 0 and 3 <= counts.sum() <= 9


def _brute_log(word, names, longest, logp):
    """Log of the sum over all segmentations, in logs throughout."""
    text = "▁" + word
    alpha = [0.0]
    for e in range(1, len(text) + 1):
        terms = []
        for k in range(max(0, e - longest), e):
            piece = names.get(text[k:e], LI._UNKNOWN if e - k == 1 else None)
            if piece is not None:
                terms.append(alpha[k] + logp[piece])
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(x - top) for x in terms)))
    return alpha[-1]


def _brute_counts(word, names, longest, logp):
    """Expected pieces by all forward and backward sums, in logs."""
    text = "▁" + word
    n, add = len(text), lambda xs: (t := max(xs)) + math.log(sum(math.exp(x - t) for x in xs))
    cells = {(k, e): c for k in range(n) for e in range(k + 1, min(n, k + longest) + 1) if (c := names.get(text[k:e], LI._UNKNOWN if e - k == 1 else None)) is not None}
    fore, back = [0.0] + [None] * n, [None] * n + [0.0]
    for e in range(1, n + 1):
        fore[e] = add([fore[k] + logp[c] for (k, x), c in cells.items() if x == e])
    for k in range(n - 1, -1, -1):
        back[k] = add([back[e] + logp[c] for (x, e), c in cells.items() if x == k])
    out = Counter()
    for (k, e), c in cells.items():
        out[c] += math.exp(fore[k] + logp[c] + back[e] - fore[n])
    return out


def test_language_equals_brute_force(spark, monkeypatch):
    """Every prediction and score, with words far over the batched length, against sums in logs."""
    monkeypatch.setattr(LI, "_BLOCK", 50)  # for the direct calls below
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    names, p = LI.pieces_of(vocabulary), LI.LanguageParams()
    longest = max(map(len, names))
    assert longest > 10
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    speech = {"en": "thearnsiowd", "de": "eninschrtuäß", "xx": "ภาษไทยคน"}
    rows = []
    for i in range(60):
        lang = list(speech)[i % 3]
        ws = [word(speech[lang]) for _ in range(rng.randint(1, 9))]
        if i % 4 == 0:
            ws.append("".join(ws) * 9)  # one long run
        rows.append((i, " ".join(ws), lang if i % 7 else None))
    rows += [(70, "中" * 300 + " information " * 3, None), (71, "information" * 40, None), (72, "", "en"), (73, None, "en"), (0, "information government", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in LI.identify_language(df).collect())
    langs = sorted({x for i, t, x in rows if x and t is not None and fold(i, 3) != 1})
    size = len(names) + 2
    flat = [-math.inf, math.log(p.unknown)] + [-math.log(size)] * len(names)
    counts = {x: Counter() for x in langs}
    for i, t, x in rows:
        if x and t and fold(i, 3) != 1:
            for w in LI.words_of(t):
                counts[x].update(_brute_counts(w, names, longest, flat))
    logp = {}
    for x, c in counts.items():
        c[LI._UNKNOWN] = 0
        for k in c:
            c[k] = round(c[k], 6)  # as the model's counts are, whatever the order of their sum
        whole = sum(c.values())
        logp[x] = [-math.inf, math.log(p.unknown)] + [math.log((c[k] + p.smoothing) / (whole + p.smoothing * size)) for k in range(2, size)]
    want = []
    for i, t, _ in rows:
        ws = LI.words_of(t or "")
        if not ws:
            want.append((i, "und", 0.0))
            continue
        s = [sum(_brute_log(w, names, longest, logp[x]) for w in ws) for x in langs]
        want.append((i, langs[int(np.argmax(s))], 1 / sum(math.exp(v - max(s)) for v in s)))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6
    # blocks of a long word meet without a seam
    pieces, one = LI.Pieces(names), "information" * 20
    out = np.zeros(pieces.size)
    LI._expected_of_long(one, 2.0, pieces, np.exp(np.array(flat))[:, None], out)
    brute = _brute_counts(one, names, longest, flat)
    assert np.allclose(out, [2 * brute[k] for k in range(pieces.size)], atol=1e-9)
    probs = np.exp(np.array(flat))[:, None]
    assert np.allclose(LI.log_forward(one, probs, pieces), _brute_log(one, names, longest, flat))


def test_language_of_test_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = LI.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98


def test_language_edges(spark):
    given = X.rows() + [(950, "1234 !! ²"), (951, "été français " * 20), (952, "x" * 100_000)]
    got = {r.doc_id: r for r in LI.identify_language(X.clashing(X.documents(spark, given))).collect()}
    assert {got[i].lang_pred for i in (200, 201, 202, 205, 950)} == {"und"} and got[950].score == 0
    assert got[951].lang_pred == "en" and got[952].lang_pred == "en"  # the only language there is
    assert all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert LI.identify_language(X.empty(spark)).count() == 0
    none = X.documents(spark, given).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert {r.lang_pred for r in LI.identify_language(none).collect()} == {"und"}


def test_words():
    assert LI.words_of("Été-1a²b_C abcdefg " + "x" * 99) == ["été", "a", "b", "c", "abcdefg", "x" * 99]
    pieces = LI.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces["▁the"] > 1 and pieces["▁information"] > 1


def test_slices_keep_every_row():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 5, 9_000_000, 3)] * 3 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(13)), pa.array(texts)], names=["i", "t"])
    out = [(i, t) for rows, ts in slices(iter([batch.slice(2), batch.slice(0, 2)])) for i, t in zip(rows.column(0).to_pylist(), ts, strict=True)]
    assert sorted(out) == [(i, None if t is None else t.encode()) for i, t in enumerate(texts)]
