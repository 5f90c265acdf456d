"""Toxicity: non-negative positive-unlabelled learning of a linear numpy classifier.

Confirmed toxic examples (P) and unlabelled texts (U) for the gradients are bounded samples
of labelled rows (``max_positive``, ``max_unlabelled``: the rows with the smallest hash of
their id); those of U are taken whatever their label, which is not read. The class prior
``pi`` is the toxic share of the labelled rows that may be learnt from. Minimised is the
non-negative risk estimate

    pi * R_P(+)  +  max(0, R_U(-) - pi * R_P(-))

with logistic loss; where the second term would fall below zero, its gradient is
followed upwards instead, which stops the classifier from declaring the positives
hidden in U negative. Features are hashed words and word prefixes, beside marks of the
length. Those that at least ``min_positive`` texts of P have are counted over all documents
that may be learnt from, and the model has the ``n_features`` of them that set P most apart.

Null and empty texts score the bias. Without positives, or without unlabelled rows,
every text scores the prior. Repeated rows each count and score; an empty table gives no
rows; equal ranks go by the feature's number; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, mix64, slices
from .hashing import LENGTH_MARKS, TokenHashes, WantedFeatures, presence_features


@dataclass(frozen=True)
class NnpuParams:
    bits: int = 20
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    max_positive: int = 4_000
    max_unlabelled: int = 10_000
    n_features: int = 1_500
    min_positive: int = 3
    epochs: int = 60
    batch: int = 512
    rate: float = 0.05
    l2: float = 3e-4


@dataclass(frozen=True)
class PuModel:
    weights: np.ndarray
    bias: float


def positive_counts(pos: list[np.ndarray], p: NnpuParams) -> np.ndarray:
    """The number of texts of P that have each feature."""
    return np.bincount(np.concatenate(pos), minlength=1 << p.bits) if pos else np.zeros(1 << p.bits, dtype=np.int64)


def select_features(a: np.ndarray, na: int, b: np.ndarray, nb: int, p: NnpuParams) -> np.ndarray:
    """Features commoner in P (``a`` of ``na`` texts) than in U, by signed log-likelihood ratio, largest first."""
    at = np.flatnonzero(a >= p.min_positive)
    a, b = a[at].astype(np.float64), b[at].astype(np.float64)
    ra, rb, r = a / na, (b + 0.5) / (nb + 1), (a + b) / (na + nb)
    g = a * np.log(ra / r) + b * np.log(np.maximum(b, 1e-9) / nb / r)
    keep = ra > 1.5 * rb
    at, g = at[keep], g[keep]
    marks = (mix64(TokenHashes().of(LENGTH_MARKS)) >> np.uint64(64 - p.bits)).astype(np.int64)
    return np.unique(np.append(at[np.lexsort((at, -g))[: p.n_features]], marks))


def _matrix(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(chosen)), dtype=np.uint8)
    for k, f in enumerate(rows):
        at = np.searchsorted(chosen, f)
        at[at == len(chosen)] = 0
        out[k, at[chosen[at] == f]] = 1
    return out


def nnpu_fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, p: NnpuParams, chosen: np.ndarray | None = None) -> PuModel:
    """Adam on the non-negative risk, in fixed pseudo-random batches. Without ``chosen`` features, U tells them."""
    full = np.zeros(1 << p.bits, dtype=np.float32)
    prior = float(np.clip(prior, 0.005, 0.95))
    flat = PuModel(full, float(np.log(prior / (1 - prior))))
    if not pos or not unl or not sum(map(len, pos)) or not sum(map(len, unl)):
        return flat
    if chosen is None:
        chosen = select_features(positive_counts(pos, p), len(pos), positive_counts(unl, p), len(unl), p)
    xp, xu = _matrix(pos, chosen), _matrix(unl, chosen)
    w, b = np.zeros(len(chosen)), flat.bias
    m, v, t = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -35, 35)))
    rng = np.random.default_rng(11)
    steps = max(1, len(xu) // p.batch)
    for _ in range(max(p.epochs, 600 // steps)):
        u_parts, p_parts = np.array_split(rng.permutation(len(xu)), steps), np.array_split(rng.permutation(len(xp)), steps)
        for iu, ip in zip(u_parts, p_parts, strict=True):
            if not len(ip):
                ip = rng.integers(0, len(xp), size=min(len(xp), 32))
            fu, fp = xu[iu].astype(np.float32), xp[ip].astype(np.float32)
            su, sp = sig(fu @ w + b), sig(fp @ w + b)
            r_neg = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) + prior * np.mean(np.log1p(-np.minimum(sp, 1 - 1e-12)))
            # gradients with respect to the margins: of the loss for +1, s - 1; for -1, s
            gp_pos, gu_neg, gp_neg = prior * (sp - 1) / len(ip), su / len(iu), prior * sp / len(ip)
            if r_neg >= 0:
                gu, gp = gu_neg, gp_pos - gp_neg
            else:
                gu, gp = -gu_neg, gp_neg
            g = np.append(fu.T @ gu + fp.T @ gp + p.l2 * w, gu.sum() + gp.sum())
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= step[:-1]
            b -= step[-1]
    full[chosen] = w
    return PuModel(full, float(b))


def _featurise(p: NnpuParams, wanted=None):
    """A text's features, or those of them that the broadcast mask ``wanted`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is None:
            cache = TokenHashes()
            of = lambda texts: [presence_features((t or b"").decode(), cache, p.bits, p.prefixes) for t in texts]
        else:
            of = WantedFeatures(wanted.value, p.prefixes).of
        for _, texts in slices(batches, 0):
            feats = [np.asarray(f, dtype=np.int32).tobytes() for f in of(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.binary())], names=["idx"])

    return run


def _feature_rows(docs: DataFrame, ids: DataFrame, p: NnpuParams, wanted=None) -> list[np.ndarray]:
    """Features of the documents of ``ids``, which are few enough to be broadcast, in a fixed order."""
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").mapInArrow(_featurise(p, wanted), "idx binary").toArrow()
    return [np.frombuffer(f, dtype=np.int32) for f in sorted(got.column("idx").to_pylist())]


def document_counts(docs: DataFrame, wanted: np.ndarray, p: NnpuParams) -> tuple[np.ndarray, int]:
    """The number of texts of ``docs(text)`` that have each wanted feature, and of all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # 2**bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts, n = WantedFeatures(shared.value, p.prefixes), np.zeros(len(shared.value), dtype=np.int64), 0
        for _, texts in slices(batches, 0):
            n += len(texts)
            for found in cache.of(texts):
                counts[found] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(n, counts[at]))], names=["feature", "n"])

    got = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = got.column("feature").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(len(wanted), dtype=np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", p: NnpuParams = NnpuParams(), learn: Column | None = None) -> PuModel:
    """Learns from rows that satisfy ``learn``; every labelled row may be unlabelled text as well, its label unread."""
    learn = F.lit(True) if learn is None else learn
    one = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    first = lambda ids, n: ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    prior = one.agg(F.avg("y")).first()[0] or 0.0
    pos = _feature_rows(docs, first(one.where("y = 1"), p.max_positive), p)
    a = positive_counts(pos, p)
    if not a.any():
        return nnpu_fit([], [], prior, p)
    b, nb = document_counts(docs.where(learn), a >= p.min_positive, p)
    chosen = select_features(a, len(pos), b, nb, p)
    mask = np.zeros(1 << p.bits, dtype=bool)
    mask[chosen] = True
    unl = _feature_rows(docs, first(one, p.max_unlabelled), p, docs.sparkSession.sparkContext.broadcast(mask))
    return nnpu_fit(pos, unl, prior, p, chosen)


def score_toxicity(docs: DataFrame, model: PuModel, p: NnpuParams = NnpuParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = WantedFeatures(m.weights != 0, p.prefixes)
        for rows, texts in slices(batches):
            s = np.array([m.bias + float(m.weights[found].sum(dtype=np.float64)) for found in cache.of(texts)])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, p: NnpuParams = NnpuParams()) -> DataFrame:
    """Learns outside the held-out fold, scores every document."""
    model = fit_toxicity(docs, labels, "toxic", p, learn=fold("doc_id", 4) != 2)
    return score_toxicity(docs, model, p).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
