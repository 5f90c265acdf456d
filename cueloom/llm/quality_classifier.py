"""Quality classifier: hashed word n-gram logistic regression, learnt with FTRL-proximal updates.

The model is fitted on the driver from a bounded sample of labelled rows
(``max_rows``, the rows with the smallest hash of their id, so the choice does not
depend on partitioning). Every whole text is then scored as one sparse dot product.

Null and empty texts have no features and score the model's bias. Labels other than 0
and 1, and labels without a document, are not learnt from. Without any label, or with
one class only, the score is the share of that class (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, slices
from .hashing import TokenHashes, ngram_features


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    max_rows: int = 12_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray
    bias: float


def ftrl_fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, p: FtrlParams) -> LinearModel:
    """Per-coordinate FTRL-proximal over the rows, in a fixed pseudo-random order each epoch."""
    size = 1 << p.bits
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    if len(rows) == 0 or y.min() == y.max():
        share = 0.5 if len(rows) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
        return LinearModel(w.astype(np.float32), float(np.log(share / (1 - share))))
    bias, bias_n = float(np.log(y.mean() / (1 - y.mean()))), 0.0
    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            s = bias + w[i] @ v
            err = 1 / (1 + np.exp(-np.clip(s, -35, 35))) - y[k]
            bias_n += err * err
            bias -= p.alpha / (p.beta + np.sqrt(bias_n)) * err
            g = err * v
            n_new = n[i] + g * g
            z[i] += g - (np.sqrt(n_new) - np.sqrt(n[i])) / p.alpha * w[i]
            n[i] = n_new
            zi = z[i]
            w[i] = np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n_new)) / p.alpha + p.l2))
    return LinearModel(w.astype(np.float32), bias)


def sample_ids(labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """(doc_id, y): at most ``max_rows`` labelled ids, those with the smallest hash."""
    one = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def _featurise(p: FtrlParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for rows, texts in slices(batches):
            feats = [ngram_features((t or b"").decode(), cache, p.bits) for t in texts]
            cols = [rows.column(0), pa.array([f[0].astype(np.int32).tobytes() for f in feats], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in feats], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "idx", "val"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", p: FtrlParams = FtrlParams(), learn: Column | None = None) -> LinearModel:
    """Learns ``label`` from ``labels(doc_id, label)`` rows that satisfy ``learn``."""
    ids = sample_ids(labels, label, F.lit(True) if learn is None else learn, p.max_rows)
    # the sample has max_rows ids at most, so it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", "text")
    got = sample.mapInArrow(_featurise(p), "y int, idx binary, val binary").toArrow()
    rows = [(np.frombuffer(a, dtype=np.int32), np.frombuffer(b, dtype=np.float32).astype(np.float64)) for a, b in zip(got.column("idx").to_pylist(), got.column("val").to_pylist(), strict=True)]
    y = got.column("y").to_numpy().astype(np.float64)
    order = sorted(range(len(rows)), key=lambda k: (y[k], len(rows[k][0]), rows[k][0].tobytes()))  # not the order of arrival
    return ftrl_fit([rows[k] for k in order], y[order], p)


def score_quality(docs: DataFrame, model: LinearModel, p: FtrlParams = FtrlParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, TokenHashes()
        for rows, texts in slices(batches):
            s = np.empty(len(texts))
            for k, t in enumerate(texts):
                i, v = ngram_features((t or b"").decode(), cache, p.bits)
                s[k] = m.bias + float(m.weights[i].astype(np.float64) @ v)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, p: FtrlParams = FtrlParams()) -> DataFrame:
    """Learns outside the held-out fold, scores every document."""
    model = fit_quality(docs, labels, "quality", p, learn=fold("doc_id", 4) != 2)
    return score_quality(docs, model, p).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
