"""Quality rules: a base rule on shape, then a hashed n-gram log-likelihood ratio.

Every document is scored as the mean, over its byte n-grams hashed into a fixed
number of buckets, of ``log p_target(bucket) - log p_raw(bucket)``: the target
multinomial is counted over all trusted documents, the raw one over all documents.
The mean makes the score independent of length, and a fixed threshold decides every
document alike. Bytes rather than words are counted because a corpus in several
languages has an unbounded vocabulary, while damage (symbols, capitals, tables)
shows in short byte runs.

Null or empty texts have no words, fail the base rule and score 0. Repeated rows count
as often as they occur and each gets its own result row; rows with a null id are never
trusted. An empty table gives no rows; without trusted documents every ratio is 0. Texts of
any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, mix64, slices
from .linking import may_be_member, membership_bitmap

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class RuleParams:
    gram_bytes: int = 4
    bucket_bits: int = 18
    smoothing: float = 0.5
    threshold: float = -0.6
    min_words: int = 10
    max_repeat_percent: int = 20
    window_words: int = 5


def bucket_ids(text: bytes, p: RuleParams) -> np.ndarray:
    """Bucket of every byte n-gram of the text; a shorter text is one gram, padded with zeros."""
    a = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    if len(a) == 0:
        return np.empty(0, dtype=np.int64)
    if len(a) < p.gram_bytes:
        a = np.pad(a, (0, p.gram_bytes - len(a)))
    n = len(a) - p.gram_bytes + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(p.gram_bytes):
        h = (h << np.uint64(8)) | a[i : i + n]
    return (mix64(h) >> np.uint64(64 - p.bucket_bits)).astype(np.int64)


def n_repeat_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window of so many words which occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        key = mix64(key + h[i : i + n])
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():  # unequal hashes: no window is repeated
        return 0
    grams = list(zip(*(words[i : i + n] for i in range(window)), strict=True))
    seen = Counter(grams)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_features(text: bytes, p: RuleParams) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    chars = b"".join(words).translate(None, _CONTINUATION)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return len(words), len(chars), len(text.translate(None, _NOT_SYMBOLS)), dup, n_repeat_words(words, p.window_words)


def _gram_counts(docs: DataFrame, p: RuleParams, bitmap: Broadcast | None = None) -> DataFrame:
    """(bucket, n_raw, n_maybe) over ``docs(id_hash, text)``; each task sends one row a bucket at most.

    ``n_maybe`` counts the rows whose id may be in the bitmap.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << p.bucket_bits
        both = np.zeros((2, size), dtype=np.int64)
        for rows, texts in slices(batches):
            maybe = np.ones(len(texts), dtype=bool)
            if bitmap is not None:
                ids = rows.column(0)
                maybe = may_be_member(bitmap.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            for of in (0, 1):
                ids = [bucket_ids(t, p) for t, k in zip(texts, maybe, strict=True) if t and k == bool(of)]
                if ids:
                    both[of] += np.bincount(np.concatenate(ids), minlength=size)
        at = np.flatnonzero(both.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[:, at].sum(axis=0)), pa.array(both[1, at])], names=["bucket", "n_raw", "n_maybe"])

    return docs.select("id_hash", "text").transform(in_batches, count, "bucket long, n_raw long, n_maybe long")


def _maybe(rows: DataFrame, bitmap: Broadcast) -> DataFrame:
    """The rows whose first column, a hash, may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(may_be_member(bitmap.value, b.column(0).to_numpy())))

    return rows.transform(in_batches, run, rows.schema)


def gram_counts(docs: DataFrame, good: DataFrame, p: RuleParams) -> DataFrame:
    """(bucket, n_raw, n_target) over all ``docs(doc_id, text)``; the target are those of ``good(doc_id)``.

    No text is shuffled to learn whether it is trusted: a bitmap of fixed size tells it
    but for rare false hits, which are found by their ids and taken off again.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    hashed = lambda df: df.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("id_hash"), *df.columns)
    good = good.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    bitmap = spark.sparkContext.broadcast(membership_bitmap(hashed(good).select("id_hash")))  # 8 MB
    plain = hashed(docs.select("doc_id", "text"))
    ids = hashed(docs.select("doc_id").where("doc_id IS NOT NULL").distinct())
    wrong = cut(_maybe(ids, bitmap).join(good.hint("merge"), "doc_id", "left_anti"), few=True)
    parts = _gram_counts(plain, p, bitmap).withColumnRenamed("n_maybe", "n_target")
    if not wrong.isEmpty():
        few = spark.sparkContext.broadcast(membership_bitmap(wrong.select("id_hash")))  # 8 MB
        untrusted = _maybe(plain.where("id_hash IS NOT NULL"), few).join(wrong.select("doc_id"), "doc_id", "left_semi")
        parts = parts.unionByName(_gram_counts(untrusted, p).select("bucket", F.lit(0).cast("long").alias("n_raw"), (-F.col("n_raw")).alias("n_target")))
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def fit_weights(counts: DataFrame, p: RuleParams) -> np.ndarray:
    """Log ratio of each bucket. At most 2**bucket_bits rows reach the driver, whatever the corpus."""
    got = counts.toArrow()
    size = 1 << p.bucket_bits
    n = np.zeros((2, size))
    at = got.column("bucket").to_numpy()
    n[0, at], n[1, at] = got.column("n_raw").to_numpy(), got.column("n_target").to_numpy()
    if n[1].sum() == 0:  # nothing is trusted: no evidence against any document
        return np.zeros(size, dtype=np.float32)
    logs = np.log(n + p.smoothing) - np.log(n.sum(axis=1, keepdims=True) + p.smoothing * size)
    return (logs[1] - logs[0]).astype(np.float32)


def _judge(texts: list[bytes | None], w: np.ndarray, p: RuleParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base features, ratio, base_failed and kept of some texts."""
    feats = np.array([base_features(t or b"", p) for t in texts], dtype=np.int64)
    llr = np.array([float(w[bucket_ids(t, p)].mean(dtype=np.float64)) if t else 0.0 for t in texts])
    bad = (feats[:, 0] < p.min_words) | (100 * feats[:, 4] > p.max_repeat_percent * feats[:, 0])
    return feats, llr, bad, ~bad & (llr >= p.threshold)


def score_rules(docs: DataFrame, weights: np.ndarray, p: RuleParams, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the base features, the ratio, and the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bucket_bits floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            feats, llr, bad, kept = _judge(texts, shared.value, p)
            cols = [rows.column(0), *(pa.array(feats[:, i]) for i in range(5)), pa.array(llr), pa.array(bad), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(in_batches, score, schema)


def fit_rules(docs: DataFrame, labels: DataFrame, p: RuleParams = RuleParams()) -> np.ndarray:
    """Weights from all ``docs(doc_id, text)``; those with a label ``quality = 1`` are the trusted target."""
    return fit_weights(gram_counts(docs, labels.where("quality = 1").select("doc_id"), p), p)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """The base features, ratio and verdict of every row."""
    return score_rules(docs, fit_rules(docs, labels, p), p)


def keep_quality(docs: DataFrame, labels: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_rules(docs, labels, p))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, column):
            yield rows.filter(pa.array(_judge(texts, shared.value, p)[3]))

    return docs.transform(in_batches, run, docs.schema)
