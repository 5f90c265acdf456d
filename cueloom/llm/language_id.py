"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. For each language, piece
probabilities are learnt in one expectation-maximisation round over all its training
words: the expected count of each piece, over all segmentations of a word under equal
piece weights, then normalised with smoothing. A text's log-likelihood is the sum over
its words of the log of the forward probability, which sums over all segmentations.
The prediction is the likeliest language and the score its posterior under equal priors.

Words are whole runs of letters, lower-cased, opened by the vocabulary's word mark; pieces
of every length take part. Words of up to ``BATCH_WORD`` letters are worked through many at
a time. Longer ones, as scripts without spaces have them, and those whose probability is
too small for that, go one by one through the same sums with a scale of their own at each
letter; memory there is a few numbers a letter. Letters that no piece has cost a constant.
Texts that are null or have no letter are ``und`` with score 0, as is everything where
no language could be learnt; an empty table gives no rows, and repeated rows a row each.
Equal likelihoods go to the first language by name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, mix64, slices

_RUN = re.compile(r"[^\W\d_]+")
_MARK = "▁"
#: Words of more letters are read one by one.
BATCH_WORD = 32
#: Below this, a sum of products of probabilities is taken again with scales.
_TINY = 1e-250
#: Letters of a long word whose pieces are looked up at a time.
_BLOCK = 65_536
#: Piece 0 stands for no piece, piece 1 for a letter the vocabulary lacks.
_NONE, _UNKNOWN = 0, 1


@dataclass(frozen=True)
class LanguageParams:
    smoothing: float = 0.05
    unknown: float = 1e-8
    kept_words: int = 200_000


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    probs: np.ndarray  # (pieces, languages)


def pieces_of(vocabulary: str) -> dict[str, int]:
    """Lower-case pieces of letters, with or without the word mark, numbered from 2."""
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    kept = [s for s in found if (b := s.removeprefix(_MARK)) == b.lower() and (b.isalpha() or s == _MARK)]
    return {s: i + 2 for i, s in enumerate(dict.fromkeys(kept))}


def words_of(text: str) -> list[str]:
    out = []
    for w in _RUN.findall(text.lower()):
        if not w.isalpha():  # numerals that count as word characters
            out += [x for x in re.split(r"\s+", "".join(c if c.isalpha() else " " for c in w)) if x]
        else:
            out.append(w)
    return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    by = defaultdict(list)
    for k, w in enumerate(words):
        by[len(w)].append(k)
    return by


class Pieces:
    """The vocabulary as an open-addressing table of rolling hashes, looked up for whole arrays."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]) -> None:
        self.size = len(pieces) + 2
        self.longest = max(map(len, pieces), default=1)
        bits = 2 + max(8, len(pieces).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.ids = np.zeros((1 << bits) + 64, dtype=np.uint64), np.zeros((1 << bits) + 64, dtype=np.int32)
        self.probes = 1
        by = _by_length(list(pieces))
        for n, at in by.items():
            names = [s for s in pieces if len(s) == n]
            codes = np.array(names, dtype=f"U{n}").view(np.uint32).reshape(len(at), n).T.astype(np.uint64)
            h = np.zeros(len(at), dtype=np.uint64)
            for row in codes:
                h = self.step(h, row)
            for s, x in zip(names, mix64(h), strict=True):
                slot = int(x >> self.shift)
                probe = 0
                while self.keys[slot + probe]:
                    probe += 1
                self.keys[slot + probe], self.ids[slot + probe] = x, pieces[s]
                self.probes = max(self.probes, probe + 1)

    def step(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h + code + np.uint64(1)) * self._BASE

    def look_up(self, rolled: np.ndarray, missing: int) -> np.ndarray:
        h = mix64(rolled)
        at = (h >> self.shift).astype(np.int64)
        out = np.full(h.shape, missing, dtype=np.int32)
        for probe in range(self.probes):
            hit = self.keys[at + probe] == h
            out[hit] = self.ids[at[hit] + probe]
        return out


@lru_cache(maxsize=2)
def vocabulary_table(vocabulary: str) -> Pieces:
    """Built once a Python worker."""
    return Pieces(pieces_of(vocabulary))


def _lattice(words: list[str], pieces: Pieces) -> tuple[int, dict[tuple[int, int], np.ndarray]]:
    """For marked words of one length: the piece that each (start, length) spells in each word.

    Cells that no word has a piece for are left out.
    """
    n = len(words[0]) + 1
    codes = np.array([_MARK + w for w in words], dtype=f"U{n}").view(np.uint32).reshape(len(words), n).T.astype(np.uint64)
    cells = {}
    rolled = np.zeros((n, len(words)), dtype=np.uint64)
    for size in range(1, min(pieces.longest, n) + 1):
        rolled = pieces.step(rolled[: n - size + 1], codes[size - 1 :])
        ids = pieces.look_up(rolled, _UNKNOWN if size == 1 else _NONE)
        for i in range(n - size + 1):
            if size == 1 or ids[i].any():
                cells[i, size] = ids[i]
    return n, cells


def forward(n: int, cells: dict[tuple[int, int], np.ndarray], probs: np.ndarray) -> list[np.ndarray]:
    """Probability of each prefix, summed over its segmentations: (words, columns of probs)."""
    w = len(cells[0, 1])
    alpha = [np.ones((w, probs.shape[1]))]
    for end in range(1, n + 1):
        a = np.zeros((w, probs.shape[1]))
        for i in range(end):
            if (i, end - i) in cells:
                a += alpha[i] * probs[cells[i, end - i]]
        alpha.append(a)
    return alpha


def _endings(codes: np.ndarray, pieces: Pieces) -> Iterator[list[tuple[int, int]]]:
    """For each end of a marked word, the (length, piece) of all pieces that end there, in blocks of bounded size."""
    n, longest = len(codes), pieces.longest
    for at in range(0, n, _BLOCK):
        first = max(0, at - longest + 1)
        own = codes[first : at + _BLOCK]
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(own))]
        rolled = np.zeros(len(own), dtype=np.uint64)
        for size in range(1, min(longest, len(own)) + 1):
            rolled = pieces.step(rolled[: len(own) - size + 1], own[size - 1 :])
            ids = pieces.look_up(rolled, _UNKNOWN if size == 1 else _NONE)
            for k in np.flatnonzero(ids):
                found[k + size - 1].append((size, int(ids[k])))
        yield from found[at - first :]


def _codes(word: str) -> np.ndarray:
    return np.frombuffer((_MARK + word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def log_forward(word: str, probs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log of the forward probability of one word of any length, a column for each of ``probs``."""
    ring = np.zeros((pieces.longest + 1, probs.shape[1]))  # sums up to the latest ends, over exp(log_scale)
    ring[0] = 1.0
    log_scale = np.zeros(probs.shape[1])
    for end, here in enumerate(_endings(_codes(word), pieces), start=1):
        a = np.zeros(probs.shape[1])
        for size, piece in here:
            a += ring[(end - size) % len(ring)] * probs[piece]
        ring[end % len(ring)] = a
        if a.min() < 1e-100:
            ring /= a
            log_scale += np.log(a)
    return np.log(ring[(len(word) + 1) % len(ring)]) + log_scale


def _expected_of_long(word: str, count: float, pieces: Pieces, flat: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected piece counts of one word of any length to ``out``.

    ``share[e]`` is the forward sum up to letter e over that up to letter e - 1, so that ratios of
    forward sums are products of few numbers; going back, ``beta`` holds the expected visits of ends.
    """
    weights = flat[:, 0]
    codes = _codes(word)
    n = len(codes)
    share = np.ones(n + 1)
    for end, here in enumerate(_endings(codes, pieces), start=1):
        total = 0.0
        for size, piece in here:
            total += weights[piece] / np.prod(share[end - size + 1 : end])
        share[end] = total
    # backwards, block by block: the visit of an end is dealt to its last pieces by their part in its sum
    visits = np.zeros(n + 1)
    visits[n] = count
    for to in range(n, 0, -_BLOCK):
        at = max(0, to - _BLOCK)
        first = max(0, at - pieces.longest + 1)
        ends = list(_endings(codes[first:to], pieces))
        for end in range(to, at, -1):
            if not visits[end]:
                continue
            for size, piece in ends[end - first - 1]:
                part = visits[end] * weights[piece] / np.prod(share[end - size + 1 : end + 1])
                out[piece] += part
                visits[end - size] += part


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, p: LanguageParams) -> np.ndarray:
    """Expected piece counts of weighted words, over all segmentations under equal piece weights."""
    size = pieces.size
    flat = np.full((size, 1), 1.0 / size)
    flat[_NONE], flat[_UNKNOWN] = 0.0, p.unknown
    out = np.zeros(size)
    for length, at in _by_length(words).items():
        if length > BATCH_WORD:
            for k in at:
                _expected_of_long(words[k], counts[k], pieces, flat, out)
            continue
        for k in range(0, len(at), 4096):
            own = at[k : k + 4096]
            n, cells = _lattice([words[j] for j in own], pieces)
            alpha = forward(n, cells, flat)
            beta = [np.zeros((len(own), 1)) for _ in range(n)] + [np.ones((len(own), 1))]
            for i in range(n - 1, -1, -1):
                for m in range(1, min(pieces.longest, n - i) + 1):
                    if (i, m) in cells:
                        beta[i] += flat[cells[i, m]] * beta[i + m]
            each = counts[own] / alpha[n][:, 0]
            for (i, m), ids in cells.items():
                out += np.bincount(ids, weights=each * alpha[i][:, 0] * flat[ids, 0] * beta[i + m][:, 0], minlength=size)
    return out


def fit_languages(docs: DataFrame, vocabulary: str, p: LanguageParams, learn: Column) -> LanguageModel:
    """Learns from all rows that satisfy ``learn``; one row a language and piece reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary_table(vocabulary)
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(pieces.size))
        held: dict[str, Counter] = defaultdict(Counter)

        def flush() -> None:
            for lang, words in held.items():
                total[lang] += expected_counts(list(words), np.fromiter(words.values(), dtype=np.float64), pieces, p)
            held.clear()

        for rows, texts in slices(batches):
            for lang, t in zip(rows.column(0).to_pylist(), texts, strict=True):
                held[lang].update(words_of(t.decode()))
            if sum(map(len, held.values())) > p.kept_words:
                flush()
        flush()
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["lang", "piece", "n"])

    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    got = known.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    lang, piece, n = (got.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "piece", "n"))
    languages = sorted(set(lang))
    size = vocabulary_table(vocabulary).size
    c = np.zeros((size, len(languages)))
    c[piece, [languages.index(x) for x in lang]] = np.round(n, 6)
    c[[_NONE, _UNKNOWN]] = 0
    probs = (c + p.smoothing) / (c.sum(axis=0) + p.smoothing * size)
    probs[_NONE], probs[_UNKNOWN] = 0.0, p.unknown
    return LanguageModel(languages, probs)


def word_log_likelihoods(words: list[str], model: LanguageModel, pieces: Pieces) -> np.ndarray:
    out = np.empty((len(words), len(model.languages)))
    for length, at in _by_length(words).items():
        for k in range(0, len(at), 4096):
            own = np.array(at[k : k + 4096])
            if length <= BATCH_WORD:
                n, cells = _lattice([words[j] for j in own], pieces)
                total = forward(n, cells, model.probs)[n]
                out[own] = np.log(np.maximum(total, _TINY))
                own = own[(total < _TINY).any(axis=1)]
            for j in own:
                out[j] = log_forward(words[j], model.probs, pieces)
    return out


def score_languages(docs: DataFrame, model: LanguageModel, vocabulary: str, p: LanguageParams = LanguageParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pieces = shared.value, vocabulary_table(vocabulary)
        at: dict[str, int] = {}
        logs = np.empty((0, len(m.languages)))
        for rows, texts in slices(batches):
            words = [words_of(t.decode()) if t and m.languages else [] for t in texts]
            if len(at) > p.kept_words:
                at, logs = {}, logs[:0]
            new = list({w for ws in words for w in ws}.difference(at))
            if new:
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                logs = np.concatenate([logs, word_log_likelihoods(new, m, pieces)])
            pred, score = [], []
            for ws in words:
                if not ws:
                    pred.append("und")
                    score.append(0.0)
                    continue
                s = logs[np.fromiter(map(at.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
                k = int(np.argmax(s))
                pred.append(m.languages[k])
                score.append(float(1 / np.exp(s - s[k]).sum()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double")


def identify_language(docs: DataFrame, vocabulary: str | None = None, p: LanguageParams = LanguageParams()) -> DataFrame:
    """Learns outside the held-out fold, predicts every document."""
    vocabulary = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    model = fit_languages(docs, vocabulary, p, fold("doc_id", 3) != 1)
    return score_languages(docs, model, vocabulary, p).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
