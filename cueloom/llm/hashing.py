"""Hashed word features for the linear text models."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import mix64

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME = "\x00same"
_SHOUT = "\x00shout"
LENGTH_MARKS = [f"\x00length{k}" for k in range(24)]


class TokenHashes(dict):
    """64-bit hashes of tokens, kept for reuse; emptied when it has grown to ``limit``."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def tokens_of(text: str) -> list[str]:
    """Lower-cased words and runs of symbols."""
    return _TOKEN.findall(text.lower())


def ngram_features(text: str, cache: TokenHashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indices and L2-normalised counts of hashed word 1- and 2-grams.

    A token equal to the one before it is read as a marker of repetition, and a word in
    capitals is followed by a marker, so that the grams see both whatever the word.
    """
    low = tokens_of(text)
    if not low:
        return np.empty(0, dtype=np.int64), np.empty(0)
    raw = cache.of(low)
    h = raw.copy()
    h[1:][raw[1:] == raw[:-1]] = cache[_SAME]
    shouts = sum(1 for w in text.split() if len(w) > 1 and w.isupper())
    pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    grams = np.concatenate([h, pairs, np.full(shouts, cache[_SHOUT], dtype=np.uint64)])
    idx, n = np.unique((mix64(grams) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    v = np.sqrt(n.astype(np.float64))
    return idx, v / np.sqrt((v * v).sum())


def presence_features(text: str, cache: TokenHashes, bits: int, prefixes: tuple[int, ...]) -> np.ndarray:
    """Sorted indices of the hashed words of a text, of their prefixes, and of its length.

    The length is told by one marker for each power of two that the number of words reaches.
    """
    words = set(tokens_of(text))
    if not words:
        return np.empty(0, dtype=np.int64)
    grams = [*words, *LENGTH_MARKS[: len(words).bit_length()]]
    for n in prefixes:
        grams += {f"{w[:n]}\x00{n}" for w in words if len(w) > n}
    return np.unique((mix64(cache.of(grams)) >> np.uint64(64 - bits)).astype(np.int64))


class WantedFeatures(dict):
    """The wanted features among those of a token, as ``presence_features`` has them, kept for reuse."""

    def __init__(self, wanted: np.ndarray, prefixes: tuple[int, ...], limit: int = 400_000) -> None:
        """``wanted`` is a mask of ``2**bits`` features."""
        super().__init__()
        self.wanted, self.prefixes, self.limit = wanted, prefixes, limit
        self.shift = np.uint64(64 - (len(wanted).bit_length() - 1))
        marks = mix64(np.array([xxhash.xxh3_64_intdigest(m) for m in LENGTH_MARKS], dtype=np.uint64)) >> self.shift
        self.marks = [(int(f),) if wanted[f] else () for f in marks.astype(np.int64)]

    def learn(self, tokens: list[str]) -> None:
        """Finds the wanted features of many tokens at once; most have none."""
        parts, owners = [tokens], [np.arange(len(tokens))]
        for n in self.prefixes:
            longer = [k for k, w in enumerate(tokens) if len(w) > n]
            parts.append([f"{tokens[k][:n]}\x00{n}" for k in longer])
            owners.append(np.array(longer, dtype=np.int64))
        grams = [g for part in parts for g in part]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, grams), dtype=np.uint64, count=len(grams))
        at = (mix64(h) >> self.shift).astype(np.int64)
        hit = self.wanted[at]
        self.update(dict.fromkeys(tokens, ()))
        for k, f in zip(np.concatenate(owners)[hit].tolist(), at[hit].tolist(), strict=True):
            self[tokens[k]] += (f,)

    def of(self, texts: list[bytes | None]) -> list[list[int]]:
        """Sorted wanted features of each text; memory is that of the texts' tokens and the kept ones."""
        words = [set(tokens_of((t or b"").decode())) for t in texts]
        if len(self) > self.limit:
            self.clear()
        self.learn(list(set().union(*words).difference(self)))
        return [sorted(set().union(*map(self.__getitem__, ws), *self.marks[: len(ws).bit_length()])) for ws in words]
