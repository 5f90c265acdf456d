"""Similarity links between sets, from buckets of signature keys to components.

Every two nodes that share a bucket are candidates, but they are never all listed:

1. coarse components are made of candidates that sketches or signatures allow. Rows of a
   bucket are streamed past its leaders: a row close to a leader is taken in by it, others
   become leaders, and as distances obey the triangle inequality a row that may be similar
   to one that was taken in is as well found from its leader. Only as many pairs are given
   as it takes to connect a bucket, and only leaders are held. Buckets of few sketches are
   connected by trees instead, many at once;
2. each coarse component is dealt over blocks of bounded size, which share a few pivots,
   and all pairs of a block are compared on their full sets;
3. what is then still apart from the largest part of its coarse component is compared with
   all of it, block by block.

Two linked nodes that share a bucket and are under the distance are in one coarse
component, and there they are compared or already connected; so the final components are
those of all candidate pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_batches, mix64
from .components import connected_components

#: Shingles that are hashed at a time, and bytes of short lines that are joined.
_BLOCK, _JOINED = 65_536, 131_072


@dataclass(frozen=True)
class LinkSpec:
    """How texts become sets, and when two sets are linked.

    ``symbols`` min-hash values of 16 bits make a signature. Linked are sets with
    ``100 * intersection >= percent * union``. Where ``by_size`` holds, ``n`` is the exact
    size of a set and rules pairs out; else it is only an estimate of the work. ``many``
    does what ``shingles`` does for many texts at once.
    """

    shingles: Callable[[bytes], np.ndarray]
    symbols: int
    max_distance: int
    percent: int = 80
    unpack: Callable[[bytes], bytes] = zlib.decompress
    by_size: bool = True
    many: Callable[[list[bytes]], list[np.ndarray]] | None = None

    def sets(self, packed: list[bytes]) -> list[np.ndarray]:
        """The sets of packed texts."""
        texts = [self.unpack(z) for z in packed]
        return self.many(texts) if self.many else [self.shingles(t) for t in texts]


class WordHashes(dict):
    """64-bit hashes of byte words, emptied when it has grown to ``limit``."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_shingles(text: bytes, size: int, cache: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words (A-Z lower-cased); fewer words are one run."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    cache = WordHashes() if cache is None else cache
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    acc = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(acc)])
    return np.unique(acc)


#: Code points of a character shingle.
SHINGLE_CHARS = 5
_GAP = b"\0" * 8
_ODD = np.random.default_rng(5).integers(0, 2**63, SHINGLE_CHARS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _byte_words(data: bytes) -> np.ndarray:
    """The 8 bytes from every place of the data on, as integers; zeros follow the data."""
    padded = np.frombuffer(data + _GAP, dtype=np.uint8)
    return np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))


def _scrambled(w: np.ndarray) -> np.ndarray:
    """A one-to-one hash of machine words whose upper half depends on every bit."""
    part = w >> np.uint64(32)
    w = np.bitwise_xor(w, part)
    w *= np.uint64(0x9E3779B97F4A7C15)
    w ^= np.right_shift(w, np.uint64(29), out=part)
    w *= np.uint64(0xBF58476D1CE4E5B9)
    return w


def _char_runs(data: bytes) -> np.ndarray:
    """A hash of the 5 code points from every code point of the data on; zeros follow the data."""
    if data.isascii():
        return _scrambled(_byte_words(data) & np.uint64((1 << 8 * SHINGLE_CHARS) - 1))
    text = data.decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass") + b"\0" * 4 * SHINGLE_CHARS, dtype="<u4").astype(np.uint64)
    n = len(points) - SHINGLE_CHARS
    packed = points[:n].copy()
    for i in range(1, SHINGLE_CHARS):
        packed |= points[i : i + n] << np.uint64(8 * i)
    # what holds more than ASCII does not fit one word: a multiply-add hash of its code points
    mark = np.zeros(n + SHINGLE_CHARS, dtype=bool)
    beyond = np.flatnonzero(points[:n] > 127)
    for i in range(SHINGLE_CHARS):
        mark[(beyond - i)[beyond >= i]] = True
    at = np.flatnonzero(mark[:n])
    mixed = np.full(len(at), SHINGLE_CHARS, dtype=np.uint64)
    for i in range(SHINGLE_CHARS):
        mixed += points[at + i] * _ODD[i]
    packed[at] = mix64(mixed)
    return _scrambled(packed)


def byte_shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of runs of 5 code points of UTF-8 bytes; a shorter text is one run."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    h = _char_runs(text)
    h = np.sort(h[: max(1, len(h) - SHINGLE_CHARS + 1)])
    return h[np.append(True, h[1:] != h[:-1])]


def _joined_runs(lines: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, hashes, begin, n): some lines at a time, of lines that are not empty; each one's shingles are ``hashes[begin : begin + n]``."""
    plain = np.fromiter(map(bytes.isascii, lines), dtype=bool, count=len(lines))
    length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    for at in (np.flatnonzero(plain), np.flatnonzero(~plain)):
        if not len(at):
            continue
        # some lines at a time, so that what is made of them stays in the cache
        for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(length[at]) // _JOINED)) + 1):
            own = [lines[k] for k in some.tolist()]
            data = _GAP.join(own)
            h = _char_runs(data)
            sizes = length[some]
            if not plain[some[0]]:
                # code points are the bytes that do not continue one, unless there are broken ones
                heads = np.append(0, np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))
                ends = np.cumsum(sizes + len(_GAP)) - len(_GAP)
                sizes = heads[ends] - heads[ends - sizes]
                if int(sizes.sum()) + len(_GAP) * (len(own) - 1) != len(h):
                    sizes = np.fromiter((len(x.decode("utf-8", "surrogateescape")) for x in own), dtype=np.int64, count=len(own))
            # a line's shingles start at its first places; those that run into the next line are left out
            yield some, h, np.cumsum(np.append(0, sizes[:-1] + len(_GAP))), np.maximum(1, sizes - SHINGLE_CHARS + 1)


def byte_shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """``byte_shingles`` of many texts."""
    out = [np.empty(0, dtype=np.uint64)] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    for some, h, begin, n in _joined_runs([texts[k] for k in full]):
        for k, x, m in zip(some.tolist(), begin.tolist(), n.tolist(), strict=True):
            h[x : x + m].sort()
        fresh = np.append(True, h[1:] != h[:-1])
        fresh[begin] = True
        for k, x, m in zip(some.tolist(), begin.tolist(), n.tolist(), strict=True):
            out[full[k]] = h[x : x + m][fresh[x : x + m]]
    return out


def byte_signatures(lines: list[bytes], symbols: int) -> np.ndarray:
    """Signatures of the shingles of many lines that are not empty, from one pass over each kind of line."""
    out = np.empty((len(lines), symbols), dtype=np.uint16)
    for some, h, begin, n in _joined_runs(lines):
        left = np.append(begin[1:], len(h)) - begin - n
        whole = np.ones(len(h), dtype=bool)
        whole[np.repeat(begin + n - np.cumsum(left) + left, left) + np.arange(int(left.sum()))] = False
        h >>= np.uint64(32)
        out[some] = _signatures(h.astype(np.uint32)[whole], np.cumsum(np.append(0, n[:-1])), symbols)
    return out


def _signatures(h: np.ndarray, starts: np.ndarray, symbols: int) -> np.ndarray:
    """Min-hash values of 16 bits of the runs of ``h`` that begin at ``starts``; no run is empty."""
    rng = np.random.default_rng(20_011)
    salt = rng.integers(0, 2**32, symbols, dtype=np.uint32)
    odd = rng.integers(0, 2**31, symbols, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.empty((symbols, len(starts)), dtype=np.uint32)
    held = np.empty(min(len(h), _BLOCK), dtype=np.uint32)
    at = 0
    while at < len(starts):
        # a block of runs that fits the cache; a longer run is a block of its own
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK, side="right")) - 1)
        to = len(starts) if to >= len(starts) - 1 and len(h) - starts[at] <= _BLOCK else min(to, len(starts))
        part = h[starts[at] : starts[to] if to < len(starts) else len(h)]
        runs = starts[at:to] - starts[at]
        x = held[: len(part)] if len(part) <= len(held) else np.empty(len(part), dtype=np.uint32)
        for s in range(symbols):
            np.bitwise_xor(part, salt[s], out=x)
            np.multiply(x, odd[s], out=x)
            np.minimum.reduceat(x, runs, out=least[s, at:to])
        at = to
    least *= np.uint32(0x9E3779B1)
    return np.ascontiguousarray((least >> np.uint32(16)).astype(np.uint16).T)


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """Min-hash values of 16 bits, one row a set; empty sets get zeros."""
    out = np.zeros((len(sets), symbols), dtype=np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        h = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
        out[full] = _signatures(h, np.cumsum([0, *(len(sets[k]) for k in full[:-1])]), symbols)
    return out


def chunk_masks(symbols: int, chunk: int, max_distance: int) -> list[tuple[int, ...]]:
    """The columns of every multi-index key, by the general pigeonhole principle.

    The signature is split into chunks; chunk i may have ``e_i`` errors, with the
    ``e_i + 1`` adding up to ``max_distance + 1``. Two signatures that differ in at most
    ``max_distance`` symbols then agree, in some chunk, but for at most ``e_i`` symbols;
    every way to leave ``e_i`` of them out makes a key.
    """
    n = symbols // chunk
    base, extra = divmod(max_distance + 1, n)
    keys = []
    for c in range(n):
        errors = base + (c < extra) - 1
        columns = range(c * chunk, (c + 1) * chunk)
        if 0 <= errors < chunk:
            keys += [tuple(x for x in columns if x not in gone) for gone in combinations(columns, errors)]
        elif errors >= chunk:
            raise ValueError("chunks are too short for the distance")
    return keys


def keys_of(sig: np.ndarray, masks: list[tuple[int, ...]]) -> np.ndarray:
    """One 64-bit key for each mask, (rows, masks)."""
    wide = sig.astype(np.uint64)
    out = np.empty((len(sig), len(masks)), dtype=np.uint64)
    for k, columns in enumerate(masks):
        acc = np.full(len(sig), k + 1, dtype=np.uint64)
        for c in columns:
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + wide[:, c])
        out[:, k] = acc
    return out.view(np.int64)


#: Slots of the membership bitmap: 8 MB, whatever the number of members.
BITMAP_BITS = 26


def membership_bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the slots that the one column of 64-bit hashes fills.

    It only spares rows a shuffle: what it lets through is joined exactly. It has a fixed
    size; with very many members it fills up and spares less.
    """
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(1 << BITMAP_BITS))
    words = hashes.select(F.floor(slot / 64).cast("int").alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def may_be_member(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.int64) & ((1 << BITMAP_BITS) - 1)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def buckets(members: DataFrame) -> DataFrame:
    """(key, hub, node): every node but the smallest of each bucket of ``members(key, node)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # key, hub, node
        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            prev_key, prev_node = np.roll(key, 1), np.roll(node, 1)
            first = key != prev_key
            first[0] = last is None or key[0] != last[0]
            at = np.where(first, np.arange(len(key)), -1)
            at = np.maximum.accumulate(at)
            hub = np.where(at >= 0, node[at], last[1] if last else 0)
            again = node == prev_node
            again[0] = last is not None and node[0] == last[2]
            keep = ~first & ~again
            last = int(key[-1]), int(hub[-1]), int(node[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(hub[keep]), pa.array(node[keep])], names=["key", "hub", "node"])

    return members.select("key", "node").repartition("key").sortWithinPartitions("key", "node").transform(in_batches, run, "key long, hub long, node long")


def _sig_matrix(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, symbols)


def _allowed(n_a, n_b, spec: LinkSpec):
    """Sizes that the similarity does not rule out."""
    if not spec.by_size:
        return np.ones(np.broadcast(n_a, n_b).shape, dtype=bool)
    return (100 * np.minimum(n_a, n_b) >= spec.percent * np.maximum(n_a, n_b)) & (np.minimum(n_a, n_b) > 0)


def under_distance(pairs: DataFrame, sigs: DataFrame, spec: LinkSpec) -> DataFrame:
    """The ``pairs(a, b)`` that sizes and signatures of ``sigs(node, n, sig)`` do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n_a, n_b = b.column(2).to_numpy(), b.column(4).to_numpy()
            far = (_sig_matrix(b.column(3), spec.symbols) != _sig_matrix(b.column(5), spec.symbols)).sum(axis=1)
            ok = _allowed(n_a, n_b, spec) & (far <= spec.max_distance)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    left = sigs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "sig_a", "n_b", "sig_b").transform(in_batches, run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The rows of each key of sorted batches as columns, the key being the first ``keys`` columns."""
    held: list[list] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_pylist() for c in batch.columns]
        own = list(zip(*cols[:keys], strict=True))
        at = 0
        for end in [*(k for k in range(1, len(own)) if own[k] != own[k - 1]), len(own)]:
            if held and own[at] != last:
                yield held
                held = []
            part = [c[at:end] for c in cols]
            held = [x + y for x, y in zip(held, part, strict=True)] if held else part
            last, at = own[at], end
    if held:
        yield held


def bucket_links(found: DataFrame, comps: DataFrame, sigs: DataFrame, spec: LinkSpec) -> DataFrame:
    """(a, b): links that sizes and signatures allow, between components that meet in a bucket.

    Of all such pairs of a bucket, only as many are given as it takes to connect it. Rows
    are streamed past leaders (see the module), which alone are held.
    """
    most, absorb = spec.max_distance, spec.max_distance // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        nodes = sizes = roots = radius = np.empty(0, dtype=np.int64)
        values = np.empty((0, spec.symbols), dtype=np.uint16)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, root, n = (batch.column(i).to_numpy() for i in range(4))
            sig = _sig_matrix(batch.column(4), spec.symbols)
            a, b = [], []
            for k in range(len(key)):
                if key[k] != last:
                    last, held, parent = key[k], 0, {}
                best = most + 1
                if held:
                    far = (values[:held] != sig[k]).sum(axis=1)
                    # sizes tell nothing about what a leader has taken in
                    near = np.flatnonzero((far <= most + radius[:held]) & (_allowed(sizes[:held], n[k], spec) | (radius[:held] > 0)))
                    own = find(int(root[k]))
                    for j in near:
                        other = find(int(roots[j]))
                        if other != own:
                            a.append(int(nodes[j]))
                            b.append(int(node[k]))
                            parent[max(own, other)] = own = min(own, other)
                    if len(near):
                        at = near[np.argmin(far[near])]
                        best = far[at]
                if best <= absorb:
                    radius[at] = max(radius[at], best)
                    continue
                if held == len(nodes):
                    more = max(64, held)
                    nodes, sizes, roots, radius = (np.append(x[:held], np.zeros(more, dtype=np.int64)) for x in (nodes, sizes, roots, radius))
                    values = np.concatenate([values[:held], np.zeros((more, spec.symbols), dtype=np.uint16)])
                nodes[held], sizes[held], roots[held], radius[held], values[held] = node[k], n[k], root[k], 0, sig[k]
                held += 1
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = found.select("key", "node").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rows = placed.join(split, "key").join(sigs, "node").select("key", "node", "root", "n", "sig")
    return rows.repartition("key").sortWithinPartitions("key", "node").transform(in_batches, run, "a long, b long").distinct()


#: Bits in which the sketches of candidates may differ, and within which a leader takes a row in.
SKETCH_DISTANCE, SKETCH_ABSORB = 16, 6
#: Bits in which sketches of rows may differ that are compared in blocks.
SKETCH_CLOSE = 13


def sketches(sig: np.ndarray) -> np.ndarray:
    """64 bits of each signature of 48 symbols: their lowest bits, and the next bits of the first 16.

    Sets at a similarity of 0.8 differ in 6 bits on average, and in over 16 with
    probability 0.0002; sets that share next to nothing differ in 30.
    """
    bits = np.concatenate([sig[:, :48] & 1, (sig[:, :16] >> 1) & 1], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).ravel()


class _Leaders:
    """The leaders of one bucket, by sketch: node, sketch, radius and label."""

    def __init__(self) -> None:
        self.node: list[int] = []
        self.sketch = np.empty(0, dtype=np.uint64)
        self.radius = np.empty(0, dtype=np.int64)
        self.label = np.empty(0, dtype=np.int64)

    def feed(self, node: list[int], sketch: np.ndarray, out: list[tuple]) -> None:
        """Appends (leader, node, their sketches), one for each part of the bucket that a row may belong to."""
        for x, s in zip(node, sketch, strict=True):
            n = len(self.node)
            if n:
                far = np.bitwise_count(self.sketch[:n] ^ s).astype(np.int64)
                near = np.flatnonzero(far <= SKETCH_DISTANCE + self.radius[:n])
                if len(near):
                    near = near[np.argsort(far[near], kind="stable")]
                    labels, first = np.unique(self.label[near], return_index=True)
                    out += [(self.node[j], x, int(self.sketch[j]), int(s)) for j in near[first]]
                    if len(labels) > 1:
                        self.label[:n][np.isin(self.label[:n], labels)] = labels[0]
                    at = near[0]
                    if far[at] <= SKETCH_ABSORB:
                        self.radius[at] = max(self.radius[at], far[at])
                        continue
                label = labels[0] if len(near) else n
            else:
                label = 0
            if n == len(self.sketch):
                self.sketch, self.radius, self.label = (np.append(v, np.zeros(max(8, n), dtype=v.dtype)) for v in (self.sketch, self.radius, self.label))
            self.node.append(x)
            self.sketch[n], self.radius[n], self.label[n] = s, 0, label


#: A row of a cell: the upper half of its key, its node and its sketch.
_ROW = np.dtype([("key", "<u4"), ("node", "<i8"), ("sketch", "<u8")])
#: Rows that are packed at a time, and rows of one cell that are held at most.
PACK_ROWS, CELL_ROWS = 1_000_000, 4_000_000
#: Packed pieces of cells that are unpacked at a time.
_PIECES = 1024


def cells_of(spark: SparkSession) -> int:
    """Cells that keys are dealt over: a power of two, and several a shuffle partition."""
    return 1 << max(12, (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def packed_cells(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], cells: int) -> Iterator[pa.RecordBatch]:
    """(cell, rows) of arrays of keys, nodes and sketches: of each cell, the lowest bits of a key, one binary of many rows.

    So a shuffle moves a few large rows instead of very many small ones. Of a key its cell
    and its upper 32 bits stay. Keys are hashes; two that are the same in these 44 bits and
    more share a bucket, whose rows sketches part.
    """

    def pack(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        cell = (key & (cells - 1)).astype(np.uint16 if cells <= 1 << 16 else np.uint32)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        rows = np.empty(len(key), dtype=_ROW)
        rows["key"], rows["node"], rows["sketch"] = key.view(np.uint64)[order] >> np.uint64(32), node[order], sketch.view(np.uint64)[order]
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        ends = (np.append(begin, len(key)) * _ROW.itemsize).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(cell[begin].astype(np.int32)), data], names=["cell", "rows"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= PACK_ROWS:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
            for at in range(0, len(whole[0]), PACK_ROWS):
                yield pack(*(x[at : at + PACK_ROWS] for x in whole))
    if n:
        yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))


_LINKS = ["key", "a", "b", "sketch_a", "sketch_b", "far"]


def _pair_batch(key: np.ndarray, a, b, u, v) -> pa.RecordBatch:
    u, v = np.asarray(u, dtype=np.uint64), np.asarray(v, dtype=np.uint64)
    beyond = np.bitwise_count(u ^ v) > SKETCH_CLOSE
    far = np.isin(key, key[beyond]) if beyond.any() else beyond
    cols = [key.view(np.int64), np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64), u.view(np.int64), v.view(np.int64), far]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_LINKS)


#: Rows of a bucket up to which many buckets are connected at once, and distances that are then held.
_SMALL, _DISTANCES = 128, 1 << 20


def _forests(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j): in each row of sketches, pairs that connect those within ``SKETCH_DISTANCE``.

    A pair is only beyond ``SKETCH_CLOSE`` where close ones do not connect its parts.
    """
    rows, m = sketch.shape
    far = np.bitwise_count(sketch[:, :, None] ^ sketch[:, None, :])
    close = far <= SKETCH_CLOSE
    place = np.arange(m, dtype=np.uint8)
    label = np.broadcast_to(place, (rows, m))
    while True:  # the first place that close pairs lead to
        lower = np.where(close, label[:, None, :], np.uint8(m)).min(axis=2)
        if (lower == label).all():
            break
        label = lower
    out = []
    reached = label == place
    while True:  # from these places on, a tree of each part
        edge = close & reached[:, None, :]
        r, j = np.nonzero(edge.any(axis=2) & ~reached)
        if not len(r):
            break
        out.append(np.stack([r, edge[r, j].argmax(axis=1), j]))
        reached[r, j] = True
    r, i, j = np.nonzero(np.triu((far <= SKETCH_DISTANCE) & (label[:, :, None] != label[:, None, :])))
    if len(r):
        parts = np.stack([r, label[r, i], label[r, j]])
        _, first = np.unique(np.ravel_multi_index(tuple(parts), (rows, m, m)), return_index=True)
        up: dict[tuple[int, int], tuple[int, int]] = {}

        def top(x: tuple[int, int]) -> tuple[int, int]:
            while x in up:
                x = up[x]
            return x

        kept = []
        for k, x, u, v in zip(first.tolist(), *parts[:, first].tolist(), strict=True):
            a, b = top((x, u)), top((x, v))
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append(k)
        out.append(np.stack([r[kept], i[kept], j[kept]]))
    r, i, j = np.concatenate(out, axis=1) if out else np.empty((3, 0), dtype=np.int64)
    return r, i, j


def _bucket_pairs(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch | None:
    """The pairs that connect what sketches allow, of whole buckets in any order."""
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    several = np.append(False, same) | np.append(same, False)
    key, order = key[several], order[several]  # most buckets are of one row
    order = order[by := np.lexsort((node[order], key))]
    key, node, sketch = key[by], node[order], sketch[order]
    fresh = np.ones(len(key), dtype=bool)  # several tasks may give the same row
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, sketch = key[fresh], node[fresh], sketch[fresh]
    if not len(key):
        return None
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    # most buckets are all like their first, or else have no close pair but with it
    first = np.repeat(begin, size)
    near = np.bitwise_count(sketch ^ sketch[first]) <= SKETCH_DISTANCE
    alike = np.logical_and.reduceat(near, begin) | (size <= 2)
    for m in range(3, 9):
        for some in (at[k : k + 4096] for at in [np.flatnonzero(~alike & (size == m))] for k in range(0, len(at), 4096)):
            others = sketch[begin[some][:, None] + np.arange(1, m)]
            i, j = np.triu_indices(m - 1, 1)
            alike[some] = ~(np.bitwise_count(others[:, i] ^ others[:, j]) <= SKETCH_DISTANCE).any(axis=1)
    rest = np.flatnonzero(np.repeat(alike, size) & near & (np.arange(len(key)) != first))
    # pairs by place: those with a bucket's first, and those of small buckets
    left, right = [first[rest]], [rest]
    for m in np.unique(size[~alike & (size <= _SMALL)]):
        small = np.flatnonzero(~alike & (size == m))
        for some in np.split(small, np.arange(0, len(small), max(1, _DISTANCES // (m * m)))[1:]):
            own = begin[some][:, None] + np.arange(m)
            r, i, j = _forests(sketch[own])
            left.append(own[r, i])
            right.append(own[r, j])
    left, right = np.concatenate(left), np.concatenate(right)
    out: list[tuple] = []
    keys: list[int] = []
    for r in np.flatnonzero(~alike & (size > _SMALL)):
        _Leaders().feed(node[begin[r] :][: size[r]].tolist(), sketch[begin[r] :][: size[r]], out)
        keys += [int(key[begin[r]])] * (len(out) - len(keys))
    if not (len(left) or out):
        return None
    x, y, u, v = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
    pairs = (np.append(w, np.array(z, dtype=w.dtype)) for w, z in ((node[left], x), (node[right], y), (sketch[left], u), (sketch[right], v)))
    return _pair_batch(np.append(key[left], np.array(keys, dtype=np.uint64)), *pairs)


def cell_links(packed: DataFrame) -> DataFrame:
    """(key, a, b, sketch_a, sketch_b, far): pairs that connect, in each bucket of ``packed(cell, rows)``, what sketches allow.

    ``far`` marks the buckets that hold a pair whose sketches are not close. Of a cell of
    more than ``CELL_ROWS`` rows, only the leaders of its buckets are held.
    """
    most = CELL_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # keys and rows of the last cell
        n = 0
        leaders: dict[int, _Leaders] = {}  # of its buckets, if it is a large one

        def led() -> Iterator[pa.RecordBatch]:
            for key, rows in held:
                for at in range(0, len(key), 100_000):
                    own = key[at : at + 100_000]
                    order = np.argsort(own, kind="stable")
                    part, own = rows[at : at + 100_000][order], own[order]
                    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    out: list[tuple] = []
                    keys: list[int] = []
                    for x, to in zip(begin, np.append(begin[1:], len(own)), strict=True):
                        leaders.setdefault(int(own[x]), _Leaders()).feed(part["node"][x:to].tolist(), part["sketch"][x:to], out)
                        keys += [int(own[x])] * (len(out) - len(keys))
                    kept = [(k, *x) for k, x in zip(keys, out, strict=True) if x[0] != x[1]]
                    if kept:
                        k, *pairs = (list(c) for c in zip(*kept, strict=True))
                        links = _pair_batch(np.array(k, dtype=np.uint64), *pairs)
                        # other pairs of a bucket may be in other batches
                        yield links.set_column(5, "far", pa.array(np.ones(len(k), dtype=bool)))

        def ended() -> Iterator[pa.RecordBatch]:
            if leaders:
                yield from led()
            elif held:
                key, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                if links := _bucket_pairs(key, rows["node"], rows["sketch"]):
                    yield links

        last = -1
        for whole in batches:
            for at in range(0, whole.num_rows, _PIECES):
                batch = whole.slice(at, _PIECES)
                cell, data = batch.column(0).to_numpy(), batch.column(1)
                ends = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]
                size = np.diff(ends) // _ROW.itemsize
                rows = np.frombuffer(data.buffers()[2], dtype=_ROW, count=int(size.sum()), offset=int(ends[0])).copy()
                key = rows["key"].astype(np.uint64) << np.uint64(32) | np.repeat(cell.astype(np.uint64), size)
                # rows of the cell that was begun, of whole cells, and of the one that goes on
                head = int(size[cell == last].sum())
                tail = int(size[cell == cell[-1]].sum())
                if head:
                    held.append((key[:head], rows[:head]))
                    n += head
                if cell[-1] != last:
                    yield from ended()
                    held, n, last = [], 0, int(cell[-1])
                    leaders.clear()
                    if head < len(key) - tail and (links := _bucket_pairs(key[head : len(key) - tail], rows["node"][head : len(key) - tail], rows["sketch"][head : len(key) - tail])):
                        yield links
                    held, n = [(key[len(key) - tail :], rows[len(key) - tail :])], tail
                if n > most:
                    yield from led()
                    held, n = [], 0
        yield from ended()

    return packed.repartition("cell").sortWithinPartitions("cell").transform(in_batches, run, "key long, a long, b long, sketch_a long, sketch_b long, far boolean")


def sketch_links(members: DataFrame) -> DataFrame:
    """``cell_links`` of ``members(key, node, sketch)``."""
    cells = cells_of(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed_cells((tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows), cells)

    return cell_links(members.select("key", "node", "sketch").transform(in_batches, run, "cell int, rows binary"))


def verified(pairs: DataFrame, texts: DataFrame, spec: LinkSpec) -> DataFrame:
    """The ``pairs(a, b)`` that are linked on the full sets of ``texts(node, z)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                rows = whole.slice(at, 1024)
                a, y, b, z = (c.to_pylist() for c in rows.columns)
                if len(sets) >= 4096:
                    sets.clear()
                new = {k: t for k, t in zip(a + b, y + z, strict=True) if k not in sets}
                sets.update(zip(new, spec.sets(list(new.values())), strict=True))
                ok = pa.array([_linked(sets[i], sets[j], spec.percent) for i, j in zip(a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(ok), rows.column(2).filter(ok)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("z").alias("z_a"))
    right = texts.select(F.col("node").alias("b"), F.col("z").alias("z_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "z_a", "b", "z_b").transform(in_batches, run, "a long, b long")


def cross_pairs(found: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b): all pairs of a bucket that sketches allow and that lie in different components.

    ``found`` is what ``sketch_links`` gives, ``comps`` what ``close_components`` does or
    more: a bucket without a far pair lies in one component, or in parts that sketches
    keep apart. Of a bucket only the rows outside of its commonest component are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        nodes = roots = np.empty(0, dtype=np.int64)
        held = np.empty(0, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, common, node, root, sketch = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            sketch = sketch.view(np.uint64)
            a, b = [], []
            for k in range(len(key)):
                if key[k] != last:
                    last, n = key[k], 0
                if n:
                    near = np.flatnonzero((np.bitwise_count(held[:n] ^ sketch[k]) <= SKETCH_DISTANCE) & (roots[:n] != root[k]))
                    if len(near):
                        a.append(np.minimum(nodes[near], node[k]))
                        b.append(np.maximum(nodes[near], node[k]))
                if not common[k]:
                    if n == len(nodes):
                        nodes, roots, held = (np.append(v, np.zeros(max(64, n), dtype=v.dtype)) for v in (nodes, roots, held))
                    nodes[n], roots[n], held[n] = node[k], root[k], sketch[k]
                    n += 1
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    found = found.where("far")
    rows = found.select("key", F.col("a").alias("node"), F.col("sketch_a").alias("sketch")).unionByName(found.select("key", F.col("b").alias("node"), F.col("sketch_b").alias("sketch"))).distinct()
    placed = cut(rows.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node")), few=True)
    top = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("parts"))
    split = placed.join(top.where("parts > 1"), "key").withColumn("common", F.col("root") == F.col("top"))
    dealt = split.select("key", "common", "node", "root", "sketch").repartition("key").sortWithinPartitions("key", "common", "node")
    return dealt.transform(in_batches, run, "a long, b long").distinct()


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    va, vb = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    vocab = np.intersect1d(va, vb, assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(vocab, flat)
        ok = at < len(vocab)
        ok[ok] = vocab[at[ok]] == flat[ok]
        return row[ok], at[ok]

    if not len(vocab):
        return out
    (ra, ca), (rb, cb) = places(a), places(b)
    for at in range(0, len(vocab), 4096):
        size = min(4096, len(vocab) - at)
        ma, mb = np.zeros((len(a), size), dtype=np.float32), np.zeros((len(b), size), dtype=np.float32)
        ka, kb = (ca >= at) & (ca < at + size), (cb >= at) & (cb < at + size)
        ma[ra[ka], ca[ka] - at] = 1
        mb[rb[kb], cb[kb] - at] = 1
        out += ma @ mb.T
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, have the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    met = np.concatenate([x, y])
    met.sort(kind="stable")  # merges the two sorted runs
    both = int(np.count_nonzero(met[1:] == met[:-1]))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


#: Rows of a tile of pairs, and pairs of a tile beyond which matrices are multiplied.
_TILE, _MANY = 512, 2_000


def exact_links(node: np.ndarray, block: np.ndarray, sets: list[np.ndarray], spec: LinkSpec, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links within one block, or between two, just enough to connect what is linked.

    Pairs that sizes or signatures rule out are not compared; those of one ``label`` are
    connected already.
    """
    if len(node) <= 4 and label is None:  # most components are this small
        within = block[0] == block[-1] and (block == block[0]).all()
        own = [(i, j) for i, j in combinations(range(len(node)), 2) if within or block[i] != block[j]]
        return [(int(node[i]), int(node[j])) for i, j in own if _linked(sets[i], sets[j], spec.percent)]
    label = np.arange(len(node)) if label is None else np.unique(label, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets])
    sides = [np.flatnonzero(block == x) for x in np.unique(block)]
    left, right = sides[0], sides[-1]
    sig = signatures(sets, spec.symbols) if len(node) > 4 else None
    for i in range(0, len(left), _TILE):
        for j in range(i if len(sides) == 1 else 0, len(right), _TILE):
            x, y = left[i : i + _TILE], right[j : j + _TILE]
            if len(np.unique(label[np.append(x, y)])) == 1:
                continue
            small, large = np.minimum(size[x][:, None], size[y]), np.maximum(size[x][:, None], size[y])
            ok = (100 * small >= spec.percent * large) & (small > 0) & (label[x][:, None] != label[y])
            if sig is not None:
                far = np.zeros(ok.shape, dtype=np.uint8)
                for s in range(spec.symbols):
                    far += sig[x, s][:, None] != sig[y, s]
                ok &= far <= spec.max_distance
            sure = ok.sum() > _MANY
            if sure:
                both = _shared_counts([sets[k] for k in x], [sets[k] for k in y])
                ok &= (both > 0) & (100 * both >= spec.percent * (size[x][:, None] + size[y] - both))
            for k, row in zip(x, ok, strict=True):
                for v in y[row]:
                    if label[v] != label[k] and (sure or _linked(sets[k], sets[v], spec.percent)):
                        out.append((int(node[k]), int(node[v])))
                        label[label == label[v]] = label[k]
    return out


#: Elements of sets, and texts, that a block of a component holds: at least and at most.
BLOCK_LEAST, BLOCK_MOST, BLOCKS, TEXT_WEIGHT = 60_000, 4_000_000, 16, 200
#: Nodes of a component, about, that all of its blocks share.
PIVOTS = 32


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK_LEAST), weight / BLOCKS))).cast("int")


def _block_links(rows: DataFrame, spec: LinkSpec) -> DataFrame:
    """(a, b) from ``rows(root, i, j, node, side, label, z)``: within one side, or between two.

    Of equal labels nothing is compared; null ones are all different.
    """

    def linked(blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        sets = iter(spec.sets([z for *_, packed in blocks for z in packed]))
        got: list[tuple[int, int]] = []
        for node, side, known, packed in blocks:
            got += exact_links(np.array(node), np.array(side), [next(sets) for _ in packed], spec, known)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # most blocks are small, so the sets of several are made at once
        for _, _, _, node, side, label, packed in _runs(batches, 3):
            known = None if None in label else np.array(label)
            if len(node) == 1 or known is not None and len(set(side)) == 1:
                continue
            size = sum(map(len, packed))
            if held and n + size > _JOINED:
                yield from linked(held)
                held, n = [], 0
            held.append((node, side, known, packed))
            n += size
        if held:
            yield from linked(held)

    dealt = rows.select("root", "i", "j", "node", "side", "label", "z").repartition("root", "i", "j")
    return dealt.sortWithinPartitions("root", "i", "j", "node").transform(in_batches, run, "a long, b long")


def confirmed_components(coarse: DataFrame, sizes: DataFrame, texts: DataFrame, spec: LinkSpec) -> DataFrame:
    """(node, root) of all nodes with a link on full sets, of ``coarse(node, root)``.

    ``sizes(node, n)`` weigh the sets, ``texts(node, z)`` are packed texts. A coarse
    component is dealt over blocks of bounded size, so none has to fit in one task. A text
    goes to one block; pivots go to all, which connects what blocks have in common. What
    is then not in the largest part of its coarse component, and only that, is compared
    with all blocks.
    """
    sized = coarse.join(sizes.select("node", "n"), "node").withColumn("weight", F.col("n") + TEXT_WEIGHT)
    total = sized.groupBy("root").agg(F.sum("weight").alias("total"), F.count("*").alias("nodes"))
    blocks = total.select("root", _blocks(F.col("total")).alias("blocks"), F.greatest(F.lit(1), F.floor(F.col("nodes") / PIVOTS)).alias("every"))
    dealt = sized.join(blocks, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("every")) == 0)
    dealt = cut(dealt.withColumn("pivot", pivot).select("root", "node", "weight", "i", "blocks", "pivot"), few=True)
    everywhere = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("i"))
    none = F.lit(None).cast("long").alias("label")
    rows = dealt.join(texts, "node").select("root", F.explode(everywhere).alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("side"), none, "z")
    first = connected_components(cut(_block_links(rows, spec), few=True))

    wide = dealt.where("blocks > 1")
    if wide.isEmpty():
        return first
    named = first.withColumnRenamed("root", "label")
    labelled = wide.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = labelled.groupBy("root", "label").agg(F.sum("weight").alias("weight"))
    top = parts.groupBy("root").agg(F.max_by("label", F.struct("weight", "label")).alias("top"), (F.sum("weight") - F.max("weight")).alias("left"), F.count("*").alias("parts"))
    split = top.where("parts > 1").select("root", "top", _blocks(F.col("left")).alias("others"))
    apart = cut(labelled.join(split, "root"), few=True)
    if apart.isEmpty():
        return first
    # all against those that are not in the largest part
    one = apart.select("root", "node", "label", "i", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"), F.lit(0).alias("side"))
    other = apart.where("label <> top").select("root", "node", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(3)), F.col("others")).cast("int").alias("j"), F.lit(1).alias("side"))
    more = cut(_block_links(one.unionByName(other).join(texts, "node"), spec), few=True)
    if more.isEmpty():
        return first
    return connected_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def link_components(found: DataFrame, sigs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], spec: LinkSpec) -> DataFrame:
    """(node, root) of all nodes with a link.

    ``found(key, hub, node)`` are the checkpointed buckets, ``sigs(node, n, sig)`` sizes
    and signatures, and ``texts_of(nodes)`` returns ``(node, z)``, packed texts, for ``nodes(node)``.
    """
    near = cut(under_distance(found.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sigs, spec), few=True)
    coarse = connected_components(near)
    more = cut(bucket_links(found, coarse, sigs, spec), few=True)
    if not more.isEmpty():
        coarse = connected_components(coarse.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return confirmed_components(coarse, sigs, texts_of(coarse.select("node")), spec)


def close_components(found: DataFrame) -> DataFrame:
    """(node, root) of all nodes with a close sketch, of what ``sketch_links`` found."""
    close = found.where(F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b"))) <= SKETCH_CLOSE).select("a", "b")
    return connected_components(close.distinct())


def sketch_components(found: DataFrame, coarse: DataFrame, texts: DataFrame, spec: LinkSpec) -> DataFrame:
    """(node, root) of all nodes with a link, of what ``sketch_links`` found and its ``close_components``.

    Close sketches make coarse components, in which all pairs are compared in blocks: a
    family of any size gives no rows of pairs. The pairs that sketches allow beyond, few
    and far between, are verified one by one.
    """
    within = confirmed_components(coarse, texts.select("node", F.octet_length("z").alias("n")), texts, spec)
    across = cut(verified(cross_pairs(found, coarse), texts, spec), few=True)
    if across.isEmpty():
        return within
    return connected_components(within.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))
