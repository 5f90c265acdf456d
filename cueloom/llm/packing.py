"""Packing: first-fit decreasing over a tournament tree of bin capacities.

Documents become token ids (a byte-level BPE, then one closing id) and are cut into
chunks of at most ``seq_len`` ids. Chunks are dealt by a hash over partitions and there
in hash order into randomised groups of ``group_chunks``; each group is packed on its
own, so memory is bounded by the group whatever the longest document or the corpus.
In a group, full chunks are sequences; the others go, longest first, into the first
sequence with room, which a tournament tree of remaining capacities finds in
logarithmic time. Only the emptiest sequences of a group are touched again: they are cut up
to fill the room left in the others, and what remains is cut into lengths that are powers
of two. So where ``seq_len`` is a power of two, as it is by default, nothing is padded.

Null texts are empty: a document of the closing id alone. Rows that repeat a ``doc_id``
are documents of their own. An empty table gives no pieces. Texts of any length are
encoded whole, runs of millions of blanks included.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import in_batches, slices

END_ID = 1
_LONG_BLANKS = re.compile(r"\s{100000}")


class BpeIds:
    """Ids as ``tokenizers`` gives them without special tokens added.

    The same vocabulary and merges as ranks are much faster, so those are used; the
    strings of special tokens inside a text stay the single ids that ``tokenizers``
    reads them as. Runs of white space too long for the ranks' pattern, which would run
    out of stack, are left to ``tokenizers`` as well.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            self.special = {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or _LONG_BLANKS.search(text):
            return np.array(self._slow().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.plain.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    @lru_cache(maxsize=1)  # noqa: B019
    def _slow(self) -> Tokenizer:
        return Tokenizer.from_file(self.json_path)


class Tournament:
    """Bin capacities under a tree of maxima: the first bin with room in O(log n)."""

    def __init__(self, n: int, capacity: int) -> None:
        self.size = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.size)

    def take(self, need: int) -> int:
        """The first bin with so much room, from which it is taken. There is always one."""
        best, at = self.best, 1
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        found = at - self.size
        best[at] -= need
        at //= 2
        while at:
            new = max(best[2 * at], best[2 * at + 1])
            if best[at] == new:
                break
            best[at] = new
            at //= 2
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each bin, by falling length (ties: by index)."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    tree = Tournament(max(1, len(lengths)), capacity)
    bins: dict[int, list[int]] = {}
    for k in order:
        bins.setdefault(tree.take(lengths[k]), []).append(k)
    return [bins[b] for b in sorted(bins)]


def _taken(queue: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """The last pieces of the queue that make ``size`` ids; of the last of them the rest stays."""
    out = []
    while size:
        item, start, n = queue.pop()
        cut = min(n, size)
        out.append((item, start, cut))
        size -= cut
        if cut < n:
            queue.append((item, start + cut, n - cut))
    return out


def plan_group(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in it, length): full ones, and lengths that are powers of two."""
    out = [[(k, 0, n)] for k, n in enumerate(lengths) if n == capacity]
    rest = [k for k, n in enumerate(lengths) if n < capacity]
    bins = [[(rest[j], 0, lengths[rest[j]]) for j in b] for b in first_fit_decreasing([lengths[k] for k in rest], capacity)]
    bins.sort(key=lambda b: -sum(x[2] for x in b))
    full, left = divmod(sum(lengths[k] for k in rest), capacity)
    queue = [x for b in bins[full:] for x in b]
    out += [b + _taken(queue, capacity - sum(x[2] for x in b)) for b in bins[:full]]
    while left:
        size = 1 << left.bit_length() - 1
        left -= size
        out.append(_taken(queue, size))
    return out


def _chunks(json_path: str, ranks_path: str, seq_len: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BpeIds(json_path, ranks_path)
        for rows, texts in slices(batches):
            of, start, total, ids = [], [], [], []
            for k, t in enumerate(texts):
                a = np.append(enc.encode(t.decode()) if t else np.empty(0, dtype=np.uint32), np.uint32(END_ID)).astype("<u4")
                for s in range(0, len(a), seq_len):
                    of.append(k)
                    start.append(s)
                    total.append(len(a))
                    part = a[s : s + seq_len]
                    # ids below 65,536 travel as two bytes
                    ids.append(b"\x02" + part.astype("<u2").tobytes() if part.max() < 1 << 16 else b"\x04" + part.tobytes())
            cols = [rows.column(0).take(pa.array(of, pa.int64())), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "doc_tokens", "ids"])

    return run


def _pack(seq_len: int, group_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def packed(group: pa.Table) -> pa.RecordBatch:
            nonlocal made
            raw = group.column("ids").to_pylist()
            ids = [np.frombuffer(x, dtype="<u2" if x[0] == 2 else "<u4", offset=1) for x in raw]
            begun, total = group.column("start").to_numpy(), group.column("doc_tokens").to_numpy()
            take, start, length, seq, offset, data = [], [], [], [], [], []
            for pieces in plan_group([len(a) for a in ids], seq_len):
                at = 0
                for k, s, n in pieces:
                    take.append(k)
                    start.append(int(begun[k]) + s)
                    length.append(n)
                    seq.append((part << 32) + made)
                    offset.append(at)
                    data.append(ids[k][s : s + n].astype("<u4").tobytes())
                    at += n
                made += 1
            i64 = lambda x: pa.array(x, pa.int64())
            cols = [group.column("doc_id").combine_chunks().take(i64(take)), i64(start), i64(length), pa.array(data, pa.binary()), i64(total[take]), i64(seq), i64(offset)]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                head = b.slice(0, group_chunks - rows)
                b = b.slice(head.num_rows)
                held.append(head)
                rows += head.num_rows
                if rows == group_chunks:
                    yield packed(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield packed(pa.Table.from_batches(held))

    return run


def pack_documents(
    docs: DataFrame,
    seq_len: int = 2048,
    group_chunks: int = 4096,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    paths = json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    chunks = docs.select("doc_id", "text").transform(in_batches, _chunks(*paths, seq_len, None), f"doc_id {kind}, start long, doc_tokens long, ids binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # hashed by chunk, so that neither a long document nor a repeated id meets in one task
    dealt = chunks.withColumn("key", F.xxhash64("doc_id", "start", "ids")).repartition(n, "key").sortWithinPartitions("key", "doc_id", "start").drop("key")
    return dealt.transform(in_batches, _pack(seq_len, group_chunks), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
