"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows.

Questions and answers are normalised to lower-cased words; every run of ``window``
words of an item (the whole item where it is shorter) becomes one pattern. A document
is normalised alike and scanned once; hits are mapped back to the words they cover and
to byte offsets of the original text.

The items reach the driver for the automaton, so their size is checked: up to
``max_chars`` characters of patterns go into one automaton. A larger benchmark is dealt
into several by the hash of the item, and the documents are scanned against each in
turn, with the same results.

Null or empty texts have no words and no hits. Null, empty or wordless items have no
windows. Repeated items are one item each by id, those with a null id together one with a
null id, the last of a list; each document row has its own result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices

#: Words are runs of ASCII letters and digits and of any byte above 0x7F.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x20]+")


def normalised_words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows(words: list[bytes], size: int) -> list[tuple[str, int]]:
    """Distinct windows of an item, as text between single spaces, with their word counts."""
    if not words:
        return []
    n = min(size, len(words))
    return [(s, n) for s in dict.fromkeys(" " + b" ".join(words[k : k + n]).decode() + " " for k in range(len(words) - n + 1))]


def build_automaton(items: list[tuple[object, bytes]], size: int) -> ahocorasick.Automaton:
    """Each pattern yields (its number of words, the ids of the items that contain it)."""
    by: dict[str, tuple[int, set]] = {}
    for item_id, text in items:
        for s, n in windows(normalised_words(text), size):
            by.setdefault(s, (n, set()))[1].add(item_id)
    auto = ahocorasick.Automaton()
    for s, (n, ids) in by.items():
        auto.add_word(s, (n, len(s), list(ids)))
    if len(auto):
        auto.make_automaton()
    return auto


def scan(auto: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged [from, to) word ranges that windows cover, and the items they belong to."""
    if not words or not len(auto):
        return [], set()
    norm = " " + b" ".join(words).decode() + " "
    hits: list[tuple[int, int, list]] = [(end - chars + 1, n, ids) for end, (n, chars, ids) in auto.iter(norm)]
    if not hits:
        return [], set()
    hits.sort(key=lambda h: h[0])
    found: set = set()
    ranges: list[list[int]] = []
    at = word = 0
    for begin, n, ids in hits:
        word += norm.count(" ", at, begin)
        at = begin
        if ranges and word <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], word + n)
        else:
            ranges.append([word, word + n])
        found.update(ids)
    return [(a, b) for a, b in ranges], found


def _scan_documents(docs: DataFrame, items: list[tuple[object, bytes]], size: int, id_kind: str, item_kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # checked by the caller

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = build_automaton(shared.value, size)
        for rows, texts in slices(batches):
            out = defaultdict(list)
            for t in texts:
                words = normalised_words(t)
                ranges, found = scan(auto, words)
                spans = []
                if ranges:
                    at = [m.span() for m in _WORD.finditer(t.translate(_TABLE))]
                    spans = [{"first_word": a, "n_words": b - a, "byte_from": at[a][0], "byte_to": at[b - 1][1]} for a, b in ranges]
                out["n_words"].append(len(words))
                out["spans"].append(spans)
                out["item_ids"].append(sorted(found, key=lambda x: (x is None, x)))
            span = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("byte_from", pa.int64()), ("byte_to", pa.int64())])
            ids = pa.array(out["item_ids"], pa.list_(pa.string() if item_kind == "string" else pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["spans"], pa.list_(span)), ids], names=["doc_id", "n_words", "spans", "item_ids"])

    schema = f"doc_id {id_kind}, n_words long, spans array<struct<first_word:long,n_words:long,byte_from:long,byte_to:long>>, item_ids array<{item_kind}>"
    return docs.transform(in_batches, run, schema)


def _merge_ranges(spans):
    """Spans of several automata, sorted and merged where they overlap or touch."""
    joined = F.aggregate(
        F.array_sort(F.flatten(spans)),
        F.expr("cast(array() as array<struct<first_word:bigint,n_words:bigint,byte_from:bigint,byte_to:bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["first_word"] <= F.try_element_at(acc, F.lit(-1))["first_word"] + F.try_element_at(acc, F.lit(-1))["n_words"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(acc, F.lit(-1))["first_word"].alias("first_word"),
                        (F.greatest(F.try_element_at(acc, F.lit(-1))["first_word"] + F.try_element_at(acc, F.lit(-1))["n_words"], s["first_word"] + s["n_words"]) - F.try_element_at(acc, F.lit(-1))["first_word"]).alias("n_words"),
                        F.try_element_at(acc, F.lit(-1))["byte_from"].alias("byte_from"),
                        F.greatest(F.try_element_at(acc, F.lit(-1))["byte_to"], s["byte_to"]).alias("byte_to"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return joined


def _shards(benchmark: DataFrame, window: int, max_chars: int):
    """Number of automata, kind of the item ids, and a function that collects the items of one."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    kind = "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "bigint"
    # a text of n words has n windows of `window` words at most
    chars = items.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    shards = max(1, -(-chars * window // max_chars))
    of = lambda k: [(r[0], bytes(r[1])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).select("item_id", F.col("text").cast("binary")).collect()]
    return shards, kind, of


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_chars: int = 20_000_000) -> DataFrame:
    """The rows of ``docs`` that no window hits, with all their columns."""
    shards, _, of = _shards(benchmark, window, max_chars)
    column = docs.columns.index("text")

    def without(items):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = build_automaton(shared.value, window)
            for rows, texts in slices(batches, column):
                yield rows.filter(pa.array([not scan(auto, normalised_words(t))[0] for t in texts], pa.bool_()))

        return run

    for k in range(shards):
        docs = docs.transform(in_batches, without(of(k)), docs.schema)
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, n_words, spans, item_ids, n_hit) of ``docs(doc_id, text)`` against ``benchmark(item_id, text)``."""
    shards, item_kind, of = _shards(benchmark, window, max_chars)
    plain = docs.select("doc_id", "text")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    if shards == 1:
        found = _scan_documents(plain, of(0), window, id_kind, item_kind)
    else:
        # rows are told apart by id and text: equal rows have equal results, and are counted
        distinct = plain.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
        parts = [_scan_documents(distinct.select(F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), "copies").alias("doc_id"), "text"), of(k), window, f"struct<doc_id:{id_kind},h:string,copies:bigint>", item_kind) for k in range(shards)]
        joined = parts[0]
        for p in parts[1:]:
            joined = joined.unionByName(p)
        merged = joined.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), _merge_ranges(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        found = merged.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "item_ids", F.explode(F.sequence(F.lit(1), F.col("doc_id.copies"))).alias("copy")).drop("copy")
    return found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"]))
