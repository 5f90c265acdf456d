"""MinHash near-duplicates by a multi-index Hamming join.

A document's word shingles give a signature of ``symbols`` min-hash values of 16 bits.
The signature is split into chunks by the pigeonhole principle and, for each chunk,
every allowed set of errors is enumerated as keys that leave those symbols out, so any
two signatures that differ in at most ``max_distance`` symbols share a key. With 80
symbols and a distance of 30, documents at a similarity of exactly 0.8 stay under the
distance with probability 0.9999, and more similar ones more surely. Candidates are
confirmed on the full sets.

Documents with equal sets are one node from the start, so groups of copies cost nothing.
Null, empty and blank texts have no shingles and are linked with nothing. Rows that
repeat a ``doc_id`` each get a row; their texts are nodes of their own, and all rows of
the smallest id of a component are kept. Null ids count as one id, before all others. An
empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, slices, unused
from .linking import LinkSpec, WordHashes, buckets, chunk_masks, connected_components, keys_of, link_components, may_be_member, membership_bitmap, signatures, word_shingles

SYMBOLS, CHUNK, MAX_DISTANCE = 80, 5, 30


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows, texts in slices(batches, 2):
            sets = [word_shingles(t or b"", size, cache) for t in texts]
            sig = signatures(sets, SYMBOLS)
            cols = [
                rows.column(0),
                rows.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([x.tobytes() for x in sig], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n", "set_hash", "sig"])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = chunk_masks(SYMBOLS, CHUNK, MAX_DISTANCE)
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            keys = keys_of(sig, masks)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), len(masks)))], names=["key", "node"])


def _zipped(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 2):
            ok = may_be_member(shared.value, rows.column(1).to_numpy())
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(mask), rows.column(1).filter(mask), pa.array([zlib.compress(t, 1) for t, k in zip(texts, ok, strict=True) if k], pa.binary())], names=["doc_id", "text_hash", "z"])

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, before: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    With ``before(doc_id, text)``, texts that documents had before, there is one row for
    every distinct set of an id, all rows of an id are in one component, and ids that
    ``docs`` lacks are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n long, set_hash binary, sig binary"
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sets = hashed.transform(in_batches, _sets(shingle_words), schema)
    if before is not None:
        old = before.select(F.col("doc_id").cast(kind), F.xxhash64("text").alias("text_hash"), "text")
        # rows of sets, not texts, are shuffled to find the ids that are still there
        sets = sets.unionByName(old.transform(in_batches, _sets(shingle_words), schema).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")).dropDuplicates(["doc_id", "set_hash"])
        hashed = hashed.unionByName(old)
    sets = cut(sets)
    full = sets.where("set_hash IS NOT NULL")
    # one row a set: the smallest id (null first), and any of its texts; the struct tells it from a missing one
    nodes = full.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash", "n", "sig")).alias("first")).select("set_hash", "first.*")
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", "sig").transform(in_batches, _index, "key long, node long")
    spec = LinkSpec(partial(word_shingles, size=shingle_words), SYMBOLS, MAX_DISTANCE, percent)

    def texts_of(wanted: DataFrame) -> DataFrame:
        of = nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_hash")
        bitmap = docs.sparkSession.sparkContext.broadcast(membership_bitmap(of.select("text_hash")))  # 8 MB
        packed = hashed.where("text IS NOT NULL").transform(in_batches, _zipped(bitmap), f"doc_id {kind}, text_hash long, z binary")
        of = of.withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
        met = packed.join(of, (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
        return met.select("node", "z").dropDuplicates(["node"])

    comps = link_components(cut(buckets(members), few=True), nodes.select("node", "n", "sig"), texts_of, spec)
    rooted = nodes.select("node", "set_hash", "doc_id").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if before is not None:
        rooted = _joined_by_id(cut(rooted), sets)
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id")).alias("first"))
    labels = rooted.join(first, "root").select("set_hash", "first")
    out = sets.select("doc_id", "n", "set_hash").join(labels, "set_hash", "left")
    component = F.coalesce("first", F.struct("doc_id"))["doc_id"]
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _joined_by_id(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """``rooted(node, set_hash, doc_id, root)`` with the components of one id's several texts as one."""
    per_id = sets.where("set_hash IS NOT NULL").select("doc_id", "set_hash").join(rooted.select("set_hash", "root"), "set_hash")
    span = per_id.groupBy("root").agg(F.min(F.struct("doc_id")).alias("lo"), F.max(F.struct("doc_id")).alias("hi"))
    # a component of one document joins nothing
    several = per_id.join(span.where("lo <> hi").select("root"), "root", "left_semi")
    least = several.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("hi")).where("a < hi").drop("hi")
    pairs = several.join(least, "doc_id").select("a", F.col("root").alias("b"))
    joined = connected_components(cut(pairs, few=True)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(joined, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def keep_representatives(docs: DataFrame, shingle_words: int = 5, percent: int = 80, before: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns.

    ``before(doc_id, text)`` are texts that documents had before; documents are then linked
    by what they hold or by what they held. Ids that ``docs`` lacks are left out.
    """
    name = unused("__kept", docs)
    judged = near_duplicates(docs.select("doc_id", "text"), shingle_words, percent, before)
    # of an id with several texts, one that is kept keeps all rows; one that was not before makes all go
    verdict = F.max("kept") if before is None else F.min("kept")
    kept = judged.groupBy(F.col("doc_id").alias(name)).agg(verdict.alias("kept")).where("kept").select(name)
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
