"""What the corpus operators share: batches, words, checkpoints and folds."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are held as Python objects at a time.
SLICE_ROWS = 512
#: Bytes of text that are held as Python objects at a time (one row at least).
SLICE_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where it is unset a folder of the warehouse.

    Only a local master, whose executors are threads of the driver, may use a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        found = tempfile.mkdtemp(prefix="cueloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Cuts lineage through a reliable checkpoint in the shared folder.

    Where ``few`` rows come of many partitions, up to eight of these go into one file, as
    they would else become as many tiny files; partitions are still worked through one by
    one. Scans of texts keep their tasks.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if few:
        files = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        df = df.coalesce(files)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Gives the system the memory that this process has freed but holds for later."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers give back a task's memory when it ends.

    Spark's workers live on from task to task and from stage to stage. Each would else keep
    the most that any task before took, beside the JVM at its own most.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def unused(name: str, df: DataFrame) -> str:
    """The name, or one made from it, that no column of the table has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold that evaluation holds out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch in pieces of bounded rows and bytes, with the text column as UTF-8 bytes.

    A piece always has at least one row, so a single huge text passes whole.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(text).cast(pa.large_string()).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + n + 1)[col.offset :])
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))
            to = max(at + 1, min(to, at + SLICE_ROWS, n))
            yield batch.slice(at, to - at), col.slice(at, to - at).to_pylist()
            at = to


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
