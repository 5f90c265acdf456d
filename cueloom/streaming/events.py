"""Structured Streaming forms of the windowed and stateful operators, over an events stream."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.validation import JOB_STATES


def read_events(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """A file stream of events with a watermark on their time."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        stream = spark.readStream.schema(schema).option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return _counts(events, F.window("ts", size))


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return _counts(events, F.window("ts", size, step))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of one user's events with no silence of ``gap`` or more."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", _ms("session_window.start").alias("start_ms"), _ms("session_window.end").alias("end_ms"), "n")


def _ms(c: str):
    return F.floor(F.unix_micros(F.col(c)) / 1000).cast("bigint")


def _counts(events: DataFrame, w) -> DataFrame:
    return events.groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", _ms("window.start").alias("start_ms"), _ms("window.end").alias("end_ms"), "n")


def job_states(actions: DataFrame) -> DataFrame:
    """(job_id, state, refused) after each batch of ``actions(job_id, seq, action)``; the state survives batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, refused = state.get if state.exists else (0, 0)
        failed = len(JOB_STATES)
        for action in pd.concat(list(frames)).sort_values("seq")["action"]:
            if at >= len(JOB_STATES) - 1:
                refused += 1
            else:
                at = {"advance": at + 1, "complete": len(JOB_STATES) - 1, "fail": failed}[action]
        state.update((at, refused))
        yield pd.DataFrame({"job_id": [key[0]], "state": [[*JOB_STATES, "failed"][at]], "refused": [refused]})

    return actions.groupBy("job_id").applyInPandasWithState(step, "job_id bigint, state string, refused bigint", "at int, refused bigint", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, keep: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table in the shared folder.

    In complete mode the last batch is the result; in update mode the last row of each ``keep``.
    """
    spark = stream.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="cueloom-")
    out = f"{top}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if top.startswith("/tmp/cueloom-"):
        shutil.rmtree(f"{out}/state", ignore_errors=True)
    rows = spark.read.parquet(f"{out}/rows")
    if keep:
        return rows.groupBy(keep).agg(*[F.max_by(c, "batch").alias(c) for c in rows.columns if c not in (keep, "batch")])
    return rows.drop("batch")
