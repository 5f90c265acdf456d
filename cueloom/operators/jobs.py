"""Jobs and aggregates: states that only move forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validation import JOB_STATES

#: What happens to a job; ``advance`` moves one state on.
ACTIONS = ("advance", "complete", "fail")
_LAST = len(JOB_STATES) - 1


def final_states(events: DataFrame, *job: str) -> DataFrame:
    """(job..., state, refused) after all of ``events(job..., seq, action)`` in order.

    A job ends with its first complete or fail, or with the advance that reaches the last
    state, and refuses what follows; so the state needs no fold: it is told by the number
    of advances before the first end.
    """
    w = Window.partitionBy(*job).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    advances = F.coalesce(F.sum(F.when(F.col("action") == "advance", 1).otherwise(0)).over(w), F.lit(0))
    ends = F.coalesce(F.sum(F.when(F.col("action").isin("complete", "fail"), 1).otherwise(0)).over(w), F.lit(0))
    placed = events.withColumn("__refused", (advances >= _LAST) | (ends > 0))
    taken = lambda a: F.max(F.when((F.col("action") == a) & ~F.col("__refused"), 1).otherwise(0))
    summed = placed.groupBy(*job).agg(
        F.sum(F.when((F.col("action") == "advance") & ~F.col("__refused"), 1).otherwise(0)).alias("n"),
        taken("complete").alias("done"),
        taken("fail").alias("failed"),
        F.sum(F.col("__refused").cast("int")).cast("bigint").alias("refused"),
    )
    state = F.when(F.col("failed") == 1, "failed").when(F.col("done") == 1, "completed").otherwise(F.element_at(F.array(*[F.lit(s) for s in JOB_STATES]), F.col("n").cast("int") + 1))
    return summed.select(*job, state.alias("state"), "refused")


def guard_transition(state: Column, *allowed: str) -> Column:
    return F.when(~F.coalesce(state.isin(*allowed), F.lit(False)), "illegal-transition")


def seal(aggregates: DataFrame, members: DataFrame, error: str, *key: str) -> DataFrame:
    """Aggregates (key..., status) sealed as complete: an empty one cannot be, nor one sealed before."""
    counted = aggregates.join(members.groupBy(*key).agg(F.count("*").alias("members")), list(key), "left")
    fault = F.coalesce(guard_transition(F.col("status"), "empty", "partial", "pending", "translating"), F.when(F.coalesce(F.col("members"), F.lit(0)) == 0, error))
    return counted.select(*key, F.when(fault.isNull(), "complete").otherwise(F.col("status")).alias("status"), F.coalesce("members", F.lit(0)).alias("members"), fault.alias("error"))
