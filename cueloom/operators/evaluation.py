"""Quality of translations and timings."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ORDER, BETA = 6, 2.0
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def chrf_score(hypothesis: str | None, reference: str | None) -> float:
    """F score of character n-grams of orders 1 to 6, white space aside; 0 where a text has none."""
    h, r = (_SPACE.sub("", t or "") for t in (hypothesis, reference))
    p, q = [], []
    for n in range(1, min(MAX_ORDER, len(h), len(r)) + 1):
        a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (h, r))
        hit = sum(min(c, b[g]) for g, c in a.items() if g in b)
        p.append(hit / (len(h) - n + 1))
        q.append(hit / (len(r) - n + 1))
    if not p or not sum(p):
        return 0.0
    mp, mq, b2 = sum(p) / len(p), sum(q) / len(q), BETA * BETA
    return (1 + b2) * mp * mq / (b2 * mp + mq)


def chrf(pairs: DataFrame, hypothesis: str, reference: str, *key: str) -> DataFrame:
    """(key..., chrf) per row of ``pairs``. Both texts are in the row, so nothing is shuffled."""

    @F.pandas_udf("double")
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([chrf_score(x, y) for x, y in zip(h, r, strict=True)], dtype="float64")

    return pairs.select(*key, score(F.col(hypothesis), F.col(reference)).alias("chrf"))


def chance_level(rows: DataFrame, hypothesis: str, reference: str, order: str, *group: str) -> DataFrame:
    """Mean chrF of each group against its own references moved on by one, the last to the first."""
    w = Window.partitionBy(*group).orderBy(order)
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = rows.withColumn("__moved", F.coalesce(F.lead(reference).over(w), F.first(reference).over(all_of)))
    return chrf(moved, hypothesis, "__moved", *group, order).groupBy(*group).agg(F.avg("chrf").alias("chance"))


def ship_floor(scores: DataFrame) -> DataFrame:
    """``scores(chrf, chance, source_chrf)`` with ratio, floor and verdict."""
    ratio = lambda c: F.col(c) / F.col("chance")
    return scores.withColumn("ratio", ratio("chrf")).withColumn("floor", F.greatest(F.lit(2.2), 1.15 * ratio("source_chrf"))).withColumn("ships", F.col("ratio") >= F.col("floor"))


def timing_report(a: DataFrame, b: DataFrame, tolerance: int, *key: str) -> DataFrame:
    """Per key: cues on either side and how many start and end within the tolerance."""
    joined = a.select(*key, "pos", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1")).join(b.select(*key, "pos", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2")), [*key, "pos"], "full")
    ok = (F.abs(F.col("s1") - F.col("s2")) <= tolerance) & (F.abs(F.col("e1") - F.col("e2")) <= tolerance)
    return joined.groupBy(*key).agg(F.count("s1").alias("n_reference"), F.count("s2").alias("n_hypothesis"), F.count(F.when(ok, 1)).alias("n_within"))
