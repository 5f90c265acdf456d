"""Order-keeping batches: windows with context, chunks, groups, scatter and positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def context_windows(df: DataFrame, size: int, around: int, order: str, value: str, *key: str) -> DataFrame:
    """Windows of ``size`` values with up to ``around`` neighbours before and after.

    Windows come from neighbouring rows, not from one array a group: each row also goes
    to the windows it is context for, so a long group spreads over many windows.
    """
    size, around = max(1, size), max(0, around)
    ranked = df.select(*key, F.col(value).alias("v"), (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).cast("bigint").alias("p"), F.count("*").over(Window.partitionBy(*key)).alias("n"))
    first, last = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("p") - around) / size)), F.least(F.floor((F.col("p") + around) / size), F.floor((F.col("n") - 1) / size))
    spread = ranked.withColumn("win_idx", F.explode(F.sequence(first, last)))
    begin = F.col("win_idx") * size
    role = F.when(F.col("p") < begin, "before").when(F.col("p") < begin + size, "texts").otherwise("after")
    own = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("p", "v")))), lambda x: x["v"])
    return spread.withColumn("role", role).groupBy(*key, "win_idx").agg(own("texts").alias("texts"), own("before").alias("before"), own("after").alias("after"))


def chunks(df: DataFrame, size: int, order: str, value: str, *key: str) -> DataFrame:
    """Runs of ``size`` values."""
    ranked = df.withColumn("__p", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1)
    return ranked.withColumn("chunk", F.floor(F.col("__p") / size).cast("bigint")).groupBy(*key, "chunk").agg(_in_order(order, value).alias("texts"))


def index_groups(df: DataFrame, by: str, order: str, value: str, *key: str) -> DataFrame:
    """Groups in the order of their first member: places and values of the members, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    grouped = df.groupBy(*key, by).agg(rows.alias("rows"), F.min(order).alias("first"))
    ranked = grouped.withColumn("grp_idx", F.row_number().over(Window.partitionBy(*key).orderBy("first")).cast("bigint"))
    return ranked.select(*key, by, "grp_idx", F.transform("rows", lambda x: x["o"]).alias("indices"), F.transform("rows", lambda x: x["v"]).alias("items"))


def scatter(groups: DataFrame, n: DataFrame, *key: str) -> DataFrame:
    """Values of (key..., indices, items) back in dense order; ``n(key..., n)`` says how many there must be.

    Where places are missing, ``texts`` is null and ``error`` is set. Of two values for a
    place, that of the later group wins.
    """
    flat = groups.select(*key, "grp_idx", F.explode(F.arrays_zip(F.col("indices").alias("i"), F.col("items").alias("v"))).alias("x"))
    one = flat.groupBy(*key, F.col("x.i").alias("i")).agg(F.max_by("x.v", "grp_idx").alias("v"))
    dense = one.groupBy(*key).agg(_in_order("i", "v").alias("texts"), F.count("*").alias("filled"))
    joined = n.join(dense, list(key), "left")
    ok = F.coalesce(F.col("filled"), F.lit(0)) == F.col("n")
    return joined.select(*key, F.when(ok, F.coalesce("texts", F.expr("cast(array() as array<string>)"))).alias("texts"), F.when(~ok, "translation-failed").alias("error"))


def reassemble(windows: DataFrame, order: str, *key: str) -> DataFrame:
    """All results of (key..., order, ok, error) in order, or the first error."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ok").alias("v"))))
    got = windows.groupBy(*key).agg(F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col(order))).alias("error"), rows.alias("rows"))
    return got.select(*key, F.when(F.col("error").isNull(), F.flatten(F.transform("rows", lambda x: x["v"]))).alias("texts"), "error")


def zip_positions(left: DataFrame, right: DataFrame, on: list[str], group: list[str]) -> DataFrame:
    """Rows joined by position; a group whose counts differ has an error in every row."""
    a = left.withColumn("__l", F.lit(1))
    b = right.withColumn("__r", F.lit(1))
    both = a.join(b, on, "full")
    w = Window.partitionBy(*group)
    short = F.sum(F.when(F.col("__l").isNull() | F.col("__r").isNull(), 1).otherwise(0)).over(w) > 0
    return both.withColumn("error", F.when(short, "translation-failed")).drop("__l", "__r")
