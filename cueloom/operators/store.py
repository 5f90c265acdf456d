"""Content-addressed results with expiry, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transcript_key(content_sha: Column, provider: Column, model: Column, language: Column, segmenter: Column, span_pad_ms: Column) -> Column:
    """SHA-256 of the six fields parted by spaces; an absent field is an empty slot."""
    slots = F.transform(F.array(*[c.cast("string") for c in (content_sha, provider, model, language, segmenter, span_pad_ms)]), lambda x: F.coalesce(x, F.lit("")))
    return F.sha2(F.array_join(slots, " "), 256)


def content_sha(content: Column) -> Column:
    return F.sha2(content, 256)


def live(cache: DataFrame, now: int, ttl: int) -> DataFrame:
    """Entries that have not expired. Those without a time never do; a ttl of 0 keeps all."""
    return cache if ttl <= 0 else cache.where(F.col("cached_at").isNull() | (F.lit(now) - F.col("cached_at") <= ttl))


def fetch(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted(key, ...)`` with the payload of a hit, and ``cached``."""
    return wanted.join(cache.select("key", "payload"), "key", "left").withColumn("cached", F.col("payload").isNotNull())


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache, "key", "left_anti")


def store(cache: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """The cache with the rows of ``new(key, payload)``, which replace entries of their key."""
    stamped = new.select("key", F.lit(now).cast("bigint").alias("cached_at"), F.lit(now).cast("bigint").alias("mtime"), "payload")
    return cache.join(new, "key", "left_anti").select("key", "cached_at", "mtime", "payload").unionByName(stamped)


def forget(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys, "key", "left_anti")


def evict(cache: DataFrame, now: int, max_age: int) -> DataFrame:
    """Entries written within ``max_age``."""
    return cache.where(F.lit(now) - F.col("mtime") <= max_age)
