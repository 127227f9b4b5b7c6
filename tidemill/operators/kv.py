"""Key-value keyspaces as frames (key, value, version, expires_at): changes make new frames from old ones.

Changes come as frames too, so that a batch of any size is one join. expires_at is in milliseconds; null never expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, value string, version bigint, expires_at bigint"


def alive(space: DataFrame, now_ms: int) -> DataFrame:
    return space.where(F.col("expires_at").isNull() | (F.col("expires_at") > now_ms))


def put(space: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """changes (key, value, expires_at) written over; an expired key starts anew at version 1. Of equal keys in changes, the greatest value counts."""
    new = changes.groupBy("key").agg(F.max(F.struct("value", "expires_at")).alias("c")).select("key", "c.value", "c.expires_at")
    old = alive(space, now_ms)
    versions = old.select("key", F.col("version").alias("__v"))
    fresh = new.join(versions, "key", "left").select("key", "value", (F.coalesce("__v", F.lit(0)) + 1).cast("long").alias("version"), "expires_at")
    return old.join(new.select("key"), "key", "left_anti").select("key", "value", "version", "expires_at").unionByName(fresh)


def compare_and_set(space: DataFrame, changes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """changes (key, value, version): written where the version is the current one (0: absent). (new space, key and done)."""
    old = alive(space, now_ms)
    seen = changes.join(old.select("key", F.col("version").alias("__v")), "key", "left")
    verdict = seen.select("key", "value", (F.coalesce("__v", F.lit(0)) == F.col("version")).alias("done"))
    return put(space, verdict.where("done").select("key", "value", F.lit(None).cast("long").alias("expires_at")), now_ms), verdict.select("key", "done")


def increment(space: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """changes (key, by): counters; an absent one, or one that is no whole number, starts at 0."""
    by = changes.groupBy("key").agg(F.sum("by").alias("by"))
    old = alive(space, now_ms).select("key", F.col("value").try_cast("long").alias("__n"), "expires_at")
    new = by.join(old, "key", "left").select("key", (F.coalesce("__n", F.lit(0)) + F.col("by")).cast("string").alias("value"), "expires_at")
    return put(space, new, now_ms)


def remove(space: DataFrame, keys: DataFrame) -> DataFrame:
    return space.join(keys.select("key"), "key", "left_anti")


def scan_prefix(space: DataFrame, prefix: str, now_ms: int, limit: int | None = None) -> DataFrame:
    """Live keys from the prefix on, in order. The range reaches the scan's statistics."""
    found = alive(space, now_ms).where((F.col("key") >= prefix) & F.col("key").startswith(prefix)).orderBy("key")
    return found if limit is None else found.limit(limit)
