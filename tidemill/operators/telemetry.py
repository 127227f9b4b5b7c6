"""Platform telemetry: latest values, raw ranges, windows anchored at their begin, rule chains, device activity."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = ("none", "mean", "median", "last", "first", "max", "min", "sum")


def split_keys(keys: str | list[str] | None) -> list[str] | None:
    return [k for k in re.split(r"[,; ]+", keys) if k] if isinstance(keys, str) else keys


def latest(df: DataFrame, keys: str | list[str] | None = None) -> DataFrame:
    """Latest value of each key of each device; partial maxima go to the shuffle, not rows."""
    wanted = split_keys(keys)
    rows = df.where(F.col("key").isin(wanted)) if wanted else df
    return rows.groupBy("device_id", "key").agg(F.max_by(F.struct("time", "value"), "time").alias("v")).select("device_id", "key", "v.time", "v.value")


def raw_range(df: DataFrame, begin: int, end: int, keys: str | list[str] | None = None) -> DataFrame:
    wanted = split_keys(keys)
    rows = df.where(F.col("time").between(begin, end))
    return (rows.where(F.col("key").isin(wanted)) if wanted else rows).orderBy("device_id", "key", "time")


def window(df: DataFrame, begin: int, end: int, every: int, aggregate: str, whole: bool = False) -> DataFrame:
    """device_id, key, time (the bucket's end), value. Buckets start at begin; every 0 is a minute; a bucket of one
    point gives that point; the median is the upper middle; whole: means are cut to whole numbers."""
    every = every or 60_000
    aggregate = aggregate.lower()
    count = -(-(end - begin) // every)
    rows = df.where((F.col("time") >= begin) & (F.col("time") < min(end, begin + count * every)))
    if aggregate == "none":
        return rows.select("device_id", "key", "time", "value")
    b = F.floor((F.col("time") - begin) / every)
    v = F.col("value").cast("double")
    if aggregate == "median":  # by rank: a bucket of any size streams through a sort
        rows = rows.withColumn("__b", b)
        own = Window.partitionBy("device_id", "key", "__b")
        rows = rows.withColumn("__k", F.row_number().over(own.orderBy(v))).withColumn("__n", F.count(v).over(own))
    made = {
        "mean": F.avg(v), "sum": F.sum(v), "max": F.max(v), "min": F.min(v),
        "first": F.min_by(v, "time"), "last": F.max_by(v, "time"), "median": F.max(F.when(F.expr("__k = floor(__n / 2) + 1"), v)) if aggregate == "median" else None,
    }[aggregate]
    if whole and aggregate == "mean":
        made = F.when(made < 0, F.ceil(made)).otherwise(F.floor(made)).cast("double")
    out = rows.groupBy("device_id", "key", b.alias("b")).agg(made.alias("m"), F.count(v).alias("n"), F.min("time").alias("t"), F.min(v).alias("only"))
    return out.select("device_id", "key", F.when(F.col("n") == 1, F.col("t")).otherwise(begin + (F.col("b") + 1) * every).alias("time"), F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("m")).alias("value"))


def pivot(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide rows by device and time; the keys are given, so that no pass is needed to find them."""
    return df.groupBy("device_id", "time").pivot("key", keys).agg(F.last("value"))


@dataclass
class Task:
    """A node of a rule chain: columns it sets, as SQL expressions."""

    name: str
    sets: dict[str, str] = field(default_factory=dict)


@dataclass
class Flow:
    """From a node (start for the first) to a task or end; an empty condition always holds."""

    source: str
    target: str
    condition: str = ""


def run_rules(df: DataFrame, tasks: list[Task], flows: list[Flow], most: int = 32) -> DataFrame:
    """Rows that reach an end, once for each path, with a path column. A chain deeper than most is an error."""
    by = {t.name: t for t in tasks}
    ends, now = [], [("start", df.withColumn("path", F.lit("start")))]
    for _ in range(most):
        following = []
        for node, rows in now:
            for f in [f for f in flows if f.source == node]:
                taken = rows.where(F.coalesce(F.expr(f.condition), F.lit(False))) if f.condition else rows
                taken = taken.withColumn("path", F.concat("path", F.lit(">" + f.target)))
                if f.target == "end":
                    ends.append(taken)
                else:
                    following.append((f.target, taken.withColumns({c: F.expr(e) for c, e in by[f.target].sets.items()})))
        now = following
        if not now:
            break
    if now:
        raise ValueError(f"the rule chain has a path of more than {most} flows")
    out = ends[0] if ends else df.withColumn("path", F.lit("")).limit(0)
    for e in ends[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def inactive(df: DataFrame, timeouts: DataFrame, now_ms: Column | int) -> DataFrame:
    """device_id, last_ms of devices without telemetry for more than their timeout (seconds); a device without any counts."""
    now_ms = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    seen = df.groupBy("device_id").agg(F.max("time").alias("last_ms"))
    return timeouts.join(seen, "device_id", "left").where(now_ms - F.coalesce("last_ms", F.lit(0)) > F.col("timeout") * 1000).select("device_id", "last_ms")


def retain(df: DataFrame, time: str, ttl_ms: int, now_ms: int) -> DataFrame:
    """Rows not older than the retention."""
    return df.where(F.col(time) > now_ms - ttl_ms)
