"""Aggregates of measurements, as Columns for agg() or as small plans where they need an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import duration_ms, geo_distance, geo_speed


def bucket(time: Column, width: str | int) -> Column:
    """Start of the tumbling bucket that holds a time in milliseconds; rounds towards minus infinity."""
    ms = duration_ms(width)
    return time - F.pmod(time, F.lit(ms))


def first(x: Column, time: Column) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), time))


def last(x: Column, time: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), time))


def spread(x: Column) -> Column:
    return F.max(x) - F.min(x)


def mode(x: Column) -> Column:
    """Most frequent value, the smallest of ties; NaN doesn't count."""
    return F.mode(F.when(~F.isnan(x.cast("double")), x), deterministic=True)


def percentile(x: Column, q: float, exact: bool = False) -> Column:
    """q from 0 to 100. By a sketch of bounded size, or exactly."""
    return F.percentile(x, F.lit(q / 100)) if exact else F.percentile_approx(x.cast("double"), q / 100, 10_000)


def distinct_count(x: Column) -> Column:
    """By HyperLogLog, to about 0.81 %; 0 of nothing."""
    return F.approx_count_distinct(x.cast("double"), 0.0081)


def quantile_sketch(x: Column) -> Column:
    """A mergeable quantile sketch, for rollup tables; read by kll_sketch_get_quantile_double."""
    return F.kll_sketch_agg_double(x.cast("double"))


def histogram(df: DataFrame, keys: list[str], x: str, width: float, name: str = "histogram") -> DataFrame:
    """keys and JSON text {"[lo,hi)": n} of fixed-width bins in ascending order; NaN and infinities don't count."""
    v = F.col(x).cast("double")
    bins = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(*keys, F.floor(v / width).alias("__bin")).count()
    label = F.concat(F.lit("["), (F.col("__bin") * width).cast("string"), F.lit(","), ((F.col("__bin") + 1) * width).cast("string"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("__bin", label.alias("k"), "count")))
    entries = F.transform(ordered, lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["count"].cast("string")))
    return bins.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias(name))


def centroid(df: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Element-wise mean of vectors by key: partial sums of (key, position), then one short row per key."""
    parts = df.select(*keys, F.posexplode(vector).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda e: e["__m"]).alias(name))


def trajectory(df: DataFrame, keys: list[str], time: str, p: str) -> DataFrame:
    """By key: length (m), centroid and bounding box, and speed_max, speed_avg, speed_p95 (m/s) over consecutive points."""
    w = Window.partitionBy(*keys).orderBy(time)
    own = df.where(F.col(p).isNotNull())
    steps = own.withColumn("__p", F.lag(p).over(w)).withColumn("__dt", F.col(time) - F.lag(time).over(w))
    steps = steps.withColumn("__d", geo_distance(F.col("__p"), F.col(p))).withColumn("__v", geo_speed(F.col("__p"), F.col(p), F.col("__dt")))
    lat, lon = F.col(f"{p}.lat"), F.col(f"{p}.lon")
    return steps.groupBy(*keys).agg(
        F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"), F.avg(lat).alias("centroid_lat"), F.avg(lon).alias("centroid_lon"),
        F.min(lat).alias("min_lat"), F.min(lon).alias("min_lon"), F.max(lat).alias("max_lat"), F.max(lon).alias("max_lon"),
        F.max("__v").alias("speed_max"), F.avg("__v").alias("speed_avg"), F.percentile("__v", F.lit(0.95)).alias("speed_p95"),
    )


def pid(df: DataFrame, keys: list[str], time: str, x: str, setpoint: float, kp: float, ki: float, kd: float, name: str = "pid") -> DataFrame:
    """Last controller output by key, the state starting anew in each. Times in milliseconds, strictly rising."""
    w = Window.partitionBy(*keys).orderBy(time)
    e = F.lit(setpoint) - F.col(x)
    rows = df.where(F.col(x).isNotNull()).withColumn("__e", e)
    rows = rows.withColumn("__dt", (F.col(time) - F.lag(time).over(w)) / 1000.0).withColumn("__de", F.col("__e") - F.lag("__e").over(w))
    last_ = F.max_by(F.struct("__e", "__dt", "__de"), time)
    out = rows.groupBy(*keys).agg(last_.alias("__l"), F.sum(F.col("__e") * F.col("__dt")).alias("__i"))
    value = F.when(F.col("__l.__dt").isNull(), kp * F.col("__l.__e")).otherwise(kp * F.col("__l.__e") + ki * F.col("__i") + kd * F.try_divide(F.col("__l.__de"), F.col("__l.__dt")))
    return out.select(*keys, value.alias(name))
