"""Per-series sequence functions as window expressions.

A series is the rows with equal tags, in time order. Each function takes a Series and a field and returns a Column.
Rows with a null field stay; what they get follows each function's rule. One window sort serves all functions of
a select, since they share partitioning and order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import duration_ms


@dataclass(frozen=True)
class Series:
    """tags: columns that tell series apart; time: milliseconds or any ordered number; order: further tie breakers."""

    tags: tuple[str, ...]
    time: str = "time"
    order: tuple[str, ...] = field(default=())

    @property
    def window(self):
        return Window.partitionBy(*self.tags).orderBy(self.time, *self.order)

    @property
    def upto(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def after(self):
        return self.window.rowsBetween(1, Window.unboundedFollowing)

    @property
    def whole(self):
        return Window.partitionBy(*self.tags)


def _seen(s: Series, x: Column) -> Column:
    return F.when(x.isNotNull(), F.struct(F.col(s.time).alias("t"), x.alias("x")))


def _previous(s: Series, x: Column) -> Column:
    """(t, x) of the row before with a value."""
    return F.last(_seen(s, x), ignorenulls=True).over(s.before)


def difference(s: Series, x: Column) -> Column:
    return x - _previous(s, x)["x"]


delta = difference


def increase(s: Series, x: Column) -> Column:
    d = difference(s, x)
    return F.when(d >= 0, d)


def derivative(s: Series, x: Column, unit: str | int = "1s") -> Column:
    p = _previous(s, x)
    dt = F.col(s.time) - p["t"]
    return F.when(dt > 0, (x - p["x"]) * float(duration_ms(unit)) / dt)


def non_negative_derivative(s: Series, x: Column, unit: str | int = "1s") -> Column:
    d = derivative(s, x, unit)
    return F.when(d >= 0, d)


rate = irate = non_negative_derivative


def cumulative_sum(s: Series, x: Column) -> Column:
    return F.sum(x.cast("double")).over(s.upto)


running_sum = cumulative_sum


def running_min(s: Series, x: Column) -> Column:
    return F.min(x).over(s.upto)


def running_max(s: Series, x: Column) -> Column:
    return F.max(x).over(s.upto)


def integral(df: DataFrame, s: Series, x: str, unit: str | int = "1s", name: str = "integral") -> DataFrame:
    """df with the trapezoid sum; 0 at the first value, null before it, kept over null rows."""
    p = _previous(s, F.col(x))
    area = F.coalesce((p["x"] + F.col(x)) / 2 * (F.col(s.time) - p["t"]) / float(duration_ms(unit)), F.lit(0.0))
    step = df.withColumn("__area", F.when(F.col(x).isNotNull(), area))
    return step.withColumn(name, F.sum("__area").over(s.upto)).drop("__area")


def moving_average(s: Series, x: Column, n: int) -> Column:
    """Mean of the values among the last n rows; null until there are n rows."""
    mean = F.avg(x).over(s.window.rowsBetween(-(n - 1), 0))
    return F.when(F.row_number().over(s.window) >= n, mean)


def fill(s: Series, x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def locf(s: Series, x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(s.upto)


def interpolate(s: Series, x: Column) -> Column:
    """Null between two values: linear in time; null at the edges."""
    p, q = _previous(s, x), F.first(_seen(s, x), ignorenulls=True).over(s.after)
    return F.coalesce(x.cast("double"), p["x"] + (q["x"] - p["x"]) * (F.col(s.time) - p["t"]) / (q["t"] - p["t"]))


def _changed(s: Series, x: Column) -> Column:
    return x.isNotNull() & F.coalesce(x != _previous(s, x)["x"], F.lit(False))


def state_changes(df: DataFrame, s: Series, x: str, name: str = "state_changes") -> DataFrame:
    step = df.withColumn("__changed", _changed(s, F.col(x)).cast("long"))
    return step.withColumn(name, F.sum("__changed").over(s.upto)).drop("__changed")


def state_duration(df: DataFrame, s: Series, x: str, name: str = "state_duration") -> DataFrame:
    """Time since the current value began; null rows don't end it; null before the first value."""
    begins = F.col(x).isNotNull() & (_previous(s, F.col(x)).isNull() | _changed(s, F.col(x)))
    step = df.withColumn("__since", F.when(begins, F.col(s.time)))
    return step.withColumn(name, F.col(s.time) - F.last("__since", ignorenulls=True).over(s.upto)).drop("__since")


def anomaly(df: DataFrame, s: Series, x: str, method: str, threshold: float, name: str = "anomaly") -> DataFrame:
    """True where x lies beyond the threshold by its whole series: zscore, mad or iqr. False for fewer than two values
    or no spread; null for null. Statistics are grouped aggregates joined back, so a long series spills, not fails."""
    keys, v = list(s.tags), F.col(x).cast("double")
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(v).alias("__m"), F.stddev_samp(v).alias("__w"), F.count(v).alias("__n"))
        far = F.abs(v - F.col("__m")) / F.col("__w") > threshold
    elif method == "mad":
        mid = df.groupBy(*keys).agg(F.percentile(v, F.lit(0.5)).alias("__m"))
        both = df.join(mid, keys)
        stats = both.groupBy(*keys).agg(F.first("__m").alias("__m"), (F.percentile(F.abs(v - F.col("__m")), F.lit(0.5)) * 1.4826).alias("__w"), F.count(v).alias("__n"))
        far = F.abs(v - F.col("__m")) / F.col("__w") > threshold
    elif method == "iqr":
        stats = df.groupBy(*keys).agg(F.percentile(v, F.lit(0.25)).alias("__m"), F.percentile(v, F.lit(0.75)).alias("__q3"), F.count(v).alias("__n")).withColumn("__w", F.col("__q3") - F.col("__m"))
        far = (v < F.col("__m") - threshold * F.col("__w")) | (v > F.col("__q3") + threshold * F.col("__w"))
    else:
        raise ValueError(f"unknown method: {method}")
    usable = (F.col("__n") >= 2) & (F.coalesce(F.col("__w"), F.lit(0.0)) > 0)
    flag = F.when(v.isNotNull(), F.when(usable, far).otherwise(F.lit(False)))
    return df.join(stats, keys).withColumn(name, flag).drop("__m", "__w", "__n", "__q3")
