"""Recurrences over a series that no window frame expresses.

Rows are dealt by series and sorted by time by Spark; a small state machine then streams over Arrow batches and
carries its state from one to the next. A series never has to fit into memory, however long it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A kernel makes a step function for each series: step(time, value, further...) -> output.
Kernel = Callable[[], Callable]


def series_scan(df: DataFrame, tags: list[str], time: str, inputs: list[str], kernel: Kernel, name: str, kind: T.DataType, order: tuple[str, ...] = ()) -> DataFrame:
    """df with a column made by one pass over each series in time order."""
    from pyspark.sql.pandas.types import to_arrow_type

    kept = df.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])
    at_tags = [kept.columns.index(t) for t in tags]
    at_in = [kept.columns.index(c) for c in (time, *inputs)]
    arrow, names = to_arrow_type(kind), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = object(), None
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in at_tags], strict=True)) if at_tags else [()] * batch.num_rows
            out = []
            for k, row in zip(keys, zip(*[batch.column(i).to_pylist() for i in at_in], strict=True), strict=True):
                if k != key:
                    key, step = k, kernel()
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=names)

    dealt = kept.repartition(*[F.col(t) for t in tags]) if tags else kept.coalesce(1)
    return dealt.sortWithinPartitions(*tags, time, *order).mapInArrow(run, schema)


def ewma_kernel(alpha: float) -> Kernel:
    def start():
        s = None

        def step(_t, x):
            nonlocal s
            if x is not None:
                s = float(x) if s is None else alpha * x + (1 - alpha) * s
            return s

        return step

    return start


def holt_kernel(alpha: float, beta: float) -> Kernel:
    """Linear Holt smoothing: the second value starts the trend; null rows carry the last output."""

    def start():
        level = trend = shown = None

        def step(_t, x):
            nonlocal level, trend, shown
            if x is not None:
                x = float(x)
                if level is None:
                    level, shown = x, x
                elif trend is None:
                    shown = x + x - level
                    trend, level = x - level, x
                else:
                    before, rest = level, (1 - beta) * trend
                    level = alpha * x + (1 - alpha) * (level + trend)
                    gain = beta * (level - before)
                    shown = level + gain + rest  # summed in SQL's order, so that the last bit is the same
                    trend = gain + rest
            return shown

        return step

    return start


def cusum_kernel(threshold: float, drift: float) -> Kernel:
    """True where a two-sided sum of deviations from the baseline passes its bound; both sums then start anew."""

    def start():
        high = low = 0.0

        def step(_t, x, n, mean, sigma):
            nonlocal high, low
            if x is None:
                return None
            if n < 4 or not sigma:
                return False
            d, k, h = x - mean, drift * sigma, threshold * sigma
            high, low = max(0.0, high + d - k), min(0.0, low + d + k)
            if high > h or low < -h:
                high = low = 0.0
                return True
            return False

        return step

    return start


def ewma(df: DataFrame, tags: list[str], time: str, x: str, alpha: float, name: str = "ewma") -> DataFrame:
    return series_scan(df, tags, time, [x], ewma_kernel(alpha), name, T.DoubleType())


def holt_winters(df: DataFrame, tags: list[str], time: str, x: str, alpha: float, beta: float, name: str = "holt_winters") -> DataFrame:
    return series_scan(df, tags, time, [x], holt_kernel(alpha, beta), name, T.DoubleType())


def pid_series(df: DataFrame, tags: list[str], time: str, x: str, setpoint: float, kp: float, ki: float, kd: float, name: str = "pid") -> DataFrame:
    """df with the controller's output by row, from window sums; times in milliseconds. Rows where no time passed since
    the row before give the terms kp and ki and leave the state alone; rows without a value give none."""
    by = Window.partitionBy(*tags)
    given = F.col(x).isNotNull()
    at = Window.partitionBy(*tags, time, given)
    rows = df.withColumn("__e", F.lit(setpoint) - F.col(x)).withColumn("__first", given & (F.row_number().over(at.orderBy(F.lit(1))) == 1))
    order = by.orderBy(time, F.desc("__first"))
    before = F.last(F.when(F.col("__first"), F.struct(F.col(time).alias("t"), F.col("__e").alias("e"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__b", before).withColumn("__dt", (F.col(time) - F.col("__b.t")) / 1000.0)
    area = F.sum(F.when(F.col("__first"), F.col("__e") * F.col("__dt"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    two = kp * F.col("__e") + ki * F.coalesce(area, F.lit(0.0))
    value = F.when(~F.col("__first"), two).when(F.col("__b").isNull(), kp * F.col("__e")).otherwise(two + kd * (F.col("__e") - F.col("__b.e")) / F.col("__dt"))
    return rows.withColumn(name, F.when(given, value)).drop("__e", "__first", "__b", "__dt")


def changepoint(df: DataFrame, tags: list[str], time: str, x: str, threshold: float, drift: float = 0.5, name: str = "changepoint") -> DataFrame:
    """CUSUM against a baseline from the first max(5, n // 4) values of each series (n - 1 at most)."""
    w = Window.partitionBy(*tags).orderBy(time)
    v = F.col(x).cast("double")
    numbered = df.withColumn("__k", F.count(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = df.groupBy(*tags).agg(F.count(v).alias("__n"))
    base = F.least(F.greatest(F.lit(5), F.floor(F.col("__n") / 4)), F.col("__n") - 1)
    both = numbered.join(sizes, tags)
    inside = F.when(F.col("__k") <= base, v)
    stats = both.groupBy(*tags).agg(F.first("__n").alias("__n"), F.avg(inside).alias("__m"), F.stddev_samp(inside).alias("__s"))
    rows = df.join(stats, tags)
    return series_scan(rows, tags, time, [x, "__n", "__m", "__s"], cusum_kernel(threshold, drift), name, T.BooleanType()).drop("__n", "__m", "__s")


def pid_estimate(df: DataFrame, tags: list[str], time: str, x: str, method: str = "zn", step: float = 1.0, initial: float = 0.1, final: float = 0.1, lam: float | None = None) -> DataFrame:
    """Controller gains of each series by a first-order model with dead time, from a step response.

    Gain and levels come from the means of the first and last parts of the series; the times at which 35 % and 85 %
    of the change are first passed give the time constant and the dead time. method: zn, cc or imc.
    """
    w = Window.partitionBy(*tags).orderBy(time)
    rows = df.where(F.col(x).isNotNull()).withColumn("__k", F.row_number().over(w)).withColumn("__dt", F.lead(time).over(w) - F.col(time))
    sizes = df.groupBy(*tags).agg(F.count(x).alias("__n"), F.min(F.when(F.col(x).isNotNull(), F.col(time))).alias("__t0"))
    rows = rows.join(sizes, tags)
    head, tail = F.greatest(F.lit(1), F.floor(F.col("__n") * initial)), F.greatest(F.lit(1), F.floor(F.col("__n") * final))
    levels = rows.groupBy(*tags).agg(F.avg(F.when(F.col("__k") <= head, F.col(x))).alias("__y0"), F.avg(F.when(F.col("__k") > F.col("__n") - tail, F.col(x))).alias("__y1"), F.first("__t0").alias("__t0"), F.max_by("__dt", F.when(F.col("__k") == 1, F.lit(1))).alias("__gap"))
    change = F.col("__y1") - F.col("__y0")
    share = F.try_divide(F.col(x) - F.col("__y0"), change)
    after = (F.col(time) - F.col("__t0")) / 1000.0
    reached = rows.drop("__t0").join(levels, tags).groupBy(*tags).agg(F.first("__y0").alias("y0"), F.first("__y1").alias("y1"), F.first("__gap").alias("gap"), F.min(F.when(share >= 0.35, after)).alias("t35"), F.min(F.when(share >= 0.85, after)).alias("t85"))
    gain = (F.col("y1") - F.col("y0")) / step
    tau = (F.col("t85") - F.col("t35")) / 1.4663
    raw = F.col("t35") - 0.4308 * tau
    out = reached.select(*tags, gain.alias("gain"), tau.alias("tau"), F.when(raw < 0, F.col("gap") / 1000.0).otherwise(raw).alias("theta"))
    out = out.where("gain <> 0 AND tau > 0 AND theta > 0")
    k, t, d = F.col("gain"), F.col("tau"), F.col("theta")
    if method == "zn":
        kp, ti, td = 1.2 * t / (k * d), 2 * d, d / 2
    elif method == "cc":
        r = d / t
        kp, ti, td = (1 / k) * (t / d) * (4 / 3 + r / 4), d * (32 + 6 * r) / (13 + 8 * r), 4 * d / (11 + 2 * r)
    elif method == "imc":
        c = F.lit(lam) if lam else F.greatest(d, 0.1 * t)
        kp, ti, td = (t + d / 2) / (k * (c + d / 2)), t + d / 2, t * d / (2 * t + d)
    else:
        raise ValueError(f"unknown method: {method}")
    return out.select(*tags, kp.alias("kp"), (kp / ti).alias("ki"), (kp * td).alias("kd"))


def holt_winters_forecast(times: list[int], values: list[float | None], horizon: int, season: int = 0) -> list[tuple[int, float, float, float]]:
    """(time, value, lower, upper) of the next steps by additive smoothing with fixed weights."""
    alpha, beta, gamma, width = 0.4, 0.1, 0.2, 1.959963984540054
    n = len(values)
    seasonal = season > 1 and n >= 2 * season
    level = trend = 0.0
    started, has_trend, s, errors = False, False, [], []
    if seasonal:
        known = [0.0 if v is None else v for v in values]
        a, b = sum(known[:season]) / season, sum(known[season : 2 * season]) / season
        level, trend, started, has_trend = a, (b - a) / season, True, True
        cycles = n // season
        means = [sum(known[c * season : (c + 1) * season]) / season for c in range(cycles)]
        s = [sum(known[c * season + i] - means[c] for c in range(cycles)) / cycles for i in range(season)]
    for i, y in enumerate(values):
        if y is None:
            level += trend
            continue
        if not started:
            level, started = y, True
            continue
        own = s[i % season] if seasonal else 0.0
        r = y - (level + trend + own)
        errors.append(r)
        if not has_trend:
            trend, level, has_trend = y - level, y, True
            continue
        before = level
        level = alpha * (y - own) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        if seasonal:
            s[i % season] = gamma * (y - level) + (1 - gamma) * own
    sigma = math.sqrt(sum(e * e for e in errors) / max(1, len(errors) - 1)) if len(errors) > 1 else 0.0
    step = max(1, (times[-1] - times[0]) // max(1, n - 1))
    out = []
    for h in range(1, horizon + 1):
        v = level + h * trend + (s[(n + h - 1) % season] if seasonal else 0.0)
        half = width * sigma * math.sqrt(h)
        out.append((times[-1] + step * h, v, v - half, v + half))
    return out


def forecast_holt_winters(df: DataFrame, tags: list[str], time: str, x: str, horizon: int, season: int = 0) -> DataFrame:
    """tags, time, value, lower, upper; a series needs two points. Each series is one group: its length must fit a task."""
    schema = T.StructType([*[df.schema[t] for t in tags], T.StructField("time", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("value", "lower", "upper")]])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        times, values = table.column(time).to_pylist(), table.column(x).to_pylist()
        rows = holt_winters_forecast(times, values, horizon, season) if len(times) >= 2 else []
        columns = [[k.as_py()] * len(rows) for k in key] + [[r[i] for r in rows] for i in range(4)]
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], names=schema.fieldNames())

    return df.select(*tags, time, F.col(x).cast("double")).where(F.col(x).isNotNull()).groupBy(*tags).applyInArrow(run, schema)


def forecast_linear(df: DataFrame, tags: list[str], time: str, x: str, horizon: int) -> DataFrame:
    """Least squares over seconds since the first point: one aggregation by series, then its steps. No Python.

    Sums are kept about each series' own start, so that large epoch times lose no digits.
    """
    v = F.col(x).cast("double")
    rows = df.where(F.col(x).isNotNull())
    ends = rows.groupBy(*tags).agg(F.min(time).alias("__a"), F.max(time).alias("__b"), F.count(v).alias("__n"))
    sec = (F.col(time) - F.col("__a")) / 1000.0
    fit = rows.join(ends, tags).groupBy(*tags).agg(F.first("__a").alias("a"), F.first("__b").alias("b"), F.first("__n").alias("n"), F.regr_slope(v, sec).alias("slope"), F.avg(sec).alias("mx"), F.avg(v).alias("my"), F.regr_sxx(v, sec).alias("sxx"), F.regr_syy(v, sec).alias("syy"), F.regr_sxy(v, sec).alias("sxy"))
    slope = F.coalesce(F.col("slope"), F.lit(0.0))
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0)))
    fit = fit.where("n >= 2").select(*tags, "a", "b", slope.alias("k"), (F.col("my") - slope * F.col("mx")).alias("c"), F.sqrt(sse / F.greatest(F.lit(1), F.col("n") - 2)).alias("s"), F.greatest(F.lit(1), F.floor((F.col("b") - F.col("a")) / F.greatest(F.lit(1), F.col("n") - 1))).alias("step"))
    steps = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("time", F.col("b") + F.col("step") * F.col("h"))
    value = F.col("c") + F.col("k") * (F.col("time") - F.col("a")) / 1000.0
    half = 1.959963984540054 * F.col("s") * F.sqrt(F.col("h"))
    return steps.select(*tags, "time", value.alias("value"), (value - half).alias("lower"), (value + half).alias("upper"))
