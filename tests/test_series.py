"""Per-series functions and recurrences on tiny frames with expected values."""

import math

import pytest
from pyspark.sql import functions as F

from tidemill.functions import series as W
from tidemill.operators import stateful as R

S = W.Series(("h",))


def frame(spark, points, kind="double"):
    return spark.createDataFrame([("a", t, v) for t, v in points], f"h string, time bigint, x {kind}")


def out(df, column="y"):
    return [r[column] for r in df.orderBy("time").collect()]


@pytest.mark.parametrize(
    ("f", "points", "want"),
    [
        (lambda x: W.difference(S, x), [(0, 10), (1000, 13), (2000, 11)], [None, 3, -2]),
        (lambda x: W.derivative(S, x), [(0, 0), (1000, 10), (3000, 40)], [None, 10, 15]),
        (lambda x: W.non_negative_derivative(S, x), [(0, 100), (1000, 50), (2000, 80)], [None, None, 30]),
        (lambda x: W.rate(S, x), [(0, 0), (500, 5)], [None, 10]),
        (lambda x: W.increase(S, x), [(0, 5), (1, None), (2, 7), (3, 6)], [None, None, 2, None]),
        (lambda x: W.cumulative_sum(S, x), [(0, None), (1, 1), (2, None), (3, 3)], [None, 1, 1, 4]),
        (lambda x: W.running_min(S, x), [(0, 5), (1, 3), (2, 7)], [5, 3, 3]),
        (lambda x: W.running_max(S, x), [(0, 5), (1, 3), (2, 7)], [5, 5, 7]),
        (lambda x: W.moving_average(S, x, 3), [(i, i + 1) for i in range(5)], [None, None, 2, 3, 4]),
        (lambda x: W.fill(S, x, 9.0), [(0, None), (1, 1)], [9, 1]),
        (lambda x: W.locf(S, x), [(0, None), (1, 1), (2, None)], [None, 1, 1]),
        (lambda x: W.interpolate(S, x), [(0, None), (10, 1), (20, None), (40, 4), (50, None)], [None, 1, 2, 4, None]),
    ],
)
def test_columns(spark, f, points, want):
    assert out(frame(spark, [(t, None if v is None else float(v)) for t, v in points]).withColumn("y", f(F.col("x")))) == want


def test_plans(spark):
    assert out(W.integral(frame(spark, [(0, 10.0), (1000, 10.0), (2000, 10.0)]), S, "x", name="y")) == [0, 10, 20]
    states = frame(spark, [(0, None), (1, "on"), (5, None), (7, "off"), (9, "off")], "string")
    assert out(W.state_changes(states, S, "x", "y")) == [0, 0, 0, 1, 1]
    assert out(W.state_duration(states, S, "x", "y")) == [None, 0, 4, 0, 2]
    spiky = frame(spark, [(i, 10.0 + i % 2) for i in range(10)] + [(10, 100.0), (11, None)])
    for method, t in (("zscore", 2.0), ("mad", 3.0), ("iqr", 1.5)):
        assert out(W.anomaly(spiky, S, "x", method, t, "y")) == [False] * 10 + [True, None]
    assert out(W.anomaly(frame(spark, [(0, 1.0), (1, 1.0)]), S, "x", "zscore", 1.0, "y")) == [False, False]


def test_recurrences(spark):
    assert out(R.ewma(frame(spark, [(0, 10.0), (1, 20.0), (2, None), (3, 30.0)]), ["h"], "time", "x", 0.5, "y")) == [10, 15, 15, 22.5]
    assert out(R.holt_winters(frame(spark, [(i, 2.0 * i) for i in range(5)]), ["h"], "time", "x", 0.5, 0.5, "y")) == [0, 4, 6, 8, 10]
    steps = frame(spark, [(i, float(i % 2)) for i in range(20)] + [(20 + i, 10.0) for i in range(3)])
    assert out(R.changepoint(steps, ["h"], "time", "x", 4.0, name="y"))[20] is True
    assert out(R.changepoint(frame(spark, [(0, 1.0), (1, 9.0)]), ["h"], "time", "x", 4.0, name="y")) == [False, False]
    pid = frame(spark, [(0, 0.0), (1000, 5.0), (1000, 5.0), (3000, 10.0)])
    assert out(R.pid_series(pid, ["h"], "time", "x", 10.0, 1.0, 0.1, 0.01, "y"))[0] == 10
    assert math.isclose(out(R.pid_series(pid, ["h"], "time", "x", 10.0, 1.0, 0.1, 0.01, "y"))[1], 5 + 0.5 - 0.05)


def test_series_are_kept_apart_in_batches(spark):
    rows = [(f"s{i % 7}", i, float(i)) for i in range(2000)]
    got = R.series_scan(spark.createDataFrame(rows, "h string, time bigint, x double"), ["h"], "time", ["x"], R.ewma_kernel(0.1), "y", R.T.DoubleType())
    want, state = {}, {}
    for h, t, x in rows:
        state[h] = x if h not in state else 0.1 * x + 0.9 * state[h]
        want[(h, t)] = state[h]
    assert {(r.h, r.time): r.y for r in got.collect()} == want


def test_forecasts(spark):
    line = frame(spark, [(1000 * i, 3.0 + 2 * i) for i in range(6)])
    rows = R.forecast_linear(line, ["h"], "time", "x", 2).orderBy("time").collect()
    assert [r.time for r in rows] == [6000, 7000] and all(math.isclose(r.value, v, abs_tol=1e-9) for r, v in zip(rows, (15, 17), strict=True))
    waves = frame(spark, [(i, [0.0, 5.0, 0.0, -5.0][i % 4]) for i in range(16)])
    values = [r.value for r in R.forecast_holt_winters(waves, ["h"], "time", "x", 4, 4).orderBy("time").collect()]
    assert values[1] > 3 and values[3] < -3
    assert R.forecast_linear(frame(spark, [(0, 1.0)]), ["h"], "time", "x", 2).count() == 0


def test_pid_estimate_of_a_first_order_response(spark):
    points = [(100 * i, 0.0 if i < 20 else 2 * (1 - math.exp(-(i - 20) / 50))) for i in range(600)]
    r = R.pid_estimate(frame(spark, points), ["h"], "time", "x", "zn", 1.0, 0.02, 0.05).first()
    assert 1.2 * 5 / (2 * 2) * 0.6 < r.kp < 1.2 * 5 / (2 * 2) * 1.4
