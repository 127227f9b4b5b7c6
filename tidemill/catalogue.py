"""The registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import aggregates as A
from tidemill.functions import scalar as S
from tidemill.functions import series as W
from tidemill.operators import documents as D
from tidemill.operators import fulltext as T
from tidemill.operators import stateful as R
from tidemill.operators import telemetry as P
from tidemill.operators import vector as V
from tidemill.plans import dialect, jsonsql
from tidemill.session import scratch_path
from tidemill.sources import ingest
from tidemill.streaming import continuous

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a measurement: time in ms, tag user_id, a field x that lacks every fifth value, and a point."""
    time = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    place = S.point(F.lit(31.0) + F.col("user_id") % 50 / 100.0 + F.col("event_id") % 7 / 1000.0, F.lit(121.0) + F.col("event_id") % 11 / 100.0)
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", time.alias("time"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("x"), place.alias("p"))


SERIES = W.Series(("user_id",), "time", ("event_id",))
EV = """ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS time, CASE WHEN event_id % 5 <> 0 THEN value END AS x,
 31.0 + user_id % 50 / 100.0 + event_id % 7 / 1000.0 AS lat, 121.0 + event_id % 11 / 100.0 AS lon FROM events)"""
PREV = f"""WITH {EV}, pr AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS px, last_value(CASE WHEN x IS NOT NULL THEN time END IGNORE NULLS) OVER w AS pt
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def r4(x, name: str):
    return F.round(x, 4).alias(name)


# --- sources: the same points by way of a text format


@query("SELECT user_id::VARCHAR AS host, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def line_protocol(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    line = F.concat(F.lit("ev,host="), F.col("user_id"), F.lit(",id="), F.col("event_id"), F.lit(" value="), F.col("value"), F.lit(",kind=\""), F.col("event_type"), F.lit("\" "), us.cast("string"), F.lit("000"))
    points = ingest.line_protocol(read(spark, d, "events").select(line.alias("value")))
    wide = ingest.wide(points, "ev", ["host", "id"], {"value": "double", "kind": "string"})
    return wide.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT user_id::VARCHAR AS host, count(*) AS n FROM events GROUP BY 1")
def json_points(spark, d):
    payload = F.to_json(F.struct(F.lit("ev").alias("m"), F.lit("us").alias("precision"), F.array(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.create_map(F.lit("host"), F.col("user_id").cast("string")).alias("tags"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("fields"))).alias("points")))
    points = ingest.json_points(read(spark, d, "events").select(payload.alias("value")))
    return points.groupBy(F.try_element_at("tags", F.lit("host")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def update_delete(spark, d):
    o = ingest.delete(read(spark, d, "orders"), "o_orderstatus = 'F'")
    return ingest.update(o, {"o_totalprice": "o_totalprice / 2"}, "o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_cascade(spark, d):
    return ingest.cascade(read(spark, d, "orders"), "o_custkey", read(spark, d, "customer").where("c_acctbal < 0"), "c_custkey").select("o_orderkey")


# --- scans, projections, predicates


@query(f"WITH {EV} SELECT event_id, time, value FROM ev WHERE user_id = 7 AND time >= 1704067200000 AND time < 1705276800000")
def scan_tag_time(spark, d):
    return events(spark, d).where("user_id = 7 AND time >= 1704067200000 AND time < 1705276800000").select("event_id", "time", "value")


@query(f"WITH {EV} SELECT user_id, arg_max(value, (time, event_id)) AS value, max(time) AS time FROM ev GROUP BY user_id")
def latest_point(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max_by("value", F.struct("time", "event_id")).alias("value"), F.max("time").alias("time"))


@query("SELECT p_partkey, p_name FROM part WHERE (p_brand IN ('Brand#11', 'Brand#23', 'Brand#42') OR p_type LIKE '%A%') AND NOT regexp_matches(p_name, '[0-9]7$')")
def filter_in_like_regex(spark, d):
    return read(spark, d, "part").where("(p_brand IN ('Brand#11', 'Brand#23', 'Brand#42') OR p_type LIKE '%A%') AND NOT p_name RLIKE '[0-9]7$'").select("p_partkey", "p_name")


@query(f"WITH {EV} SELECT event_id, x IS NULL AS missing, (x > 50 OR event_type = 'click') AS either, NOT (x > 50) AS below FROM ev WHERE NOT (x > 100 AND event_type = 'view')")
def filter_null_kleene(spark, d):
    return events(spark, d).where("NOT (x > 100 AND event_type = 'view')").selectExpr("event_id", "x IS NULL AS missing", "(x > 50 OR event_type = 'click') AS either", "NOT (x > 50) AS below")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, round(o_totalprice / nullif(o_custkey % 3, 0) - 1, 4) AS share, -o_custkey AS neg FROM orders")
def case_arith(spark, d):
    band = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low")
    return read(spark, d, "orders").select("o_orderkey", band.alias("band"), r4(S.divide(F.col("o_totalprice"), F.col("o_custkey") % 3) - 1, "share"), (-F.col("o_custkey")).alias("neg"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_types(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def limit_offset(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def top_per_group(spark, d):
    return V.top_per_group(read(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_orderkey", "l_linenumber", "l_extendedprice")


# --- joins


@query("SELECT n_name, r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_inner_multi(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY 1")
def join_left_residual(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 150000), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def join_theta(spark, d):
    n = read(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query(f"WITH {EV} SELECT c_mktsegment, count(*) AS n, round(avg(value), 4) AS mean FROM ev JOIN customer ON CAST(user_id AS VARCHAR) = CAST(c_custkey AS VARCHAR) GROUP BY 1")
def join_measurement_dim(spark, d):
    return events(spark, d).join(read(spark, d, "customer"), F.col("user_id").cast("string") == F.col("c_custkey").cast("string")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("value"), "mean"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def semi_in(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def semi_exists(spark, d):
    return read(spark, d, "supplier").join(read(spark, d, "lineitem").where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")
def scalar_subquery(spark, d):
    o = read(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg((F.avg("o_totalprice") * 2).alias("m")))).where("o_totalprice > m").select("o_orderkey")


@query("SELECT c_mktsegment, max(t) AS top FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1) o ON c_custkey = o_custkey GROUP BY 1")
def derived_table_join(spark, d):
    t = read(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("t"))
    return read(spark, d, "customer").join(t, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.max("t").alias("top"))


# --- aggregates


@query(f"WITH {EV} SELECT time // 3600000 * 3600000 AS time, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(value) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def bucket_1h(spark, d):
    return events(spark, d).where("event_type = 'purchase'").groupBy(A.bucket(F.col("time"), "1h").alias("time")).agg(r4(F.avg("value"), "mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))


@query(f"WITH {EV} SELECT count(*) AS n, count(x) AS nx, round(sum(x), 4) AS total, round(avg(x), 4) AS mean FROM ev HAVING count(*) > 0")
def bucket_global(spark, d):
    return events(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("nx"), r4(F.sum("x"), "total"), r4(F.avg("x"), "mean")).where("n > 0")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 1000000 AND count(*) > 5")
def group_having(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t")).where("t >= 1000000 AND n > 5").drop("t")


@query(f"WITH {EV} SELECT user_id, arg_min(x, (time, event_id)) FILTER (x IS NOT NULL) AS first, arg_max(x, (time, event_id)) FILTER (x IS NOT NULL) AS last FROM ev GROUP BY 1")
def first_last(spark, d):
    at = F.struct("time", "event_id")
    return events(spark, d).groupBy("user_id").agg(A.first(F.col("x"), at).alias("first"), A.last(F.col("x"), at).alias("last"))


@query(f"WITH {EV} SELECT user_id, round(stddev_samp(x), 4) AS sd, round(var_samp(x), 4) AS var, round(max(x) - min(x), 4) AS spread FROM ev GROUP BY 1")
def stddev_variance_spread(spark, d):
    return events(spark, d).groupBy("user_id").agg(r4(F.stddev_samp("x"), "sd"), r4(F.var_samp("x"), "var"), r4(A.spread(F.col("x")), "spread"))


@query(f"WITH {EV}, c AS (SELECT user_id, round(value) AS v, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS k FROM c) WHERE k = 1")
def mode_agg(spark, d):
    return events(spark, d).groupBy("user_id").agg(A.mode(F.round("value")).alias("mode"))


@query(f"WITH {EV} SELECT user_id, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.99), 4) AS p99 FROM ev GROUP BY 1")
def percentiles_exact(spark, d):
    return events(spark, d).groupBy("user_id").agg(*[r4(A.percentile(F.col("x"), q, exact=True), f"p{q}") for q in (50, 90, 99)])


@query("SELECT event_type, true AS p50_near, true AS kll95_near FROM events GROUP BY 1")
def percentile_sketch(spark, d):
    """Both sketches' ranks are within 2 % of those asked."""
    e = events(spark, d)
    got = e.groupBy("event_type").agg(A.percentile(F.col("x"), 50).alias("a"), F.kll_sketch_get_quantile_double(A.quantile_sketch(F.col("x")), F.lit(0.95)).alias("b"))
    below = lambda c: F.avg((F.col("x") < F.col(c)).cast("double"))
    upto = lambda c: F.avg((F.col("x") <= F.col(c)).cast("double"))
    near = lambda c, q: (below(c) <= q + 0.02) & (upto(c) >= q - 0.02)
    return e.join(F.broadcast(got), "event_type").groupBy("event_type").agg(near("a", 0.5).alias("p50_near"), near("b", 0.95).alias("kll95_near"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def distinct_count(spark, d):
    """Within five standard errors of the exact count. Apart, as beside a distinct count each value would hold a sketch."""
    e = events(spark, d)
    about = e.groupBy("event_type").agg(A.distinct_count(F.col("value")).alias("about"))
    exact = e.groupBy(F.col("event_type").alias("own")).agg(F.count_distinct("value").alias("exact"))
    near = F.abs(F.col("about") - F.col("exact")) <= 0.0405 * F.col("exact") + 1
    return about.join(exact, F.col("event_type").eqNullSafe(F.col("own"))).select("event_type", near.alias("near"))


@query(f"""WITH {EV}, b AS (SELECT event_type, floor(value / 50.0) AS b, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT event_type, '{{' || string_agg('"[' || printf('%.1f', b * 50.0) || ',' || printf('%.1f', (b + 1) * 50.0) || ')":' || n, ',' ORDER BY b) || '}}' AS histogram FROM b GROUP BY 1""")
def histogram_fixed(spark, d):
    return A.histogram(events(spark, d), ["event_type"], "value", 50.0)


@query("WITH u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings) SELECT label, i::INTEGER AS i, round(avg(v::DOUBLE), 4) AS m FROM u GROUP BY 1, 2")
def centroid_vec(spark, d):
    out = A.centroid(read(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", F.posexplode("centroid").alias("i", "m")).select("label", (F.col("i") + 1).alias("i"), r4(F.col("m"), "m"))


TRAJ = f"""WITH {EV}, s AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b, time - lag(time) OVER w AS dt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)),
q AS (SELECT *, {HAV.format(a="a", b="b", c="lat", d="lon")} AS m FROM s)"""


@query(TRAJ + " SELECT user_id, round(coalesce(sum(m), 0), 2) AS length, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM q GROUP BY 1")
def trajectory_length(spark, d):
    t = A.trajectory(events(spark, d).withColumn("at", F.col("time") + F.col("event_id") / 1e9), ["user_id"], "at", "p")
    return t.select("user_id", F.round("length", 2).alias("length"), r4(F.col("centroid_lat"), "lat"), r4(F.col("centroid_lon"), "lon"), F.col("min_lat").alias("south"), F.col("max_lat").alias("north"), F.col("min_lon").alias("west"), F.col("max_lon").alias("east"))


@query(TRAJ + " SELECT user_id, round(max(m / (dt / 1000.0)) FILTER (dt > 0), 4) AS fastest, round(avg(m / (dt / 1000.0)) FILTER (dt > 0), 4) AS mean FROM q GROUP BY 1")
def trajectory_speed(spark, d):
    t = A.trajectory(events(spark, d), ["user_id"], "time", "p")
    return t.select("user_id", r4(F.col("speed_max"), "fastest"), r4(F.col("speed_avg"), "mean"))


@query(f"""WITH {EV}, e AS (SELECT user_id, time, event_id, 100 - x AS e, (time - lag(time) OVER w) / 1000.0 AS dt, 100 - x - lag(100 - x) OVER w AS de FROM ev WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY time))
SELECT user_id, round(CASE WHEN count(*) = 1 THEN 0.5 * max(e) ELSE 0.5 * arg_max(e, time) + 0.001 * sum(e * dt) + 2.0 * arg_max(de / dt, time) END, 3) AS pid FROM e GROUP BY 1""")
def pid_bucket(spark, d):
    return A.pid(events(spark, d), ["user_id"], "time", "x", 100.0, 0.5, 0.001, 2.0).select("user_id", F.round("pid", 3).alias("pid"))


@query()
def pid_estimate(spark, d):
    e = events(spark, d).where("x IS NOT NULL").withColumn("y", F.col("x") + F.col("time") % 1000000007 / 1e6)
    return R.pid_estimate(e, ["user_id"], "time", "y", "imc")


# --- per-series windows


@query(PREV + " SELECT event_id, round(x - px, 4) AS d FROM pr")
def difference(spark, d):
    return events(spark, d).select("event_id", r4(W.difference(SERIES, F.col("x")), "d"))


@query(PREV + " SELECT event_id, round(CASE WHEN x - px >= 0 THEN x - px END, 4) AS d FROM pr")
def increase(spark, d):
    return events(spark, d).select("event_id", r4(W.increase(SERIES, F.col("x")), "d"))


@query(PREV + " SELECT event_id, round(CASE WHEN time > pt THEN (x - px) * 60000.0 / (time - pt) END, 4) AS d FROM pr")
def derivative(spark, d):
    return events(spark, d).select("event_id", r4(W.derivative(SERIES, F.col("x"), "1m"), "d"))


@query(PREV + " SELECT event_id, round(CASE WHEN time > pt AND x >= px THEN (x - px) * 1000.0 / (time - pt) END, 4) AS d FROM pr")
def rate(spark, d):
    return events(spark, d).select("event_id", r4(W.rate(SERIES, F.col("x")), "d"))


@query(f"WITH {EV} SELECT event_id, round(sum(x) OVER w, 4) AS s, min(x) OVER w AS low, max(x) OVER w AS high FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)")
def running_functions(spark, d):
    x = F.col("x")
    return events(spark, d).select("event_id", r4(W.cumulative_sum(SERIES, x), "s"), W.running_min(SERIES, x).alias("low"), W.running_max(SERIES, x).alias("high"))


@query(PREV + ", a AS (SELECT *, CASE WHEN x IS NOT NULL THEN coalesce((x + px) / 2 * (time - pt) / 3600000.0, 0) END AS area FROM pr) SELECT event_id, round(sum(area) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING), 3) AS i FROM a")
def integral(spark, d):
    return W.integral(events(spark, d), SERIES, "x", "1h", "i").select("event_id", F.round("i", 3).alias("i"))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN row_number() OVER w >= 5 THEN avg(x) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS 4 PRECEDING) END, 4) AS m FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)")
def moving_average(spark, d):
    return events(spark, d).select("event_id", r4(W.moving_average(SERIES, F.col("x"), 5), "m"))


@query(f"WITH {EV} SELECT event_id, coalesce(x, -1) AS filled, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM ev")
def fill_locf(spark, d):
    return events(spark, d).select("event_id", W.fill(SERIES, F.col("x"), -1.0).alias("filled"), W.locf(SERIES, F.col("x")).alias("carried"))


@query(PREV + """, nx AS (SELECT *, first_value(x IGNORE NULLS) OVER w AS qx, first_value(CASE WHEN x IS NOT NULL THEN time END IGNORE NULLS) OVER w AS qt FROM pr WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(x, px + (qx - px) * (time - pt) / (qt - pt)), 4) AS y FROM nx""")
def interpolate(spark, d):
    return events(spark, d).select("event_id", r4(W.interpolate(SERIES, F.col("x")), "y"))


STATE = f"""WITH {EV}, e AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN event_type END AS s FROM ev),
p AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM e)"""


@query(STATE + " SELECT event_id, sum(CASE WHEN s IS NOT NULL AND ps IS NOT NULL AND s <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM p")
def state_changes(spark, d):
    return W.state_changes(events(spark, d).withColumn("s", F.when(F.col("event_id") % 5 != 0, F.col("event_type"))), SERIES, "s", "n").select("event_id", "n")


@query(STATE + ", b AS (SELECT *, CASE WHEN s IS NOT NULL AND (ps IS NULL OR s <> ps) THEN time END AS since FROM p) SELECT event_id, time - last_value(since IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS ms FROM b")
def state_duration(spark, d):
    return W.state_duration(events(spark, d).withColumn("s", F.when(F.col("event_id") % 5 != 0, F.col("event_type"))), SERIES, "s", "ms").select("event_id", "ms")


@query(f"WITH {EV}, s AS (SELECT user_id, avg(x) AS m, stddev_samp(x) AS w, count(x) AS n FROM ev GROUP BY 1) SELECT event_id, CASE WHEN x IS NULL THEN NULL WHEN n >= 2 AND w > 0 THEN abs(x - m) / w > 2.0 ELSE false END AS a FROM ev JOIN s USING (user_id)")
def anomaly_zscore(spark, d):
    return W.anomaly(events(spark, d), SERIES, "x", "zscore", 2.0, "a").select("event_id", "a")


@query(f"""WITH {EV}, s AS (SELECT user_id, quantile_cont(x, 0.5) AS m, count(x) AS n FROM ev GROUP BY 1), t AS (SELECT user_id, quantile_cont(abs(x - m), 0.5) * 1.4826 AS w FROM ev JOIN s USING (user_id) GROUP BY 1)
SELECT event_id, CASE WHEN x IS NULL THEN NULL WHEN n >= 2 AND w > 0 THEN abs(x - m) / w > 3.0 ELSE false END AS a FROM ev JOIN s USING (user_id) JOIN t USING (user_id)""")
def anomaly_mad(spark, d):
    return W.anomaly(events(spark, d), SERIES, "x", "mad", 3.0, "a").select("event_id", "a")


@query(f"WITH {EV}, s AS (SELECT user_id, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, count(x) AS n FROM ev GROUP BY 1) SELECT event_id, CASE WHEN x IS NULL THEN NULL WHEN n >= 2 AND b > a THEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) ELSE false END AS a FROM ev JOIN s USING (user_id)")
def anomaly_iqr(spark, d):
    return W.anomaly(events(spark, d), SERIES, "x", "iqr", 1.5, "a").select("event_id", "a")


NUMBERED = f"{EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS k FROM ev)"


@query(f"""WITH RECURSIVE {NUMBERED}, z AS (SELECT user_id, k, event_id, x AS s FROM k WHERE k = 1 UNION ALL
SELECT k.user_id, k.k, k.event_id, CASE WHEN k.x IS NULL THEN z.s WHEN z.s IS NULL THEN k.x ELSE 0.3 * k.x + (1 - 0.3) * z.s END FROM z JOIN k ON k.user_id = z.user_id AND k.k = z.k + 1) SELECT event_id, round(s, 4) AS s FROM z""")
def ewma(spark, d):
    return R.ewma(events(spark, d), ["user_id"], "time", "x", 0.3, "s").select("event_id", F.round("s", 4).alias("s"))


@query(f"""WITH RECURSIVE {NUMBERED}, z AS (SELECT user_id, k, event_id, x AS l, NULL::DOUBLE AS t, x AS s FROM k WHERE k = 1 UNION ALL
SELECT user_id, k, event_id, CASE WHEN x IS NULL THEN l ELSE nl END, CASE WHEN x IS NULL OR l IS NULL THEN t WHEN t IS NULL THEN x - l ELSE 0.3 * (nl - l) + 0.7 * t END,
 CASE WHEN x IS NULL THEN s WHEN l IS NULL THEN x WHEN t IS NULL THEN x + x - l ELSE nl + 0.3 * (nl - l) + 0.7 * t END
FROM (SELECT k.user_id, k.k, k.event_id, k.x, z.l, z.t, z.s, CASE WHEN z.l IS NULL OR z.t IS NULL THEN k.x ELSE 0.5 * k.x + 0.5 * (z.l + z.t) END AS nl FROM z JOIN k ON k.user_id = z.user_id AND k.k = z.k + 1)) SELECT event_id, round(s, 4) AS s FROM z""")
def holt_winters(spark, d):
    s = R.holt_winters(events(spark, d), ["user_id"], "time", "x", 0.5, 0.3, "s")
    return s.select("event_id", (F.round(F.col("s") * 10000) / 10000).alias("s"))  # as SQL's engine rounds: F.round(s, 4) takes the decimal digits


@query(f"""WITH RECURSIVE {NUMBERED}, c AS (SELECT *, count(x) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS j, count(x) OVER (PARTITION BY user_id) AS n FROM k),
b AS (SELECT user_id, any_value(n) AS n, avg(x) FILTER (x IS NOT NULL AND j <= least(greatest(5, n // 4), n - 1)) AS m, stddev_samp(x) FILTER (x IS NOT NULL AND j <= least(greatest(5, n // 4), n - 1)) AS w FROM c GROUP BY 1),
o AS (SELECT c.user_id, c.k, c.event_id, c.x, b.n, b.m, b.w FROM c JOIN b USING (user_id)),
z AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0.0::DOUBLE AS h, 0.0::DOUBLE AS l, NULL::BOOLEAN AS p FROM b UNION ALL
SELECT user_id, k, event_id, CASE WHEN p THEN 0 ELSE h END, CASE WHEN p THEN 0 ELSE l END, p FROM (
SELECT user_id, k, event_id, h, l, CASE WHEN x IS NULL THEN NULL WHEN n < 4 OR w IS NULL OR w = 0 THEN false ELSE h > 4.0 * w OR l < -4.0 * w END AS p FROM (
SELECT o.user_id, o.k, o.event_id, o.x, o.n, o.w, CASE WHEN o.x IS NULL OR o.n < 4 OR o.w IS NULL OR o.w = 0 THEN z.h ELSE greatest(0, z.h + (o.x - o.m) - 0.5 * o.w) END AS h,
 CASE WHEN o.x IS NULL OR o.n < 4 OR o.w IS NULL OR o.w = 0 THEN z.l ELSE least(0, z.l + (o.x - o.m) + 0.5 * o.w) END AS l FROM z JOIN o ON o.user_id = z.user_id AND o.k = z.k + 1)))
SELECT event_id, p AS changepoint FROM z WHERE k > 0""")
def changepoint(spark, d):
    return R.changepoint(events(spark, d), ["user_id"], "time", "x", 4.0).select("event_id", "changepoint")


@query(f"""WITH {EV}, e AS (SELECT *, 100 - x AS e, (time - lag(time) OVER w) / 1000.0 AS dt, 100 - x - lag(100 - x) OVER w AS de, row_number() OVER w AS k FROM ev WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY time))
SELECT event_id, round(CASE WHEN k = 1 THEN 0.5 * e ELSE 0.5 * e + 0.001 * sum(e * dt) OVER (PARTITION BY user_id ORDER BY time) + 2.0 * de / dt END, 3) AS u FROM e""")
def pid_series(spark, d):
    return R.pid_series(events(spark, d).where("x IS NOT NULL"), ["user_id"], "time", "x", 100.0, 0.5, 0.001, 2.0, "u").select("event_id", F.round("u", 3).alias("u"))


# --- scalars


@query("SELECT o_orderkey, round(round_even(o_totalprice / 4, 1), 4) AS r, round(sqrt(o_totalprice), 4) AS q, round(ln(o_totalprice) / ln(10), 4) AS l, abs(o_custkey - 500) AS a FROM orders")
def math_scalar(spark, d):
    x = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", r4(S.round_half_even(x / 4, 1), "r"), r4(F.sqrt(x), "q"), r4(S.log(x, F.lit(10.0)), "l"), F.abs(F.col("o_custkey") - 500).alias("a"))


@query(f"WITH {EV} SELECT event_id, round({HAV.format(a='lat', b='lon', c='31.2304', d='121.4737')}, 3) AS m, round((degrees(atan2(sin(radians(121.4737 - lon)) * cos(radians(31.2304)), cos(radians(lat)) * sin(radians(31.2304)) - sin(radians(lat)) * cos(radians(31.2304)) * cos(radians(121.4737 - lon)))) + 360) % 360, 4) AS b FROM ev")
def geo_distance_bearing(spark, d):
    c = S.point(F.lit(31.2304), F.lit(121.4737))
    return events(spark, d).select("event_id", F.round(S.geo_distance(F.col("p"), c), 3).alias("m"), r4(S.geo_bearing(F.col("p"), c), "b"))


@query(f"WITH {EV} SELECT event_id, {HAV.format(a='lat', b='lon', c='31.2304', d='121.05')} <= 5000 AS near, lat BETWEEN 31.1 AND 31.3 AND lon BETWEEN 121.02 AND 121.06 AS boxed FROM ev")
def geo_within_bbox(spark, d):
    return events(spark, d).select("event_id", S.geo_within(F.col("p"), 31.2304, 121.05, 5000).alias("near"), S.geo_bbox(F.col("p"), 31.1, 121.02, 31.3, 121.06).alias("boxed"))


@query(f"""WITH {EV}, f AS (SELECT event_id, lat, lon, sqrt(lon * lon + lat * lat) + 0.00002 * sin(lat * pi() * 3000 / 180) AS z, atan2(lat, lon) + 0.000003 * cos(lon * pi() * 3000 / 180) AS t FROM ev)
SELECT event_id, round(z * sin(t) + 0.006, 6) AS lat, round(z * cos(t) + 0.0065, 6) AS lon, true AS back FROM f""")
def geo_transform(spark, d):
    e = events(spark, d).select("event_id", "p", S.geo_transform(F.col("p"), "gcj02", "bd09").alias("q"), S.geo_transform(S.geo_transform(F.col("p"), "wgs84", "bd09"), "bd09", "wgs84").alias("w"))
    back = (F.abs(F.col("w.lat") - F.col("p.lat")) < 1e-5) & (F.abs(F.col("w.lon") - F.col("p.lon")) < 1e-5)
    return e.select("event_id", F.round("q.lat", 6).alias("lat"), F.round("q.lon", 6).alias("lon"), back.alias("back"))


# --- vectors, text, documents


def _vector(spark, d) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]  # one row


def _knn(metric: str, expr: str):
    return f"SELECT e.vec_id, round({expr}, 4) AS distance FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY {expr}, vec_id LIMIT 10"


@query(_knn("cosine", "list_cosine_distance(e.embedding::DOUBLE[], q::DOUBLE[])"))
def knn_cosine(spark, d):
    return V.knn(read(spark, d, "embeddings"), "embedding", _vector(spark, d), 10, "cosine", "vec_id").select("vec_id", r4(F.col("distance"), "distance"))


@query(_knn("l2", "list_distance(e.embedding::DOUBLE[], q::DOUBLE[])"))
def knn_l2(spark, d):
    return V.knn(read(spark, d, "embeddings"), "embedding", _vector(spark, d), 10, "l2", "vec_id").select("vec_id", r4(F.col("distance"), "distance"))


@query(_knn("inner", "-list_inner_product(e.embedding::DOUBLE[], q::DOUBLE[])"))
def knn_inner(spark, d):
    return V.knn(read(spark, d, "embeddings"), "embedding", _vector(spark, d), 10, "inner_product", "vec_id").select("vec_id", r4(F.col("distance"), "distance"))


@query("SELECT e.vec_id, round(1 / (1 + list_distance(e.embedding::DOUBLE[], q::DOUBLE[])), 4) AS score FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE label < 5 ORDER BY list_distance(e.embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def vector_search(spark, d):
    return V.vector_search(read(spark, d, "embeddings").where("label < 5"), "embedding", _vector(spark, d), 10, "l2", "vec_id").select("vec_id", r4(F.col("vector_score"), "score"))


BM25 = r"""t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
"""
SCORE = "ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"


@query(f"""WITH {BM25} h AS (SELECT doc_id, len(ts) AS dl, w, len(list_filter(ts, lambda x: x = w)) AS tf FROM t, (SELECT unnest(['the', 'of', 'tion']) AS w)),
f AS (SELECT w, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(sum({SCORE}), 4) AS bm25 FROM h JOIN f USING (w), n WHERE tf > 0 GROUP BY doc_id HAVING count(*) = 3""")
def bm25_all_terms(spark, d):
    return T.bm25(read(spark, d, "documents"), "doc_id", "text", ["the", "of", "tion"]).select("doc_id", r4(F.col("bm25"), "bm25"))


@query(f"""WITH {BM25} h AS (SELECT doc_id, len(ts) AS dl, len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the')) AS tf FROM t),
f AS (SELECT count(*) AS df FROM h WHERE tf > 0) SELECT doc_id, round({SCORE}, 4) AS bm25 FROM h, f, n WHERE tf > 0""")
def phrase_match(spark, d):
    return T.phrase(read(spark, d, "documents"), "doc_id", "text", ["of", "the"]).select("doc_id", r4(F.col("bm25"), "bm25"))


@query(f"""WITH {BM25} h AS (SELECT doc_id, len(ts) AS dl, len(list_filter(range(1, len(ts) + 1), lambda i: ts[i] = 'the' AND list_contains(ts[greatest(1, i - 3):i + 3], 'of'))) AS tf FROM t),
f AS (SELECT count(*) AS df FROM h WHERE tf > 0) SELECT doc_id, round({SCORE}, 4) AS bm25 FROM h, f, n WHERE tf > 0""")
def near_match(spark, d):
    return T.near(read(spark, d, "documents"), "doc_id", "text", ["the", "of"], 3).select("doc_id", r4(F.col("bm25"), "bm25"))


@query(r"SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) WHERE damerau_levenshtein(regexp_replace(term, '[^a-z0-9]', '#', 'g'), 'ereing') <= 2")
def fuzzy_match(spark, d):
    return T.fuzzy_terms(read(spark, d, "documents"), "text", "ereing")


BM25_OR = f"""{BM25} h AS (SELECT doc_id, len(ts) AS dl, w, len(list_filter(ts, lambda x: x = w)) AS tf FROM t, (SELECT unnest(['the', 'of']) AS w)),
f AS (SELECT w, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1),
o AS (SELECT doc_id, sum({SCORE}) AS bm25, count(*) AS terms FROM h JOIN f USING (w), n WHERE tf > 0 GROUP BY doc_id)"""


@query(f"WITH {BM25_OR} SELECT doc_id, round(bm25, 4) AS bm25 FROM o")
def bm25_or(spark, d):
    return T.bm25(read(spark, d, "documents"), "doc_id", "text", ["the", "of"], "or").select("doc_id", r4(F.col("bm25"), "bm25"))


@query(f"WITH {BM25_OR} SELECT doc_id, round(bm25, 4) AS bm25 FROM o")
def bm25_index(spark, d):
    """From a stored index: written first, then only the asked terms' postings are read."""
    path = scratch_path(spark, "text-index")
    T.store(read(spark, d, "documents"), "doc_id", "text", path)
    return T.search(spark, path, "doc_id", ["the", "of"], "or").select("doc_id", r4(F.col("bm25"), "bm25"))


@query(f"WITH {BM25_OR} SELECT doc_id, lang, round(bm25, 4) AS score FROM o JOIN documents USING (doc_id) WHERE terms = 2 AND lang <> 'fr' ORDER BY bm25 DESC, doc_id LIMIT 20")
def match_sql(spark, d):
    db = dialect.Database(spark)
    db.table("documents", read(spark, d, "documents"))
    out = db.sql("SELECT doc_id, lang, bm25_score() AS score FROM documents WHERE match(text, 'The of') AND lang <> 'fr' ORDER BY score DESC, doc_id LIMIT 20")
    return out.select("doc_id", "lang", r4(F.col("score"), "score"))


@query(f"""WITH {BM25_OR}, v AS (SELECT vec_id AS doc_id, 1 - list_cosine_distance(e.embedding::DOUBLE[], q::DOUBLE[]) / 2 AS c FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)),
b AS (SELECT doc_id, coalesce(bm25, 0) AS bm25, coalesce(c, 0) AS vector_score, 0.5 * coalesce(bm25 / (SELECT max(bm25) FROM o), 0) + 0.5 * coalesce(c, 0) AS hybrid_score FROM o FULL JOIN v USING (doc_id))
SELECT doc_id, round(bm25, 4) AS bm25, round(vector_score, 4) AS vector_score, round(hybrid_score, 4) AS hybrid_score FROM b ORDER BY hybrid_score DESC, doc_id LIMIT 50""")
def hybrid_search(spark, d):
    text = T.bm25(read(spark, d, "documents"), "doc_id", "text", ["the", "of"], "or")
    near = V.scored(read(spark, d, "embeddings"), "embedding", _vector(spark, d)).withColumnRenamed("vec_id", "doc_id")
    best = V.hybrid(text, near, "doc_id").orderBy(F.desc("hybrid_score"), "doc_id").limit(50)
    return best.select("doc_id", *[r4(F.col(c), c) for c in ("bm25", "vector_score", "hybrid_score")])


@query("SELECT count(*) AS queries, true AS found FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, d):
    """At the index's defaults, of the ten nearest of every twentieth vector, nine tenths or more are found among all."""
    e, path = read(spark, d, "embeddings").select("vec_id", "embedding"), scratch_path(spark, "ivf")
    asked = e.where("vec_id % 20 = 0")
    got = V.IvfIndex().build(e, "embedding", path).search_many(asked, "vec_id", "embedding", 10)
    true = V.nearest_many(e, asked, "vec_id", "embedding", 10).select("query", "vec_id")
    hits = true.join(got.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    found = hits.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("found"))  # one row
    return asked.agg(F.count(F.lit(1)).alias("queries")).crossJoin(F.broadcast(found))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def json_filter(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("document"))
    return D.find(e, {"gte": ["$.k", 50]}, {"k": "$.k"}).withColumnRenamed("id", "event_id")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS g, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_group(spark, d):
    k = S.json_typed(F.col("props"), "$.k", "bigint")
    return read(spark, d, "events").groupBy((k % 10).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT role, count(*) AS n, min(turn) AS first FROM conversations WHERE turn < 4 GROUP BY 1")
def doc_pipeline(spark, d):
    c = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.to_json(F.struct("turn", "role")).alias("document"))
    out = D.aggregate(c, [{"match": {"lt": ["$.turn", 4]}}, {"group": {"by": {"role": "$.role"}, "make": {"n": ("count", None), "first": ("min", "$.turn")}}}])
    return out.select(S.json_value(F.col("document"), "$.role").alias("role"), S.json_typed(F.col("document"), "$.n", "bigint").alias("n"), S.json_typed(F.col("document"), "$.first", "bigint").alias("first"))


@query("SELECT i AS value, count(*) AS n FROM (SELECT unnest([lang, source]) AS i FROM documents) GROUP BY 1")
def doc_pipeline_unwind(spark, d):
    c = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct(F.array("lang", "source").alias("tags"))).alias("document"))
    out = D.aggregate(c, [{"unwind": "$.tags"}, {"group": {"by": {"value": "$.tags"}, "make": {"n": ("count", None)}}}])
    return out.select(S.json_value(F.col("document"), "$.value").alias("value"), S.json_typed(F.col("document"), "$.n", "bigint").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 5 AS k, event_type AS kind FROM events")
def doc_update(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(S.json_typed(F.col("props"), "$.k", "bigint").alias("k"), F.col("event_type").alias("type"))).alias("document"))
    out = D.update(e, {"$inc": {"k": 5}, "$rename": {"type": "kind"}})
    return out.select("event_id", S.json_typed(F.col("document"), "$.k", "bigint").alias("k"), S.json_value(F.col("document"), "$.kind").alias("kind"))


# --- table functions, platform, dialect


@query(f"WITH {EV} SELECT user_id, time, max(CASE WHEN event_type = 'view' THEN value END) AS view, max(CASE WHEN event_type = 'click' THEN value END) AS click FROM ev GROUP BY user_id, time")
def telemetry_pivot(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("device_id"), F.col("event_type").alias("key"), "time", "value")
    return P.pivot(e, ["view", "click"]).select(F.col("device_id").alias("user_id"), "time", "view", "click")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE time > 1706745600000 - 7 * 86400000")
def retention(spark, d):
    return P.retain(events(spark, d), "time", 7 * 86_400_000, 1_706_745_600_000).select("event_id")


@query(f"""WITH {EV}, b AS (SELECT user_id, min(time) AS a, max(time) AS b, count(x) AS n FROM ev WHERE x IS NOT NULL GROUP BY 1),
f AS (SELECT user_id, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, coalesce(regr_slope(x, (time - a) / 1000.0), 0) AS k, avg(x) AS my, avg((time - a) / 1000.0) AS mx FROM ev JOIN b USING (user_id) WHERE x IS NOT NULL GROUP BY 1)
SELECT user_id, b + greatest(1, (b - a) // (n - 1)) * h AS time, round(my - k * mx + k * (b + greatest(1, (b - a) // (n - 1)) * h - a) / 1000.0, 3) AS value FROM f, (SELECT unnest(range(1, 4)) AS h) WHERE n >= 2""")
def forecast_linear(spark, d):
    return R.forecast_linear(events(spark, d), ["user_id"], "time", "x", 3).select("user_id", "time", F.round("value", 3).alias("value"))


@query()
def forecast_hw(spark, d):
    return R.forecast_holt_winters(events(spark, d), ["user_id"], "time", "x", 3, 4)


@query(f"""WITH {EV}, b AS (SELECT user_id AS device_id, event_type AS key, (time - 1704067200000) // 86400000 AS b, count(*) AS n, avg(value) AS m, min(time) AS t, min(value) AS single FROM ev WHERE time >= 1704067200000 AND time < 1705276800000 GROUP BY 1, 2, 3)
SELECT device_id, key, CASE WHEN n = 1 THEN t ELSE 1704067200000 + (b + 1) * 86400000 END AS time, round(CASE WHEN n = 1 THEN single ELSE m END, 4) AS value FROM b""")
def telemetry_window(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("device_id"), F.col("event_type").alias("key"), "time", "value")
    return P.window(e, 1704067200000, 1705276800000, 86_400_000, "mean").select("device_id", "key", "time", r4(F.col("value"), "value"))


@query(f"WITH {EV} SELECT user_id AS device_id, event_type AS key, max(time) AS time, arg_max(value, time) AS value FROM ev GROUP BY 1, 2")
def telemetry_latest(spark, d):
    return P.latest(events(spark, d).select(F.col("user_id").alias("device_id"), F.col("event_type").alias("key"), "time", "value"))


@query(f"""WITH {EV} SELECT event_id, 'start>big>end' AS path, value * 2 AS score FROM ev WHERE value > 100 UNION ALL
SELECT event_id, 'start>all>end' AS path, value + 1 AS score FROM ev WHERE event_type = 'click'""")
def rule_dag(spark, d):
    tasks = [P.Task("big", {"score": "value * 2"}), P.Task("all", {"score": "value + 1"})]
    flows = [P.Flow("start", "big", "value > 100"), P.Flow("start", "all", "event_type = 'click'"), P.Flow("big", "end"), P.Flow("all", "end", "score > 0")]
    return P.run_rules(events(spark, d).select("event_id", "event_type", "value"), tasks, flows).select("event_id", "path", "score")


@query(f"WITH {EV}, l AS (SELECT user_id AS device_id, max(time) AS last_ms FROM ev GROUP BY 1) SELECT device_id, last_ms FROM l WHERE (SELECT max(last_ms) FROM l) - last_ms > 3600 * 1000")
def device_inactive(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("device_id"), "time")
    now = e.agg(F.max("time")).first()[0]  # one row
    return P.inactive(e, e.select("device_id").distinct().withColumn("timeout", F.lit(3600)), now)


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 20 GROUP BY 1 HAVING count(*) > 1")
def json_side_sql(spark, d):
    rows = read(spark, d, "events").select(F.to_json(F.struct("event_type", F.struct("value").alias("m"))).alias("document"))
    out = jsonsql.run(rows, "SELECT event_type AS kind, COUNT(*) AS n, SUM(m.value) AS total FROM input WHERE m.value > 20 GROUP BY event_type HAVING n > 1")
    return out.select("kind", F.col("n").cast("long").alias("n"), F.round(F.col("total").cast("double"), 2).alias("total"))


@query("SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def streaming_tumbling(spark, d):
    """The batch's buckets by way of a stream that takes what is there and ends."""
    batch = read(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    path, check = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    source = spark.readStream.schema(read(spark, d, "events").schema).option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    made = continuous.tumbling(source.select(*[F.col(c).cast(t) for c, t in batch.dtypes]), "ts", "1 hour", "40 days", ["event_type"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 2))
    continuous.run_available(made, lambda df, i: df.write.mode("overwrite").parquet(path), check, "complete")
    return spark.read.parquet(path)


def database(spark: SparkSession, d: str) -> dialect.Database:
    db = dialect.Database(spark)
    db.measurement("ev", events(spark, d), "time", ["user_id", "event_id", "event_type"], ["value", "x", "p"])
    db.measurement("series", events(spark, d).select("user_id", "time", "value", "x", "p"), "time", ["user_id"], ["value", "x", "p"])
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        db.table(t, read(spark, d, t))
    return db


@query(f"WITH {EV} SELECT time // 86400000 * 86400000 AS time, round(avg(value), 4) AS mean, count(*) AS n FROM ev WHERE value > 10 GROUP BY 1")
def dialect_bucket(spark, d):
    out = database(spark, d).sql("SELECT time, avg(value) AS mean, count(*) AS n FROM ev WHERE value > 10 GROUP BY time(1d)")
    return out.select("time", r4(F.col("mean"), "mean"), "n")


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) GROUP BY 1 HAVING count(*) >= 10")
def dialect_relational(spark, d):
    return database(spark, d).sql("SELECT c_mktsegment AS seg, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) GROUP BY c_mktsegment HAVING count(*) >= 10")


@query(f"WITH {EV}, w AS (SELECT *, CASE WHEN time > lag(time) OVER w THEN (value - lag(value) OVER w) * 60000.0 / (time - lag(time) OVER w) END AS r FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time)) SELECT user_id, time, round(r, 4) AS r FROM w WHERE value > 20")
def dialect_window(spark, d):
    return database(spark, d).sql("SELECT user_id, time, derivative(value, 1m) AS r FROM series WHERE value > 20").select("user_id", "time", r4(F.col("r"), "r"))


@query(f"WITH {EV} SELECT DISTINCT time // 86400000 * 86400000 AS day, event_type AS kind FROM ev ORDER BY day DESC, kind LIMIT 7")
def dialect_distinct(spark, d):
    db = database(spark, d)
    db.measurement("days", events(spark, d).withColumn("day", F.floor(F.col("time") / 86400000) * 86400000), "time", ["event_type", "day"], ["value"])
    return db.sql("SELECT DISTINCT day, event_type AS kind FROM days ORDER BY day DESC, kind LIMIT 7")


@query("SELECT DISTINCT o_orderstatus AS s, o_custkey AS c FROM orders ORDER BY c DESC, s LIMIT 9 OFFSET 2")
def dialect_distinct_table(spark, d):
    return database(spark, d).sql("SELECT DISTINCT o_orderstatus AS s, o_custkey AS c FROM orders ORDER BY c DESC, s LIMIT 9 OFFSET 2")


@query(f"WITH {EV}, w AS (SELECT *, CASE WHEN time > lag(time) OVER w THEN (value - lag(value) OVER w) * 60000.0 / (time - lag(time) OVER w) END AS r FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time)) SELECT user_id, time, round(r, 4) AS r FROM w ORDER BY w.r DESC NULLS LAST, time, user_id LIMIT 10")
def dialect_order_alias(spark, d):
    return database(spark, d).sql("SELECT user_id, time, derivative(value, 1m) AS r FROM series ORDER BY r DESC, time, user_id LIMIT 10").select("user_id", "time", r4(F.col("r"), "r"))


@query(f"WITH {EV} SELECT user_id, count(value) AS n, round(max(value) - min(value), 4) AS width, round(avg(value) * 2, 4) AS twice FROM ev GROUP BY 1 HAVING count(value) > 20 AND max(value) - min(value) > 100 AND user_id <> 0")
def dialect_having(spark, d):
    out = database(spark, d).sql("SELECT user_id, count(value) AS n, max(value) - min(value) AS width, avg(value) * 2 AS twice FROM series GROUP BY user_id HAVING count(value) > 20 AND spread(value) > 100 AND user_id <> 0")
    return out.select("user_id", "n", r4(F.col("width"), "width"), r4(F.col("twice"), "twice"))


@query(TRAJ + f""", t AS (SELECT user_id, round(coalesce(sum(m), 0), 1) AS length, count(*) AS n FROM q GROUP BY 1),
b AS (SELECT user_id, floor(value / 50.0) AS b, count(*) AS n FROM ev GROUP BY 1, 2), h AS (SELECT user_id, '{{' || string_agg('"[' || printf('%.1f', b * 50.0) || ',' || printf('%.1f', (b + 1) * 50.0) || ')":' || n, ',' ORDER BY b) || '}}' AS bins FROM b GROUP BY 1)
SELECT user_id, length, n, bins FROM t JOIN h USING (user_id)""".replace("ORDER BY time, event_id)),", "ORDER BY time)),", 1))
def dialect_aggregates(spark, d):
    out = database(spark, d).sql("SELECT user_id, trajectory_length(p) AS length, count(*) AS n, histogram(value, 50) AS bins FROM series GROUP BY user_id")
    return out.select("user_id", F.round("length", 1).alias("length"), "n", "bins")


@query("SELECT r_regionkey AS id, r_name AS label, NULL::DOUBLE AS score FROM region UNION ALL SELECT 100, 'more', 1.5")
def dialect_ddl(spark, d):
    """CREATE, ALTER and INSERT, then what the table holds."""
    db = dialect.Database(spark)
    db.sql("CREATE TABLE places (id INT PRIMARY KEY, name STRING NOT NULL)")
    db.table("places", db.tables["places"].unionByName(read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))))
    db.sql("ALTER TABLE places ADD COLUMN score FLOAT")
    db.sql("ALTER TABLE places RENAME COLUMN name TO label")
    db.sql("CREATE UNIQUE INDEX by_id ON places (id)")
    db.sql("INSERT INTO places (id, label, score) VALUES (100, 'more', 1.5)")
    return db.sql("SELECT id, label, score FROM places")


@query("SELECT conv_id::VARCHAR AS id, count(*) AS n FROM conversations WHERE turn = 1 GROUP BY 1")
def dialect_import_json(spark, d):
    path, db = scratch_path(spark, "lines"), dialect.Database(spark)
    read(spark, d, "conversations").where("turn = 1").select(F.to_json(F.struct(F.col("conv_id").alias("id"), "text")).alias("value")).write.text(path)
    db.sql("CREATE COLLECTION convs")
    db.sql(f"IMPORT JSON '{path}' INTO convs FORMAT lines")
    return db.sql("SELECT id, count(*) AS n FROM convs GROUP BY id")
