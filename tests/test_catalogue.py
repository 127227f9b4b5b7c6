"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemill import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(frame, columns):
    return sorted(tuple(map(norm, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_holt_winters_has_the_digits_of_its_sql(spark):
    """On a table where sums in another order, or rounding of decimal digits, change the fourth digit of some rows."""
    larger = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{larger}/events.parquet'")
    want = dict(con.execute(catalogue.ORACLE_SQL["holt_winters"]).fetchall())
    assert {r.event_id: r.s for r in catalogue.QUERIES["holt_winters"](spark, larger).collect()} == want


def test_distinct_count_holds_no_sketch_for_each_value(spark, tmp_path):
    """Rows without a type are a group too."""
    spark.sql("SELECT id AS event_id, timestamp_micros(id) AS ts, id % 5 AS user_id, IF(id % 3 = 0, NULL, 'a') AS event_type, IF(id % 7 = 0, NULL, CAST(id % 50 AS double)) AS value, '{}' AS props FROM range(600)").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["distinct_count"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", True), (None, True)]
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("approx_count_distinct" in x and "value" in x.partition("keys=[")[2].partition("]")[0] for x in plan)
