"""Sources, documents, full text, platform, dialect, user functions and streams on tiny inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalar as S
from tidemill.functions.registry import Functions
from tidemill.operators import documents as D
from tidemill.operators import fulltext as T
from tidemill.operators import stateful as R
from tidemill.operators import telemetry as P
from tidemill.operators import vector as V
from tidemill.plans import dialect, jsonsql
from tidemill.plans.expression import DialectError, Parser, to_sql
from tidemill.sources import ingest
from tidemill.streaming import continuous as C


def test_line_protocol(spark):
    lines = ["# note", "", 'cpu,host=a\\ b,region=x usage=1.5,n=3i,ok=true,label="say \\"hi, you\\"" 1704067200000000000', "cpu,host=c usage=2 1704067201000000000"]
    points = ingest.line_protocol(spark.createDataFrame([(x,) for x in lines], "value string"))
    wide = ingest.wide(points, "cpu", ["host", "region"], {"usage": "double", "n": "bigint", "ok": "boolean", "label": "string"})
    rows = [tuple(r) for r in wide.orderBy("time").collect()]
    assert rows == [(1704067200000, "a b", "x", 1.5, 3, True, 'say "hi, you"'), (1704067201000, "c", None, 2.0, None, None, None)]
    with pytest.raises(ValueError):
        ingest.parse_line("cpu")


def test_json_points_bulk_and_detection(spark):
    payload = json.dumps({"m": "cpu", "precision": "s", "points": [{"t": 5, "tags": {"h": "a"}, "fields": {"v": 1.5}}]})
    r = ingest.json_points(spark.createDataFrame([(payload,)], "value string")).first()
    assert (r.measurement, r.time, r.tags, r.fields) == ("cpu", 5000, {"h": "a"}, {"v": "1.5"})
    rows = ingest.bulk_values(spark, "INSERT INTO m (time, h, v) VALUES (1, 'it''s, (x)', 2), (2, NULL, 2.5)").collect()
    assert [tuple(r) for r in rows] == [(1, "it's, (x)", 2.0), (2, None, 2.5)]
    assert [ingest.detect(x) for x in (payload, "INSERT INTO m", "cpu v=1")] == ["json", "bulk", "line"]


def test_json_files_and_changes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 7, "v": 1}, {"v": [1, 2]}]')
    (tmp_path / "b.json").write_text('{"k": "x"}\n\n{"k": "y"}\n')
    assert [(r.ordinal, r.id) for r in ingest.json_each(spark, str(tmp_path / "a.json")).collect()] == [(0, "7"), (1, "1")]
    assert sorted(r.id for r in ingest.json_each(spark, str(tmp_path / "b.json"), id_path="$.k").collect()) == ["x", "y"]
    t = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "id bigint, v double")
    assert {r.id: r.v for r in ingest.update(t, {"v": "v + 1"}, "v > 2").collect()} == {1: 6.0, 2: None, 3: 1.0}
    assert sorted(r.id for r in ingest.delete(t, "v > 2").collect()) == [2, 3]
    assert [r.id for r in ingest.cascade(t, "id", t.where("id < 3"), "id").collect()] == [3]


def test_document_filters_pipeline_and_updates(spark):
    docs = [("a", {"n": 1, "t": ["x", "y"], "z": None}), ("b", {"n": 2, "t": "x"}), ("c", {"s": "hello"}), ("d", {"n": "2", "t": []})]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id string, document string")
    ids = lambda tree: sorted(r.id for r in D.find(df, tree).collect())
    assert ids({"ne": ["$.n", 1]}) == ["b", "d"]
    assert ids({"exists": "$.z"}) == ["a"] and ids({"eq": ["$.z", None]}) == ["a"]
    assert ids({"or": [{"in": ["$.n", [1]]}, {"contains": ["$.s", "ell"]}]}) == ["a", "c"]
    assert ids({"contains": ["$.t", "y"]}) == ["a"]
    assert ids({"not": {"gte": ["$.n", 2]}}) == ["a", "c"]
    un = D.aggregate(df, [{"unwind": "$.t"}, {"group": {"by": {"t": "$.t"}, "make": {"n": ("count", None)}}}]).collect()
    assert {json.loads(r.document)["t"]: json.loads(r.document)["n"] for r in un} == {"x": 2, "y": 1}
    assert D.aggregate(df.limit(0), [{"group": {"make": {"n": ("count", None)}}}]).count() == 0
    assert json.loads(D.aggregate(df.limit(0), [{"count": "n"}]).first().document) == {"n": 0}
    doc = D.apply_update({"a": 1, "l": [1, 2, 1], "b": {"c": 3}}, {"$set": {"x.y": 5}, "$inc": {"a": 2}, "$pull": {"l": 1}, "$rename": {"b.c": "d"}, "$max": {"m": 4}})
    assert doc == {"a": 3, "l": [2], "b": {}, "x": {"y": 5}, "d": 3, "m": 4}
    with pytest.raises(ValueError, match="conflict"):
        D.apply_update({}, {"$set": {"a": 1}, "$inc": {"a.b": 1}})
    new = {r.id: json.loads(r.document) for r in D.update(df, {"$addToSet": {"t": "q"}}, {"exists": "$.s"}).collect()}
    assert new["c"] == {"s": "hello", "t": ["q"]} and new["b"] == docs[1][1]
    good, bad = D.validate(df, required=["$.n"], minimum={"$.n": 2})
    assert (good.count(), bad.count()) == (2, 2)


def test_full_text(spark):
    assert spark.createDataFrame([("Größe x2, 数据库 a",)], "t string").select(T.tokens(F.col("t")).alias("u"), T.tokens(F.col("t"), "cjk").alias("c")).first() == (["größe", "x2", "数", "据", "库", "a"], ["größe", "x2", "数据", "据库", "a"])
    df = spark.createDataFrame([(1, "pump failed at site"), (2, "site pump pump ok"), (3, "valve stuck"), (4, "pump near the old site")], "id bigint, text string")
    assert [r.id for r in T.rank(T.bm25(df, "id", "text", ["pump", "site"]), "id", 2).collect()] == [2, 1]
    assert sorted(r.id for r in T.phrase(df, "id", "text", ["pump", "failed"]).collect()) == [1]
    assert sorted(r.id for r in T.near(df, "id", "text", ["pump", "site"], 2).collect()) == [2]
    assert sorted(r.id for r in T.near(df, "id", "text", ["pump", "site"], 3, ordered=True).collect()) == [1]
    assert sorted(r.id for r in T.fuzzy(df, "id", "text", "vavle").collect()) == [3]
    assert T.edit_distance("ab", "ba", 2) == 1 and T.edit_distance("abc", "xyz", 1) == 2


def test_vectors(spark, tmp_path):
    rows = [(i, [float(i % 10), float(i // 10), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    q = [3.2, 4.1, 1.0]
    exact = [r.id for r in V.knn(df, "v", q, 5, "l2", "id").collect()]
    index = V.IvfIndex(lists=4, probes=4).build(df, "v", str(tmp_path / "ivf"))
    assert [r.id for r in index.search(spark, "v", q, 5, "l2", "id").collect()] == exact and exact[0] == 43
    back = V.quantize8(df, "v").select(V.restore8(F.col("code")).alias("r"), "v").collect()
    assert all(abs(a - b) < 0.03 for r in back for a, b in zip(r.r, r.v, strict=True))


def test_geography(spark):
    r = spark.range(1).select(
        S.geo_distance(S.point(F.lit(0.0), F.lit(0.0)), S.point(F.lit(0.0), F.lit(1.0))).alias("d"),
        S.geo_bearing(S.point(F.lit(0.0), F.lit(0.0)), S.point(F.lit(0.0), F.lit(-1.0))).alias("b"),
        S.in_polygon(S.point(F.lit(0.5), F.lit(0.5)), [(0, 0), (0, 1), (1, 1), (1, 0)]).alias("inside"),
        S.in_polygon(S.point(F.lit(1.5), F.lit(0.5)), [(0, 0), (0, 1), (1, 1), (1, 0)]).alias("outside"),
        S.geohash32(S.point(F.lit(0.0), F.lit(0.0))).alias("h"),
        S.geo_transform(S.point(F.lit(51.5), F.lit(-0.1)), "wgs84", "gcj02")["lat"].alias("same"),
    ).first()
    assert abs(r.d - 111195.08) < 1 and r.b == 270 and r.inside and not r.outside and r.h == 0xC0000000 and r.same == 51.5


def test_platform(spark):
    rows = [(1, "t", 0, 1.0), (1, "t", 500, 5.0), (1, "t", 700, 3.0), (1, "t", 1500, 9.0)]
    df = spark.createDataFrame(rows, "device_id bigint, key string, time bigint, value double")
    got = {m: sorted((r.time, r.value) for r in P.window(df, 0, 2000, 1000, m).collect()) for m in ("mean", "median", "last", "sum")}
    assert got == {"mean": [(1000, 3.0), (1500, 9.0)], "median": [(1000, 3.0), (1500, 9.0)], "last": [(1000, 3.0), (1500, 9.0)], "sum": [(1000, 9.0), (1500, 9.0)]}
    assert P.latest(df, "t;u").first() == (1, "t", 1500, 9.0)
    with pytest.raises(ValueError):
        P.run_rules(df, [P.Task("a")], [P.Flow("start", "a"), P.Flow("a", "a")], 3)


def test_dialect(spark):
    db = dialect.Database(spark)
    db.sql("INSERT INTO cpu (time, host, usage) VALUES (0, 'a', 1.0), (60000, 'a', 3.0), (61000, 'a', 7.0), (0, 'b', 5.0)")
    q = lambda s, **p: [tuple(r) for r in db.sql(s, **p).collect()]
    assert sorted(q("SELECT time, avg(usage) AS m FROM cpu WHERE host = @h GROUP BY time(1m)", h="a")) == [(0, 1.0), (60000, 5.0)]
    assert q("SELECT time, difference(usage) AS d FROM cpu WHERE host = 'a' AND usage > 2 ORDER BY time") == [(60000, 2.0), (61000, 4.0)]
    assert q("SELECT time, ewma(usage, 0.5) AS e FROM cpu WHERE host = 'a' ORDER BY time LIMIT 2 OFFSET 1") == [(60000, 2.0), (61000, 4.5)]
    assert q("SELECT first(usage) AS f, last(usage) AS l, spread(usage) AS s FROM cpu WHERE host = 'a'") == [(1.0, 7.0, 6.0)]
    assert q("SELECT count(*) AS n FROM cpu WHERE host = 'none'") == []
    assert len(q("SELECT * FROM forecast(cpu, usage, 2, 'linear') WHERE host = 'a'")) == 2
    db.table("sales", spark.createDataFrame([(1, "north", 70), (2, "north", 50), (3, "south", 20), (4, "west", 200)], "id int, region string, amount int"))
    assert sorted(q("SELECT region, count(*) AS n, sum(amount) AS t FROM sales GROUP BY region HAVING sum(amount) >= 100")) == [("north", 2, 120), ("west", 1, 200)]
    assert q("SELECT CASE WHEN amount > 60 THEN 'hi' ELSE 'lo' END AS c FROM sales WHERE region NOT LIKE 'n%' AND id IN (SELECT max(id) FROM sales) ORDER BY id FETCH FIRST 1 ROWS ONLY") == [("hi",)]
    assert q("UPDATE sales SET amount = amount + 1 WHERE region = 'south'") == [(1,)]
    assert q("DELETE FROM sales WHERE amount < 60") == [(2,)]
    assert sorted(q("SELECT id FROM sales")) == [(1,), (4,)]
    assert ("host", "tag", "string") in q("DESCRIBE cpu")
    assert "Scan" in " ".join(r[0] for r in q("EXPLAIN SELECT * FROM sales"))
    db.functions.scalar("twice", lambda x: x * 2, "double")
    assert q("SELECT time, twice(usage) AS t FROM cpu WHERE host = 'b'") == [(0, 10.0)]
    assert db.functions.unregister("twice")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    db.table("vecs", vec)
    assert q("SELECT id FROM vecs ORDER BY v <-> [0.0, 2.0] LIMIT 1") == [(2,)] and [r[0] for r in q("SELECT id FROM knn(vecs, v, [1.0, 0.1], 1)")] == [1]
    for bad in ("SELECT", "SELECT a FROM (SELECT 1)", "SELECT a b c FROM t", "SELECT 'x"):
        with pytest.raises(DialectError):
            db.sql(bad)
    assert to_sql(Parser("a + 2 * -b >= 1.5 AND NOT c IS NOT NULL").expression()) == "(((`a` + (2 * (-`b`))) >= 1.5D) AND (NOT (`c` IS NOT NULL)))"


def test_json_sql(spark):
    rows = [{"n": "10", "m": {"s": 1}}, {"n": "9", "m": {"s": 2}}, {"m": {"s": 3}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "document string")
    run = lambda s: [tuple(r) for r in jsonsql.run(df, s).collect()]
    assert run("SELECT n, m.s AS s FROM input WHERE n > 9 ORDER BY s") == [("10", "1")]
    assert run("SELECT m.s AS s FROM input WHERE n = NULL") == [("3",)]
    assert run("SELECT n FROM input ORDER BY n ascnum LIMIT 1, 2") == [("9",), ("10",)]
    ((total, names),) = run("SELECT TOTAL(n) AS t, GROUP_CONCAT(n) AS g FROM input")
    assert float(total) == 19 and sorted(names.split(",")) == ["10", "9"]


def test_user_windows_and_tables(spark):
    db = dialect.Database(spark)
    db.measurement("m", spark.createDataFrame([(0, "a", 1.0), (1, "a", 4.0)], "time bigint, h string, v double"), "time", ["h"], ["v"])
    db.functions.window("peak", lambda: R.ewma_kernel(1.0)())
    assert [tuple(r) for r in db.sql("SELECT time, peak(v) AS p FROM m ORDER BY time").collect()] == [(0, 1.0), (1, 4.0)]
    db.functions.table("ones", lambda s, n: s.range(n))
    assert db.sql("SELECT * FROM ones(3)").count() == 3
    f = Functions(spark)
    f.aggregate("span", lambda v: float(v.max() - v.min()), "double")
    assert spark.sql("SELECT span(id) AS s FROM range(5)").first().s == 4.0


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"k{i % 3}", f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(120)]
    spark.createDataFrame(rows, "id int, k string, t string, x double").selectExpr("id", "k", "to_timestamp(t) AS t", "x").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "id int, k string, t timestamp, x double"
    got: list = []
    C.run_available(C.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "t", "10 minutes", "2 hours", ["k"], n=F.count(F.lit(1)), total=F.sum("x")), lambda df, _: got.extend(df.collect()), str(tmp_path / "c1"), "complete")
    want = spark.read.parquet(str(tmp_path / "in")).groupBy(F.unix_micros(F.window("t", "10 minutes")["start"]).alias("start_us"), "k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()}


def test_key_values(spark):
    from tidemill.operators import kv

    space = spark.createDataFrame([("a", "1", 3, None), ("ab", "x", 1, 50), ("b", "y", 1, None)], kv.SCHEMA)
    rows = lambda df: {r.key: (r.value, r.version) for r in df.collect()}
    new = kv.put(space, spark.createDataFrame([("a", "2", None), ("ab", "z", None), ("c", "q", 900)], "key string, value string, expires_at bigint"), 100)
    assert rows(new) == {"a": ("2", 4), "ab": ("z", 1), "b": ("y", 1), "c": ("q", 1)}
    assert [r.key for r in kv.scan_prefix(space, "a", 10).collect()] == ["a", "ab"] and [r.key for r in kv.scan_prefix(space, "a", 60).collect()] == ["a"]
    done, verdict = kv.compare_and_set(space, spark.createDataFrame([("a", "9", 3), ("b", "9", 7), ("n", "9", 0)], "key string, value string, version bigint"), 10)
    assert {r.key: r.done for r in verdict.collect()} == {"a": True, "b": False, "n": True} and rows(done)["a"] == ("9", 4)
    assert rows(kv.increment(space, spark.createDataFrame([("a", 4), ("a", 1), ("m", 2)], "key string, by bigint"), 10))["a"] == ("6", 4)
    assert sorted(rows(kv.remove(space, space.where("key = 'a'")))) == ["ab", "b"]


def test_hybrid_over_measurements_and_catalog(spark):
    near = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "host string, distance double")
    docs = spark.createDataFrame([("1", '{"host": "a"}'), ("2", '{"host": "b"}')], "id string, document string")
    text = spark.createDataFrame([("2", 4.0)], "id string, bm25 double")
    out = V.hybrid_measurement(near, docs, F.col("host") == F.get_json_object("document", "$.host"), text)
    assert {r.id: round(r.hybrid_score, 6) for r in out.collect()} == {"1": 0.6, "2": 0.6}
    db = dialect.Database(spark)
    db.table("docs", docs)
    assert [tuple(r) for r in db.sql("SELECT table_name, table_type FROM information_schema.tables").collect()] == [("docs", "TABLE")]
    assert db.sql("SELECT * FROM information_schema.columns WHERE column_name = 'id'").first().data_type == "string"


def test_topic(tmp_path):
    t = C.Topic(str(tmp_path / "q"))
    assert [t.publish(["a", "b"], 1000), t.publish(["c"], 5000)] == [0, 2]
    assert [m["body"] for m in t.pull("g", 2)] == ["a", "b"] == [m["body"] for m in t.pull("g", 2)]
    t.ack("g", 1)
    assert [m["body"] for m in t.pull("g", 9)] == ["c"]
    assert t.trim(acked=True) == 2 and [m["offset"] for m in t.read(0, 9)] == [2]
    assert t.trim(max_age_ms=10, now_ms=9000) == 1 and t.next_offset() == 3


def test_many_nearest_without_a_row_for_each_pair(spark, tmp_path):
    """Ties go by id, pairs without a distance are left out, and no plan joins the rows with the queries."""
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(1, 90)] + [(0, [0.0] * 3), (100, None), (120, [1.0]), (140, [float("nan")] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>")
    asked = df.where("vec_id % 20 = 0")
    pairs = df.crossJoin(asked.select(F.col("vec_id").alias("query"), F.col("v").alias("q")))
    index = V.IvfIndex(lists=4, probes=4).build(df.where("vec_id < 100"), "v", str(tmp_path / "ivf"))
    for metric in ("cosine", "l2", "inner_product"):
        every = V.top_per_group(pairs.withColumn("distance", S.distance(F.col("v"), F.col("q"), metric)).where("distance IS NOT NULL"), ["query"], ["distance", "vec_id"], 3).select("query", "vec_id", "distance")
        got = V.nearest_many(df, asked, "vec_id", "v", 3, metric)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, every.collect()))
        found, known = index.search_many(asked, "vec_id", "v", 3, metric), V.nearest_many(df.where("vec_id < 100"), asked, "vec_id", "v", 3, metric)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, known.collect()))
        assert not any("Join" in x._jdf.queryExecution().executedPlan().toString() for x in (got, found))


def test_recall_counts_a_vector_without_neighbours_as_a_query(spark, tmp_path):
    from tidemill import catalogue

    spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(40)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(r) for r in catalogue.QUERIES["ivf_recall"](spark, str(tmp_path)).collect()] == [(2, True)]


def test_stored_index_is_made_where_the_texts_lie(spark, tmp_path, monkeypatch):
    """Without a shuffle, in parts of any size; rows of one key count each, as in bm25."""
    rows = [(1, "a b a"), (1, "c a b"), (2, None), (3, ""), (4, "b a d d"), (None, "a 数"), (5, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    want = sorted([(1, "a", 2, [0, 2]), (1, "b", 1, [1]), (1, "c", 1, [0]), (1, "a", 1, [1]), (1, "b", 1, [2]), (4, "b", 1, [0]), (4, "a", 1, [1]), (4, "d", 2, [2, 3]), (None, "a", 1, [0]), (None, "数", 1, [1]), (5, "x", 1, [0])], key=repr)
    for most in (1, 4, 2_000_000):
        monkeypatch.setattr(T, "AT_ONCE", most, raising=False)
        postings, lengths = T.index(df, "id", "text")
        assert sorted(((r.id, r.term, r.tf, r.positions) for r in postings.collect()), key=repr) == want
        assert sorted(r.dl for r in lengths.collect()) == [0, 0, 1, 2, 3, 3, 4]
        assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
        T.store(df, "id", "text", f"{tmp_path}/{most}")
        got = {r.id: round(r.bm25, 9) for r in T.search(spark, f"{tmp_path}/{most}", "id", ["a", "d"], "or").collect()}
        scores = T.bm25(df, "id", "text", ["a", "d"], "or").groupBy("id").agg(F.sum("bm25").alias("s"))
        assert got == {r.id: round(r.s, 9) for r in scores.collect()}
