"""The SQL dialect over measurements, tables and collections, lowered to DataFrames and Spark SQL.

Relational statements become one Spark SQL statement over temporary views. Statements on a measurement become
DataFrame operations: conditions on time and tags come before per-series functions and reach the scan; conditions
on fields come after them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import aggregates as A
from tidemill.functions import scalar as S
from tidemill.functions import series as W
from tidemill.functions.registry import Functions
from tidemill.operators import fulltext as X
from tidemill.operators import stateful as R
from tidemill.operators import vector as V
from tidemill.sources import ingest

from .expression import Binary, Call, Case, DialectError, Duration, In, Literal, Name, Param, Parser, Select, Star, Subquery, Test, Unary, Vector, rewrite, to_sql, walk


@dataclass
class Measurement:
    df: DataFrame
    time: str
    tags: list[str]
    fields: list[str]


AGGREGATES = {"count", "sum", "min", "max", "avg", "first", "last", "stddev", "variance", "spread", "mode", "median", "percentile", "p50", "p90", "p95", "p99", "distinct_count", "tdigest_agg"}
#: Aggregates that are small plans.
GROUP_PLANS = {"histogram", "centroid", "pid", "pid_estimate", *(f"trajectory_{x}" for x in ("length", "centroid", "bbox", "speed_max", "speed_avg", "speed_p95"))}
#: Per-series functions that are Columns, by their name.
WINDOWS = {n: getattr(W, n) for n in ("difference", "delta", "increase", "derivative", "non_negative_derivative", "rate", "irate", "cumulative_sum", "running_sum", "running_min", "running_max", "moving_average", "fill", "locf", "interpolate")}
#: And those that are small plans.
PLANS = {"integral", "state_changes", "state_duration", "anomaly", "ewma", "holt_winters", "changepoint", "pid_series"}


class Database:
    def __init__(self, spark: SparkSession):
        self.spark, self.functions = spark, Functions(spark)
        self.measurements: dict[str, Measurement] = {}
        self.tables: dict[str, DataFrame] = {}
        self.indexes: dict[str, tuple[str, list[str], bool]] = {}

    def measurement(self, name: str, df: DataFrame, time: str, tags: list[str], fields: list[str]) -> None:
        self.measurements[name.lower()] = Measurement(df, time, tags, fields)
        df.createOrReplaceTempView(name)

    def table(self, name: str, df: DataFrame) -> None:
        self.tables[name.lower()] = df
        df.createOrReplaceTempView(name)

    collection = table

    def sql(self, text: str, **params) -> DataFrame:
        """One statement. Parameters @name and :name come from params."""
        p = Parser(text)
        verb = p.peek().text.lower()
        if verb == "select":
            s = p.select()
            p.end()
            return self._select(s, params)
        if verb == "explain":
            p.next()
            s = p.select()
            p.end()
            plan = self._select(s, params)._jdf.queryExecution().toString()
            return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")
        if verb == "insert":
            return self._insert(text)
        if verb in ("update", "delete"):
            return self._change(p, verb, params)
        if p.accept("show"):
            names = self.measurements if p.next().text.lower() == "measurements" else self.tables
            return self.spark.createDataFrame([(n,) for n in sorted(names)], "name string")
        if p.accept("describe"):
            p.accept("measurement")
            p.accept("table")
            return self._describe(p.identifier().lower())
        if p.accept("drop"):
            p.next()
            name = p.identifier().lower()
            self.measurements.pop(name, None)
            self.tables.pop(name, None)
            self.spark.catalog.dropTempView(name)
            return self.spark.createDataFrame([(name,)], "dropped string")
        if verb == "create":
            return self._create(p)
        if verb == "alter":
            return self._alter(p)
        if p.accept("import"):
            return self._import(p)
        raise DialectError(f"unknown statement: {verb}")

    def _create(self, p: Parser) -> DataFrame:
        """CREATE MEASUREMENT n (c TAG, c FIELD type, ...), CREATE TABLE n (c type ..., ...), CREATE COLLECTION n,
        CREATE [UNIQUE] INDEX n ON t (c, ...): a unique index fails where rows have equal values."""
        p.next()
        unique, kind = p.accept("unique"), p.next().text.lower()
        absent = self._skip(p, "if", "not", "exists")
        name = p.identifier().lower()
        if kind == "index":
            p.expect("on")
            table = p.identifier().lower()
            p.expect("(")
            columns = [p.identifier()]
            while p.accept(","):
                columns.append(p.identifier())
            p.expect(")")
            if unique and self._frame(table).groupBy(*columns).count().where("count > 1").limit(1).count():
                raise DialectError(f"rows of {table} have equal values in {', '.join(columns)}")
            self.indexes[name] = (table, columns, bool(unique))
            return self.spark.createDataFrame([(name,)], "created string")
        if name in self.measurements or name in self.tables:
            if absent:
                return self.spark.createDataFrame([], "created string")
            raise DialectError(f"already there: {name}")
        columns = []
        if p.accept("("):
            while True:
                column, words, depth = p.identifier(), [], 0
                while depth or p.peek().text not in (",", ")"):
                    t = p.next().text.lower()
                    depth += (t == "(") - (t == ")")
                    words.append(t)
                if column.lower() not in ("primary", "foreign", "unique"):
                    columns.append((column, words))
                if not p.accept(","):
                    break
            p.expect(")")
        p.end()
        if kind == "measurement":
            tags = [c for c, w in columns if "tag" in w]
            fields = [c for c, w in columns if c not in tags]
            types = [("time", "bigint"), *[(c, "string") for c in tags], *[(c, self._type([x for x in w if x != "field"])) for c, w in columns if c in fields]]
            self.measurement(name, self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in types)), "time", tags, fields)
        else:
            types = [(c, self._type(w)) for c, w in columns] if kind == "table" else [("id", "string"), ("document", "string")]
            self.table(name, self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in types)))
        return self.spark.createDataFrame([(name,)], "created string")

    @staticmethod
    def _skip(p: Parser, *words: str) -> bool:
        if p.peek().text.lower() != words[0]:
            return False
        for w in words:
            p.expect(w)
        return True

    @staticmethod
    def _type(words: list[str]) -> str:
        known = {"float": "double", "double": "double", "real": "double", "int": "bigint", "integer": "bigint", "long": "bigint", "bigint": "bigint", "bool": "boolean", "boolean": "boolean", "string": "string", "text": "string", "varchar": "string", "json": "string", "datetime": "timestamp", "timestamp": "timestamp", "blob": "binary", "vector": "array<double>", "geopoint": "struct<lat:double,lon:double>"}
        for w in words[:1]:
            if w in known:
                return known[w]
        return "double"

    def _alter(self, p: Parser) -> DataFrame:
        """ALTER TABLE | MEASUREMENT n ADD [COLUMN] c type, DROP [COLUMN] c, RENAME [COLUMN] c TO d, RENAME TO n."""
        p.next()
        p.next()
        name = p.identifier().lower()
        m, df = self.measurements.get(name), self._frame(name)
        verb = p.next().text.lower()
        if verb == "rename" and p.accept("to"):
            new = p.identifier().lower()
            self.spark.catalog.dropTempView(name)
            if m:
                del self.measurements[name]
                self.measurement(new, m.df, m.time, m.tags, m.fields)
            else:
                del self.tables[name]
                self.table(new, df)
            return self.spark.createDataFrame([(new,)], "altered string")
        p.accept("column")
        column = p.identifier()
        if verb == "add":
            words = []
            while p.peek().kind != "end" and p.peek().text != ";":
                words.append(p.next().text.lower())
            df = df.withColumn(column, F.lit(None).cast("string" if "tag" in words else self._type([w for w in words if w != "field"])))
            if m:
                (m.tags if "tag" in words else m.fields).append(column)
        elif verb == "drop":
            if column not in df.columns:
                raise DialectError(f"unknown column: {column}")
            df = df.drop(column)
            if m:
                m.tags, m.fields = ([c for c in cs if c != column] for cs in (m.tags, m.fields))
        elif verb == "rename":
            p.expect("to")
            new = p.identifier()
            df = df.withColumnRenamed(column, new)
            if m:
                m.tags, m.fields = ([new if c == column else c for c in cs] for cs in (m.tags, m.fields))
        else:
            raise DialectError(f"unknown change: {verb}")
        if m:
            self.measurement(name, df, m.time, m.tags, m.fields)
        else:
            self.table(name, df)
        return self.spark.createDataFrame([(name,)], "altered string")

    def _import(self, p: Parser) -> DataFrame:
        """IMPORT JSON 'path' INTO n [FORMAT f] [ID PATH '$.p']: upserts into a collection, appends to a table by property name."""
        p.expect("json")
        path = p.next().text.strip("'")
        p.expect("into")
        name, form, own = p.identifier().lower(), "auto", None
        if p.accept("format"):
            form = p.next().text.lower().strip("'")
        if p.accept("id"):
            p.expect("path")
            own = p.next().text.strip("'")
        p.end()
        rows, df = ingest.json_each(self.spark, path, form, own), self._frame(name)
        if set(df.columns) == {"id", "document"}:
            new = rows.groupBy("id").agg(F.max_by("document", "ordinal").alias("document"))
            self.table(name, df.join(new, "id", "left_anti").select("id", "document").unionByName(new))
        else:
            new = rows.select(*[F.get_json_object("document", f"$.{c}").cast(k).alias(c) for c, k in df.dtypes])
            self.table(name, df.unionByName(new))
        return new.agg(F.count(F.lit(1)).alias("imported"))

    def _describe(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(self._columns(name), "column_name string, role string, data_type string")

    def _columns(self, name: str) -> list[tuple[str, str, str]]:
        if m := self.measurements.get(name):
            rows = [(m.time, "time", dict(m.df.dtypes)[m.time])] + [(c, k, dict(m.df.dtypes)[c]) for k, cs in (("tag", m.tags), ("field", m.fields)) for c in cs]
        elif (t := self.tables.get(name)) is not None:
            rows = [(c, "column", k) for c, k in t.dtypes]
        else:
            raise DialectError(f"unknown name: {name}")
        return rows

    def _insert(self, text: str) -> DataFrame:
        name = text.split()[2].strip('"`').split("(")[0].lower()
        rows = ingest.bulk_values(self.spark, text)
        if m := self.measurements.get(name):
            known = {m.time, *m.tags, *m.fields}
            strings = {c for c, k in rows.dtypes if k == "string"}
            for c in [c for c in rows.columns if c not in known]:
                (m.tags if c in strings and not m.tags else m.fields).append(c)
            self.measurement(name, ingest.insert(m.df, rows), m.time, m.tags, m.fields)
        elif name in self.tables:
            self.table(name, ingest.insert(self.tables[name], rows))
        else:
            tags = [c for c, k in rows.dtypes if k == "string" and c != "time"]
            self.measurement(name, rows, "time", tags, [c for c in rows.columns if c not in {"time", *tags}])
        return rows.agg(F.count(F.lit(1)).alias("inserted"))

    def _change(self, p: Parser, verb: str, params: dict) -> DataFrame:
        p.next()
        if verb == "delete":
            p.expect("from")
        name = p.identifier().lower()
        sets = {}
        if verb == "update":
            p.expect("set")
            while True:
                c = p.identifier()
                p.expect("=")
                sets[c] = to_sql(p.expression(), params)
                if not p.accept(","):
                    break
        where = to_sql(p.expression(), params) if p.accept("where") else "true"
        p.end()
        m = self.measurements.get(name)
        df = m.df if m else self.tables[name]
        n = df.where(where).agg(F.count(F.lit(1)).alias("changed"))
        new = ingest.delete(df, where) if verb == "delete" else ingest.update(df, sets, where)
        if m:
            self.measurement(name, new, m.time, m.tags, m.fields)
        else:
            self.table(name, new)
        return n

    # SELECT

    def information_schema(self, name: str) -> DataFrame:
        """tables or columns of the catalog."""
        if name == "tables":
            rows = [(n, "MEASUREMENT") for n in self.measurements] + [(n, "TABLE") for n in self.tables]
            return self.spark.createDataFrame(sorted(rows), "table_name string, table_type string")
        if name != "columns":
            raise DialectError(f"unknown: information_schema.{name}")
        rows = [(n, i + 1, *r) for n in sorted({*self.measurements, *self.tables}) for i, r in enumerate(self._columns(n))]
        return self.spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, column_role string, data_type string")

    def _select(self, s: Select, params: dict) -> DataFrame:
        src = s.source
        if src is not None and (src.table or "").lower().startswith("information_schema."):
            return self._shape(self.information_schema(src.table.lower().split(".")[1]), s, params)
        if src is not None and src.call is not None:
            return self._shape(self._table_function(src.call, params), s, params)
        if any(isinstance(x, Call) and x.name == "match" for x in walk(s.where)):
            return self._matched(s, params)
        m = self.measurements.get((src.table or "").lower()) if src is not None else None
        plain = m is not None and not s.joins and not any(isinstance(x, Subquery) for x in walk([s.where, s.having]))
        names = [*WINDOWS, *PLANS, *GROUP_PLANS, *self.functions.windows, *(AGGREGATES - {"count", "sum", "min", "max", "avg"})]
        special = any(isinstance(x, Call) and x.name in names for x in walk([*[e for e, _ in s.items], s.having]))
        if m is not None and plain and (special or any(isinstance(g, Call) and g.name == "time" for g in s.groups) or not s.groups):
            return self._measurement(s, m, params)
        return self.spark.sql(to_sql(s, params))

    def _shape(self, df: DataFrame, s: Select, params: dict) -> DataFrame:
        """WHERE, columns, ORDER BY and LIMIT over a table function's rows."""
        if s.where is not None:
            df = df.where(self.column(s.where, params))
        shown = [F.col(f"`{c}`") for c in df.columns] if any(isinstance(e, Star) for e, _ in s.items) else [self.column(e, params).alias(a or self._named(e)) for e, a in s.items]
        return self._finished(df, shown, s, params)

    def _matched(self, s: Select, params: dict) -> DataFrame:
        """SELECT with match(field or *, 'query') among its conditions, and bm25_score() anywhere else."""
        calls = [c for c in self._conjuncts(s.where) if isinstance(c, Call) and c.name == "match"]
        if len(calls) != 1 or s.joins or not s.source or not s.source.table:
            raise DialectError("match() stands once, among the conditions of one table")
        field, query = calls[0].args[-2:] if len(calls[0].args) < 4 else calls[0].args[1:3]
        df = self._frame(s.source.table)
        names = [c for c, k in df.dtypes if k == "string"] if isinstance(field, Star) else [field.parts[-1]]
        rows = X.match(df, names, params[query.name] if isinstance(query, Param) else query.value, "__bm25")
        score = lambda x: Name(["__bm25"]) if isinstance(x, Call) and x.name == "bm25_score" else None
        where = reduce(lambda a, b: Binary("and", a, b), [c for c in self._conjuncts(s.where) if c is not calls[0]], Literal(True))
        plain = replace(s, items=[(x, a or (self._named(e) if not isinstance(e, Star) else None)) for (e, a), x in zip(s.items, [rewrite(e, score) for e, _ in s.items], strict=True)], where=rewrite(where, score), order=[(rewrite(e, score), up) for e, up in s.order])
        if s.groups or any(isinstance(x, Call) and x.name in AGGREGATES for x in walk([e for e, _ in s.items])):
            rows.createOrReplaceTempView("__matched")
            return self.spark.sql(to_sql(replace(plain, source=replace(s.source, table="__matched", alias=s.source.alias or s.source.table)), params))
        rows = rows.where(self.column(plain.where, params))
        shown = [c for e, a in plain.items for c in ([F.col(f"`{x}`") for x in df.columns] if isinstance(e, Star) else [self.column(e, params).alias(a)])]
        return self._finished(rows, shown, plain, params)

    def _finished(self, df: DataFrame, shown: list[Column], s: Select, params: dict) -> DataFrame:
        """Projection, then DISTINCT, then ORDER BY, then LIMIT. A sort key is a shown column if it names or equals one,
        else a column of df, which DISTINCT doesn't allow."""
        out = df.select(*shown)
        texts = {to_sql(e, params): i for i, (e, _) in enumerate(s.items) if not isinstance(e, Star)}
        keys, hidden = [], []
        for k, (e, up) in enumerate(s.order):
            if isinstance(e, Name) and len(e.parts) == 1 and e.parts[0] in out.columns:
                c = F.col(f"`{e.parts[0]}`")
            elif len(shown) == len(s.items) and (i := texts.get(to_sql(e, params))) is not None:
                c = F.col(f"`{out.columns[i]}`")
            elif s.distinct:
                raise DialectError(f"ORDER BY needs a selected column after DISTINCT: {to_sql(e, params)}")
            else:
                hidden.append(self.column(e, params).alias(f"__o{k}"))
                c = F.col(f"__o{k}")
            keys.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        out = out.distinct() if s.distinct else df.select(*shown, *hidden)
        return self._paged(out.orderBy(*keys).drop(*[f"__o{k}" for k in range(len(s.order))]) if keys else out, s)

    @staticmethod
    def _paged(df: DataFrame, s: Select) -> DataFrame:
        df = df.offset(s.offset) if s.offset else df
        return df.limit(s.limit) if s.limit is not None else df

    @staticmethod
    def _named(e) -> str:
        if isinstance(e, Name):
            return e.parts[-1]
        if isinstance(e, Call):
            first = e.args[0] if e.args else None
            return f"{e.name}({'*' if isinstance(first, Star) else first.parts[-1]})" if isinstance(first, (Star, Name)) else e.name
        return "value"

    def _measurement(self, s: Select, m: Measurement, params: dict) -> DataFrame:
        early, late = [], []
        for c in self._conjuncts(s.where):
            used = {x.parts[-1] for x in walk(c) if isinstance(x, Name)}
            (early if used <= {m.time, *m.tags} else late).append(self.column(c, params))
        df = reduce(lambda d, c: d.where(c), early, m.df)
        if s.groups or any(isinstance(x, Call) and x.name in {*AGGREGATES, *GROUP_PLANS, *self.functions.aggregates} for x in walk([e for e, _ in s.items])):
            return self._grouped(s, m, reduce(lambda d, c: d.where(c), late, df), params)
        names = []
        for e, a in s.items:
            names += [(Name([c]), c) for c in (m.time, *m.tags, *m.fields)] if isinstance(e, Star) else [(e, a or self._named(e))]
        used = {x.parts[-1] for x in walk([e for e, _ in names] + self._conjuncts(s.where)) if isinstance(x, Name)} & set(m.fields) or set(m.fields[:1])
        df = df.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in sorted(used)])) if used else df
        series, made = W.Series(tuple(m.tags), m.time), []
        for i, (e, name) in enumerate(names):
            if isinstance(e, Call) and (e.name in PLANS or e.name in self.functions.windows):
                df = self._plan(df, e, series, m, f"__w{i}", params)
                made.append(F.col(f"__w{i}").alias(name))
            else:
                df = df.withColumn(f"__w{i}", self.column(e, params, series))
                made.append(F.col(f"__w{i}").alias(name))
        return self._finished(reduce(lambda d, c: d.where(c), late, df), made, s, params)

    def _plan(self, df: DataFrame, e: Call, series: W.Series, m: Measurement, name: str, params: dict) -> DataFrame:
        df = df.withColumn("__in", self.column(e.args[0], params))
        rest = [a.ms if isinstance(a, Duration) else -a.arg.value if isinstance(a, Unary) else a.value for a in e.args[1:]]
        if e.name in self.functions.windows:
            out = R.series_scan(df, m.tags, m.time, ["__in"], self.functions.windows[e.name], name, R.T.DoubleType())
        elif e.name in ("integral", "state_changes", "state_duration"):
            out = getattr(W, e.name)(df, series, "__in", *rest, name=name)
        elif e.name == "anomaly":
            out = W.anomaly(df, series, "__in", str(rest[0]), float(rest[1]), name)
        elif e.name == "changepoint":
            out = R.changepoint(df, m.tags, m.time, "__in", *map(float, rest[1:]), name=name)
        else:
            out = getattr(R, e.name)(df, m.tags, m.time, "__in", *map(float, rest), name=name)
        return out.drop("__in")

    def _grouped(self, s: Select, m: Measurement, df: DataFrame, params: dict) -> DataFrame:
        keys, key_names = [], {}
        for i, g in enumerate(s.groups):
            if isinstance(g, Call) and g.name == "time":
                keys.append(A.bucket(F.col(m.time), g.args[0].ms).alias(f"__k{i}"))
                key_names[to_sql(Name([m.time]))] = f"__k{i}"
            else:
                keys.append(self.column(g, params).alias(f"__k{i}"))
                key_names[to_sql(g, params)] = f"__k{i}"
        made, plans, known = [], [], {}

        def inner(x):
            """A group key or an aggregate within an expression, as a column of the grouped rows."""
            if (text := to_sql(x, params)) in key_names:
                return Name([key_names[text]])
            if not isinstance(x, Call) or x.name not in {*AGGREGATES, *GROUP_PLANS, *self.functions.aggregates}:
                return None
            if text not in known:
                known[text] = f"__a{len(known)}"
                (plans.append((x, known[text])) if x.name in GROUP_PLANS else made.append(self._aggregate(x, m, params).alias(known[text])))
            return Name([known[text]])

        shown = []
        for e, a in s.items:
            tree = rewrite(e, inner) if not isinstance(e, Star) else e
            if loose := [x for x in walk(tree) if isinstance(x, Star) or isinstance(x, Name) and not x.parts[0].startswith(("__k", "__a"))]:
                raise DialectError(f"neither grouped nor an aggregate: {to_sql(loose[0])}")
            shown.append((tree, a or self._named(e)))
        having = rewrite(s.having, inner) if s.having is not None else None
        made.append(F.count(F.lit(1)).alias("__n"))
        names = [f"__k{i}" for i in range(len(keys))]
        df = df.select("*", *keys)
        out = (df.groupBy(*names) if names else df).agg(*made).where("__n > 0")
        for x, name in plans:
            part = self._group_plan(x, df, names, m, params, name)
            renamed = part.withColumnsRenamed({k: f"{k}_" for k in names})
            on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names], F.lit(True))
            out = out.join(renamed, on, "left").drop(*[f"{k}_" for k in names]) if names else out.crossJoin(F.broadcast(part))
        if having is not None:
            out = out.where(F.expr(to_sql(having, params)))
        order = [(rewrite(e, inner) if to_sql(e, params) in {**known, **key_names} else e, up) for e, up in s.order]
        return self._finished(out, [F.expr(to_sql(t, params)).alias(n) for t, n in shown], replace(s, order=order, items=[(t, n) for t, n in shown]), params)

    def _group_plan(self, c: Call, df: DataFrame, keys: list[str], m: Measurement, params: dict, name: str) -> DataFrame:
        """An aggregate that is a small plan of its own: keys and the value."""
        rows = df.withColumn("__in", self.column(c.args[0], params)).where("__in IS NOT NULL")
        rest = [-float(a.arg.value) if isinstance(a, Unary) else a.value for a in c.args[1:]]
        if c.name == "histogram":
            return A.histogram(rows, keys, "__in", float(rest[0]), name)
        if c.name == "centroid":
            return A.centroid(rows, keys, "__in", name)
        if c.name == "pid":
            return A.pid(rows, keys, m.time, "__in", *map(float, rest), name=name)
        if c.name == "pid_estimate":
            gains = R.pid_estimate(rows, keys, m.time, "__in", *(rest[:1] or ["zn"]), *map(float, rest[1:]))
            return gains.select(*keys, F.to_json(F.struct("kp", "ki", "kd")).alias(name))
        t = A.trajectory(rows, keys, m.time, "__in")
        value = {"length": "length", "speed_max": "speed_max", "speed_avg": "speed_avg", "speed_p95": "speed_p95"}.get(c.name.removeprefix("trajectory_"))
        if value:
            return t.select(*keys, F.col(value).alias(name))
        if c.name == "trajectory_centroid":
            return t.select(*keys, S.point(F.col("centroid_lat"), F.col("centroid_lon")).alias(name))
        return t.select(*keys, F.to_json(F.struct("min_lat", "min_lon", "max_lat", "max_lon")).alias(name))

    def _aggregate(self, e, m: Measurement, params: dict) -> Column:
        if isinstance(e, Call) and e.name in self.functions.aggregates:
            return self.functions.aggregates[e.name](*[self.column(a, params) for a in e.args])
        if not (isinstance(e, Call) and e.name in AGGREGATES):
            raise DialectError(f"not an aggregate: {to_sql(e)}")
        if e.name == "count" and (not e.args or isinstance(e.args[0], (Star, Literal))):
            return F.count(F.lit(1))
        x, time = self.column(e.args[0], params), F.col(m.time)
        simple = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "stddev": F.stddev_samp, "variance": F.var_samp, "spread": A.spread, "mode": A.mode, "distinct_count": A.distinct_count}
        if e.name in simple:
            return simple[e.name](x)
        if e.name in ("first", "last"):
            return getattr(A, e.name)(x, time)
        if e.name == "tdigest_agg":  # a mergeable sketch, as text of its quantiles
            return F.to_json(F.struct(F.count(x).alias("count"), F.percentile_approx(x.cast("double"), [k / 100 for k in range(0, 101, 5)], 10_000).alias("quantiles")))
        q = 50 if e.name == "median" else float(e.args[1].value) if e.name == "percentile" else float(e.name[1:])
        return A.percentile(x, q)

    def _conjuncts(self, e) -> list:
        if e is None:
            return []
        return self._conjuncts(e.left) + self._conjuncts(e.right) if isinstance(e, Binary) and e.op == "and" else [e]

    def _table_function(self, c: Call, params: dict) -> DataFrame:
        args = [a.parts[-1] if isinstance(a, Name) else [float(x.arg.value * -1 if isinstance(x, Unary) else x.value) for x in a.items] if isinstance(a, Vector) else params[a.name] if isinstance(a, Param) else a.value for a in [*c.args, *c.named.values()]]
        if c.named:
            named = dict(zip(c.named, args[len(c.args) :], strict=True))
            if c.name == "vector_search":
                return V.vector_search(self._frame(named["source"]), named["vector_field"], named["query_vector"], named.get("top_k", 10), named.get("metric", "cosine"))
            if c.name == "hybrid_search":
                df, key = self._frame(named["source"]), named.get("key", "id")
                text = X.match(df, [named["text_field"]], named["text"]).select(key, "bm25")
                near = V.scored(df.select(key, named["vector_field"]), named["vector_field"], named["query_vector"], named.get("metric", "cosine")).select(key, "vector_score")
                found = V.hybrid(text, near, key, named.get("text_weight", 0.5), named.get("vector_weight", 0.5))
                return found.orderBy(F.desc("hybrid_score"), F.desc("bm25"), key).limit(named.get("top_k", 10)).join(df, key)
        if c.name in self.functions.tables:
            return self.functions.tables[c.name](self.spark, *args)
        if c.name == "knn":
            return V.knn(self._frame(args[0]), *args[1:])
        if c.name == "forecast":
            m = self.measurements[args[0].lower()]
            if len(args) > 3 and args[3] == "holt_winters":
                return R.forecast_holt_winters(m.df, m.tags, m.time, args[1], args[2], args[4] if len(args) > 4 else 0)
            return R.forecast_linear(m.df, m.tags, m.time, args[1], args[2])
        if c.name in ("json_each", "json_table"):
            return ingest.json_each(self.spark, *args)
        raise DialectError(f"unknown table function: {c.name}")

    def _frame(self, name: str) -> DataFrame:
        return self.measurements[name.lower()].df if name.lower() in self.measurements else self.tables[name.lower()]

    def column(self, e, params: dict, series: W.Series | None = None) -> Column:
        """A Column of an expression on a measurement."""
        col = lambda x: self.column(x, params, series)
        if isinstance(e, Call):
            if self.functions.enabled and e.name in self.functions.scalars:
                return self.functions.scalars[e.name](*map(col, e.args))
            if series is not None and e.name in WINDOWS:
                rest = [a.ms if isinstance(a, Duration) else a.value for a in e.args[1:]]
                return WINDOWS[e.name](series, col(e.args[0]), *rest)
            if e.name == "point":
                return S.point(*map(col, e.args))
            if e.name in ("lat", "lon"):
                return col(e.args[0])[e.name]
            if e.name in ("geo_distance", "st_distance", "geo_bearing", "geo_speed"):
                return getattr(S, e.name.replace("st_", "geo_"))(*map(col, e.args))
            if e.name in ("geo_within", "st_within", "st_dwithin", "geo_bbox"):
                return (S.geo_bbox if e.name == "geo_bbox" else S.geo_within)(col(e.args[0]), *[float(-a.arg.value if isinstance(a, Unary) else a.value) for a in e.args[1:]])
            if e.name == "geo_transform":
                return S.geo_transform(col(e.args[0]), e.args[1].value, e.args[2].value)
            if e.name == "vector_norm":
                return S.vector_norm(col(e.args[0]))
        if isinstance(e, (Unary, Binary, In, Test, Case)) and any(isinstance(x, Call) for x in walk(e)):
            if isinstance(e, Unary):
                return ~col(e.arg) if e.op == "not" else -col(e.arg)
            if isinstance(e, Binary) and e.op not in ("<=>", "<->", "<#>"):
                a, b = col(e.left), col(e.right)
                return {"and": lambda: a & b, "or": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: S.divide(a, b), "%": lambda: a % b}[e.op]()
        return F.expr(to_sql(e, params))
