"""Readers of point formats, all of them line-parallel: line protocol, JSON points, bulk VALUES, JSON files.

Points come out in long form (measurement, time, tags, fields); wide() makes a measurement's frame of them.
"""

from __future__ import annotations

import json
import re
import time as clock

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRECISION_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}
LONG = "measurement string, time bigint, tags map<string,string>, fields map<string,string>"
_ARROW = pa.schema([("measurement", pa.string()), ("time", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("fields", pa.map_(pa.string(), pa.string()))])


def _cut(text: str, mark: str, quotes: bool = True) -> list[str]:
    """Parts between unescaped marks outside double quotes."""
    out, part, quoted, i = [], [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            part.append(text[i : i + 2])
            i += 2
            continue
        if c == '"' and quotes:
            quoted = not quoted
        if c == mark and not quoted:
            out.append("".join(part))
            part = []
        else:
            part.append(c)
        i += 1
    return [*out, "".join(part)]


def _plain(text: str) -> str:
    return re.sub(r"\\([,= \\\"])", r"\1", text)


def parse_line(line: str, precision: str = "ns", now_ms: int | None = None) -> tuple | None:
    """(measurement, time in ms, tags, fields as JSON texts); None for blank lines and # comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    parts = [p for p in _cut(line, " ") if p]
    if len(parts) not in (2, 3):
        raise ValueError(f"not a point: {line[:80]}")
    name, *tags = _cut(parts[0], ",", False)
    fields = {}
    for f in _cut(parts[1], ","):
        k, v = _cut(f, "=")[0], "=".join(_cut(f, "=")[1:])
        if v[:1] == '"':
            v = json.dumps(re.sub(r"\\([\\\"])", r"\1", v[1:-1]), ensure_ascii=False)
        elif re.fullmatch(r"-?\d+[iu]", v):
            v = v[:-1]
        elif v.lower() in ("t", "true", "f", "false"):
            v = "true" if v.lower()[0] == "t" else "false"
        else:
            v = repr(float(v))
        fields[_plain(k)] = v
    ms = int(parts[2]) * PRECISION_NS[precision] // 1_000_000 if len(parts) == 3 else now_ms if now_ms is not None else int(clock.time() * 1000)
    return _plain(name), ms, dict(tuple(map(_plain, _cut(t, "=", False)[:2])) for t in tags), fields


def line_protocol(lines: DataFrame, precision: str = "ns", now_ms: int | None = None) -> DataFrame:
    """Points of lines (column value). A line that isn't a point fails the job, with its start in the message."""

    def run(batches):
        for batch in batches:
            rows = [p for x in batch.column(0).to_pylist() if x is not None and (p := parse_line(x, precision, now_ms))]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], _ARROW.field(0).type), pa.array(columns[1], pa.int64()), *[pa.array([list(m.items()) for m in c], _ARROW.field(2).type) for c in columns[2:]]], schema=_ARROW)

    return lines.select("value").mapInArrow(run, LONG)


def read_line_protocol(spark: SparkSession, path: str, precision: str = "ns", now_ms: int | None = None) -> DataFrame:
    return line_protocol(spark.read.text(path), precision, now_ms)


def json_points(payloads: DataFrame) -> DataFrame:
    """Points of payloads {m, precision, points: [{t, tags, fields}]} (column value), in built-in functions."""
    kind = "m string, precision string, points array<struct<t: bigint, tags: map<string,string>, fields: map<string,string>>>"
    rows = payloads.select(F.from_json("value", kind).alias("p")).select("p.m", F.coalesce("p.precision", F.lit("ms")).alias("u"), F.explode("p.points").alias("q"))
    factor = F.element_at(F.create_map(*[x for k, v in PRECISION_NS.items() for x in (F.lit(k), F.lit(v))]), F.col("u"))
    # not by way of nanoseconds: seconds would overflow
    ms = F.when(factor >= 1_000_000, F.col("q.t") * (factor / 1_000_000).cast("long")).otherwise(F.floor(F.col("q.t") / (1_000_000 / factor)))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return rows.select(F.col("m").alias("measurement"), ms.cast("long").alias("time"), F.coalesce("q.tags", empty).alias("tags"), F.coalesce("q.fields", empty).alias("fields"))


def bulk_values(spark: SparkSession, text: str) -> DataFrame:
    """Rows of INSERT INTO m (a, b) VALUES (...), (...): strings, numbers, booleans and NULL."""
    m = re.match(r"\s*insert\s+into\s+([\w\"`]+)\s*\(([^)]*)\)\s*values\s*(.*?);?\s*$", text, re.I | re.S)
    if not m:
        raise ValueError("not a bulk insert")
    columns = [c.strip().strip('"`') for c in m[2].split(",")]
    token = re.compile(r"\s*('(?:[^']|'')*'|[^,()\s]+)\s*")
    rows, at, body = [], 0, m[3]
    while at < len(body):
        if body[at] != "(":
            at += 1
            continue
        at, row = at + 1, []
        while True:
            t = token.match(body, at)
            v, at = t[1], t.end()
            row.append(v[1:-1].replace("''", "'") if v[0] == "'" else None if v.lower() == "null" else v.lower() == "true" if v.lower() in ("true", "false") else int(v) if re.fullmatch(r"-?\d+", v) else float(v))
            if body[at] == ")":
                break
            at += 1
        if len(row) != len(columns):
            raise ValueError("a row has another number of values than there are columns")
        rows.append(tuple(row))
        at += 1
    kinds = []
    for i in range(len(columns)):
        seen = {type(r[i]) for r in rows} - {type(None)}
        kinds.append("string" if str in seen else "double" if float in seen else "boolean" if seen == {bool} else "bigint")
    rows = [tuple(float(v) if k == "double" and v is not None else v for v, k in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds, strict=True)))


def detect(payload: str) -> str:
    """json, bulk or line."""
    start = payload.lstrip()
    if start[:1] in "{[":
        return "json"
    return "bulk" if re.match(r"insert\b", start, re.I) else "line"


def wide(points: DataFrame, measurement: str, tags: dict[str, str] | list[str], fields: dict[str, str]) -> DataFrame:
    """A measurement's frame: time, tags, and typed fields; rows of one series and time become one."""
    own = points.where(F.col("measurement") == measurement)
    keys = ["time", *[F.try_element_at("tags", F.lit(t)).alias(t) for t in tags]]
    cells = own.select(*keys, *[F.try_element_at("fields", F.lit(f)).alias(f) for f in fields])
    text = lambda f: F.get_json_object(F.concat(F.lit("["), f, F.lit("]")), "$[0]")
    made = [F.last(text(F.col(f)) if k == "string" else F.col(f).cast(k), True).alias(f) for f, k in fields.items()]
    return cells.groupBy("time", *tags).agg(*made)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with their place, from 0 without gaps: counted by task first, whatever the splits."""
    at = rows.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__at", 33)
    sizes = {r[0]: r[1] for r in at.groupBy(part).count().collect()}  # a row per task
    before, run = [], 0
    for k in sorted(sizes):
        before += [F.lit(k), F.lit(run)]
        run += sizes[k]
    first = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return at.withColumn("ordinal", first + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def json_each(spark: SparkSession, path: str, form: str = "auto", id_path: str | None = None) -> DataFrame:
    """ordinal, id, document of a JSON array file or a file of JSON lines. Lines are read in parallel; an array file is one row."""
    if form == "auto":
        head = spark.read.text(path).where("trim(value) <> ''").select(F.substring(F.ltrim("value"), 1, 1)).first()
        form = "array" if head and head[0] == "[" else "lines"
    if form == "array":
        docs = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<variant>")).alias("ordinal", "v")).select("ordinal", F.to_json("v").alias("document"))
    elif form in ("lines", "ndjson", "jsonl"):
        rows = spark.read.text(path).where("trim(value) <> ''")
        docs = _numbered(rows).select("ordinal", F.col("value").alias("document"))
    else:
        raise ValueError(f"unknown format: {form}")
    own = F.get_json_object("document", id_path) if id_path else F.coalesce(F.get_json_object("document", "$.id"), F.get_json_object("document", "$._id"))
    return docs.select(F.col("ordinal").cast("long"), F.coalesce(own, F.col("ordinal").cast("string")).alias("id"), "document")


def trajectories(df: DataFrame, tags: list[str], time: str, p: str) -> DataFrame:
    """GeoJSON line strings by series. A line is one value, so a series' points must fit a task."""
    points = F.array_sort(F.collect_list(F.struct(time, F.col(f"{p}.lon").alias("lon"), F.col(f"{p}.lat").alias("lat"))))
    line = F.transform(points, lambda q: F.array(q["lon"], q["lat"]))
    shape = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry")))
    return df.where(F.col(p).isNotNull()).groupBy(*tags).agg(shape.alias("geojson"))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, sets: dict[str, str], where: str = "true") -> DataFrame:
    hit = F.coalesce(F.expr(where), F.lit(False))
    return table.withColumns({c: F.when(hit, F.expr(e)).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, e in sets.items()})


def delete(table: DataFrame, where: str = "true") -> DataFrame:
    """Rows for which the condition isn't true."""
    return table.where(~F.coalesce(F.expr(where), F.lit(False)))


def cascade(children: DataFrame, key: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Children without those of deleted parents."""
    return children.join(deleted.select(F.col(parent_key).alias(key)), key, "left_anti")


def deduplicate(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with equal series and time, the last written."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("__r")).select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(df.columns)
