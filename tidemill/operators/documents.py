"""JSON document collections: filters, staged pipelines and updates over a (id, document) frame."""

from __future__ import annotations

import copy
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalar import json_exists, json_typed, json_value

COMPARE = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _typed(doc: Column, path: str, value) -> Column:
    if isinstance(value, bool):
        return json_typed(doc, path, "boolean")
    if isinstance(value, (int, float)):
        return json_typed(doc, path, "double")
    return json_typed(doc, path, "string")


def condition(tree: dict, doc: Column | None = None) -> Column:
    """A two-valued Column of a filter tree: {"and": [...]}, {"or": [...]}, {"not": ...}, {"op": [path, value]}.

    A missing field is false for all but exists (and so for ne too); a JSON null is there, and equals null.
    """
    doc = F.col("document") if doc is None else doc
    ((op, arg),) = tree.items()
    if op in ("and", "or"):
        parts = [condition(t, doc) for t in arg]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts, F.lit(op == "and"))
    if op == "not":
        return ~condition(arg, doc)
    if op == "exists":
        path, wanted = arg if isinstance(arg, (list, tuple)) else (arg, True)
        return json_exists(doc, path) == wanted
    path, value = arg
    there = json_exists(doc, path)
    if op in ("in", "not_in"):
        hit = reduce(lambda a, b: a | b, [_equal(doc, path, v) for v in value], F.lit(False))
        return there & (hit if op == "in" else ~hit)
    if op == "contains":
        if isinstance(value, str):
            item = F.array_contains(F.coalesce(json_typed(doc, path, "array<string>"), F.expr("cast(array() as array<string>)")), value)
            return F.coalesce(item | json_value(doc, path).contains(value), F.lit(False))
        return F.coalesce(F.array_contains(json_typed(doc, path, "array<double>"), float(value)), F.lit(False))
    if op == "eq":
        return there & _equal(doc, path, value)
    if op == "ne":
        return there & ~_equal(doc, path, value)
    x, v = _typed(doc, path, value), F.lit(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value)
    return F.coalesce({"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op], F.lit(False))


def _equal(doc: Column, path: str, value) -> Column:
    if value is None:
        return json_exists(doc, path) & json_value(doc, path).isNull()
    x = _typed(doc, path, value)
    return x.eqNullSafe(F.lit(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value))


def find(df: DataFrame, where: dict | None = None, fields: dict[str, str] | None = None, sort: list[tuple[str, bool]] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """id and document (or the named paths), sorted by paths or by id."""
    out = df.where(condition(where)) if where else df
    keys = [(json_value(F.col("document"), p).asc() if up else json_value(F.col("document"), p).desc()) for p, up in sort or []]
    if sort or skip or limit is not None:
        out = out.orderBy(*keys, "id")
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.select("id", *[json_value(F.col("document"), p).alias(n) for n, p in fields.items()]) if fields else out


def aggregate(df: DataFrame, stages: list[dict]) -> DataFrame:
    """Stages in order over document: match, project, group, sort, limit, skip, unwind, count, distinct.

    Without rows, group makes no group, and count one row of 0.
    """
    out = df
    for stage in stages:
        ((op, arg),) = stage.items()
        doc = F.col("document")
        if op == "match":
            out = out.where(condition(arg))
        elif op == "project":
            out = out.select("id", F.to_json(F.struct(*[json_value(doc, p).alias(n) for n, p in arg.items()])).alias("document"))
        elif op == "group":
            keys = [json_value(doc, p).alias(n) for n, p in arg.get("by", {}).items()]
            made = [_accumulate(doc, kind, p).alias(n) for n, (kind, p) in arg["make"].items()]
            if keys:
                out = out.groupBy(*keys).agg(*made)
            else:
                out = out.agg(*made, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")
            names = [*arg.get("by", {}), *arg["make"]]
            out = out.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in arg.get("by", {})] or [F.lit(None).alias("_")])).alias("id"), F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("document"))
        elif op == "sort":
            out = out.orderBy(*[x for p, up in arg for x in _sort_keys(doc, p, up)], "id")
        elif op == "limit":
            out = out.limit(arg)
        elif op == "skip":
            out = out.offset(arg)
        elif op == "unwind":
            path, keep = (arg, False) if isinstance(arg, str) else (arg["path"], arg.get("preserve", False))
            value = F.try_variant_get(F.try_parse_json(doc), path, "variant")
            items = F.coalesce(json_typed(doc, path, "array<variant>"), F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value)))
            made = F.explode_outer(items) if keep else F.explode(items)
            out = out.select("id", "document", made.alias("__item"))
            name = re.sub(r"^\$\.?", "", path)
            merged = F.to_json(F.map_concat(F.map_filter(F.from_json(doc, "map<string,string>"), lambda k, _: k != name), F.when(F.col("__item").isNotNull(), F.create_map(F.lit(name), F.col("__item").cast("string"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))))
            out = out.select("id", merged.alias("document"))
        elif op == "count":
            out = out.agg(F.count(F.lit(1)).alias(arg or "count")).select(F.lit("count").alias("id"), F.to_json(F.struct(F.col(arg or "count"))).alias("document"))
        elif op == "distinct":
            out = out.select(json_value(doc, arg).alias("value")).distinct().select(F.col("value").alias("id"), F.to_json(F.struct("value")).alias("document"))
        else:
            raise ValueError(f"unknown stage: {op}")
    return out


def _sort_keys(doc: Column, path: str, up: bool) -> list[Column]:
    number, text = json_typed(doc, path, "double"), json_value(doc, path)
    return [x.asc() if up else x.desc() for x in (number, text)]


def _accumulate(doc: Column, kind: str, path: str | None) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    x, text = json_typed(doc, path, "double"), json_value(doc, path)
    if kind in ("sum", "avg"):
        return F.coalesce(F.sum(x), F.lit(0.0)) if kind == "sum" else F.avg(x)
    if kind in ("min", "max"):
        return {"min": F.min, "max": F.max}[kind](x)
    if kind in ("first", "last"):  # by id
        return {"first": F.min_by, "last": F.max_by}[kind](text, F.col("id"))
    if kind == "distinct":
        return F.sort_array(F.collect_set(text))
    raise ValueError(f"unknown accumulator: {kind}")


def _walk(doc, path: list, make: bool = False):
    for p in path[:-1]:
        if isinstance(doc, list) and isinstance(p, int):
            doc = doc[p] if p < len(doc) else None
        elif isinstance(doc, dict):
            if p not in doc and make:
                doc[p] = {}
            doc = doc.get(p)
        else:
            return None
    return doc


def _path(text: str) -> list:
    return [int(n) if n else (q or w) for w, n, q in re.findall(r"\.?([^.\[\]$']+)|\[(\d+)\]|\['([^']*)'\]", text.replace("$", "", 1))]


def apply_update(doc, ops: dict, now: str | None = None):
    """A new document after $set, $unset, $inc, $min, $max, $rename, $push, $pull, $addToSet and $currentDate."""
    paths = [".".join(map(str, _path(p))) for changes in ops.values() for p in changes]
    for i, a in enumerate(paths):
        for b in paths[i + 1 :]:
            if a == b or a.startswith(b + ".") or b.startswith(a + "."):
                raise ValueError(f"paths conflict: {a}, {b}")
    doc = copy.deepcopy(doc)
    for op, changes in ops.items():
        for text, value in changes.items():
            path = _path(text)
            parent, k = _walk(doc, path, op != "$unset"), path[-1]
            if parent is None or (isinstance(parent, list) and not isinstance(k, int)):
                continue
            has = k in parent if isinstance(parent, dict) else k < len(parent)
            old = parent[k] if has else None
            if op == "$set":
                parent[k] = value
            elif op == "$unset":
                if has:
                    del parent[k]
            elif op == "$inc":
                parent[k] = (old or 0) + value
            elif op in ("$min", "$max"):
                parent[k] = value if not has else (min if op == "$min" else max)(old, value)
            elif op == "$rename":
                if has:
                    target = _path(value)
                    _walk(doc, target, True)[target[-1]] = parent.pop(k)
            elif op == "$push":
                parent[k] = [*(old or []), value]
            elif op == "$pull":
                if has:
                    parent[k] = [x for x in old if x != value]
            elif op == "$addToSet":
                parent[k] = [*(old or []), *([] if value in (old or []) else [value])]
            elif op == "$currentDate":
                parent[k] = now
            else:
                raise ValueError(f"unknown update: {op}")
    return doc


def update(df: DataFrame, ops: dict, where: dict | None = None, now: str | None = None) -> DataFrame:
    """df with the documents that match updated; others, and text that isn't JSON, stay as they are."""

    @F.pandas_udf("string")
    def changed(docs):
        def one(text):
            try:
                return json.dumps(apply_update(json.loads(text), ops, now), ensure_ascii=False)
            except (TypeError, ValueError) as e:
                if "conflict" in str(e) or "unknown" in str(e):
                    raise
                return text

        return docs.map(one, na_action="ignore")

    if where is None:
        return df.withColumn("document", changed("document"))
    hit = condition(where)
    return df.where(hit).withColumn("document", changed("document")).unionByName(df.where(~hit))


def upsert(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Rows of new replace those of old with their id; versions count up."""
    kept = old.join(new.select("id"), "id", "left_anti")
    known = old.select("id", F.col(version).alias("__v"))
    fresh = new.drop(version).join(known, "id", "left").withColumn(version, F.coalesce(F.col("__v"), F.lit(0)) + 1).drop("__v")
    return kept.unionByName(fresh)


def validate(df: DataFrame, required: list[str] = (), kinds: dict[str, str] | None = None, minimum: dict | None = None, maximum: dict | None = None, pattern: dict | None = None, enum: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) documents by a schema of rules; rules but required skip missing fields."""
    doc, rules = F.col("document"), []
    rules += [json_exists(doc, p) for p in required]
    rules += [~json_exists(doc, p) | json_typed(doc, p, k).isNotNull() for p, k in (kinds or {}).items()]
    rules += [~json_exists(doc, p) | F.coalesce(json_typed(doc, p, "double") >= v, F.lit(False)) for p, v in (minimum or {}).items()]
    rules += [~json_exists(doc, p) | F.coalesce(json_typed(doc, p, "double") <= v, F.lit(False)) for p, v in (maximum or {}).items()]
    rules += [~json_exists(doc, p) | F.coalesce(json_value(doc, p).rlike(v), F.lit(False)) for p, v in (pattern or {}).items()]
    rules += [~json_exists(doc, p) | reduce(lambda a, b: a | b, [_equal(doc, p, v) for v in vs]) for p, vs in (enum or {}).items()]
    good = reduce(lambda a, b: a & b, rules, F.lit(True))
    return df.where(good), df.where(~good)


def purge_expired(df: DataFrame, path: str, ttl_seconds: int, now_seconds: float) -> DataFrame:
    """Without the documents whose time (in seconds, at the path) is older than ttl_seconds."""
    at = json_typed(F.col("document"), path, "double")
    return df.where(at.isNull() | (at + ttl_seconds > now_seconds))
