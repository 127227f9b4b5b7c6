"""The small SQL over JSON objects: two-valued logic, null equals null, and numeric text compares as numbers.

SELECT items FROM input [WHERE] [GROUP BY] [HAVING] [ORDER BY x [asc|desc|ascnum|descnum]] [LIMIT n | offset, n].
Fields are paths (a.b). HAVING and ORDER BY see the selected names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expression import Call, Literal, Name, Parser, Star, Unary, walk

AGGREGATES = {"count", "sum", "total", "avg", "min", "max", "group_concat", "string_agg"}


class Json(Parser):
    pass


def _number(x: Column) -> Column:
    return x.try_cast("decimal(38,10)")


def _value(e, field) -> Column:
    """A text Column of an expression; numbers as plain decimal text."""
    kind = type(e).__name__
    if isinstance(e, Literal):
        return F.lit(None).cast("string") if e.value is None else F.lit(str(e.value).lower() if isinstance(e.value, bool) else str(e.value))
    if isinstance(e, Name):
        return field(".".join(e.parts))
    if isinstance(e, Unary) and e.op == "-":
        return (-_number(_value(e.arg, field))).cast("string")
    if kind == "Binary" and e.op in "+-*/%":
        a, b = _value(e.left, field), _value(e.right, field)
        x, y = _number(a), _number(b)
        if e.op == "+":
            return F.coalesce((x + y).cast("string"), F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        out = {"-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.when(y != 0, x % y)}[e.op]
        return out.cast("string")
    return _truth(e, field).cast("string")


def _truth(e, field) -> Column:
    """Two-valued."""
    kind = type(e).__name__
    if isinstance(e, Unary) and e.op == "not":
        return ~_truth(e.arg, field)
    if kind == "Binary" and e.op in ("and", "or"):
        a, b = _truth(e.left, field), _truth(e.right, field)
        return a & b if e.op == "and" else a | b
    if kind == "Binary":
        a, b = _value(e.left, field), _value(e.right, field)
        x, y = _number(a), _number(b)
        numbers = x.isNotNull() & y.isNotNull()
        equal = F.when(numbers, x == y).otherwise(a.eqNullSafe(b))
        # null comes first
        less = F.when(numbers, x < y).otherwise(F.when(a.isNull(), b.isNotNull()).otherwise(F.coalesce(a < b, F.lit(False))))
        return {"=": equal, "<>": ~equal, "<": less, "<=": less | equal, ">": ~(less | equal), ">=": ~less}[e.op]
    v = _value(e, field)
    return F.coalesce(v.isin("true") | (_number(v) != 0), F.lit(False))


def _aggregate(e: Call, field) -> Column:
    name, args = e.name.lower(), e.args
    if name == "count":
        return F.count(F.lit(1) if not args or isinstance(args[0], Star) else _value(args[0], field)).cast("string")
    v = _value(args[0], field)
    n = _number(v)
    if name in ("group_concat", "string_agg"):
        sep = args[1].value if len(args) > 1 else ","
        return F.listagg(F.when(v != "", v), F.lit(sep))
    if name in ("min", "max"):
        best = F.min if name == "min" else F.max
        return F.coalesce(best(n).cast("string"), best(v))
    return {"sum": F.sum(n), "total": F.coalesce(F.sum(n), F.lit(0)), "avg": F.avg(n)}[name].cast("string")


def run(rows: DataFrame, sql: str) -> DataFrame:
    """rows (document: JSON text of an object). All results are text, as the engine's values are untyped."""
    p = Json(sql)
    p.expect("select")
    items = [_item(p)]
    while p.accept(","):
        items.append(_item(p))
    p.expect("from")
    p.next()
    where = p.expression() if p.accept("where") else None
    groups = []
    if p.accept("group"):
        p.expect("by")
        groups.append(p.expression())
        while p.accept(","):
            groups.append(p.expression())
    having = p.expression() if p.accept("having") else None
    order = []
    if p.accept("order"):
        p.expect("by")
        while True:
            e = p.expression()
            order.append((e, p.next().text.lower() if p.peek().text.lower() in ("asc", "desc", "ascnum", "descnum") else "asc"))
            if not p.accept(","):
                break
    limit = None
    if p.accept("limit"):
        a = int(p.next().text)
        limit = (a, int(p.next().text)) if p.accept(",") else (0, a)
    p.end()

    def deep(path: str) -> Column:
        return F.get_json_object("document", "$." + path)

    out = rows.where(_truth(where, deep)) if where is not None else rows
    if groups or any(isinstance(x, Call) and x.name.lower() in AGGREGATES for e, _ in items for x in walk(e)):
        keys = [_value(g, deep).alias(f"__g{i}") for i, g in enumerate(groups)]
        made = [(_aggregate(e, deep) if isinstance(e, Call) and e.name.lower() in AGGREGATES else F.first(_value(e, deep))).alias(n) for e, n in items]
        out = out.groupBy(*keys).agg(*made) if keys else out.agg(*made)
        out = out.select(*[F.col(f"`{n}`") for _, n in items])
        shallow = lambda path: F.col(f"`{path}`")
    elif len(items) == 1 and isinstance(items[0][0], Star):
        shallow = deep
    else:
        out = out.select(*[_value(e, deep).alias(n) for e, n in items])
        shallow = lambda path: F.col(f"`{path}`")
    if having is not None:
        out = out.where(_truth(having, shallow))
    if order:
        keys = []
        for e, how in order:
            v = _value(e, shallow)
            for k in [_number(v), v] if how.endswith("num") or how in ("asc", "desc") else [v]:
                keys.append(k.asc_nulls_first() if how.startswith("asc") else k.desc_nulls_last())
        out = out.orderBy(*keys)
    if limit:
        out = out.offset(limit[0]).limit(limit[1]) if limit[0] else out.limit(limit[1])
    return out


def _item(p: Parser) -> tuple:
    e = p.expression()
    if p.accept("as") or (p.peek().kind == "word" and p.peek().text.lower() not in ("from",)):
        return e, p.next().text
    return e, re.sub(r"\s+", "", p.text_of(e)) if not isinstance(e, Name) else e.parts[-1]
