"""Scalar functions as Column expressions: maths, geography, vectors, JSON paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres; bounds outside of which coordinates are not shifted; ellipsoid (fixed values).
EARTH_M = 6_371_008.8
CHINA = (72.004, 137.8347, 0.8293, 55.8271)
KRASOVSKY_A, KRASOVSKY_EE = 6_378_245.0, 0.00669342162296594323
BD_FACTOR = 3.14159265358979324 * 3000.0 / 180.0


def duration_ms(text: str | int) -> int:
    """Milliseconds of a duration such as 1h, 30s, 500ms; ns and us are cut off to whole milliseconds."""
    import re

    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*(-?\d+)\s*(ns|us|ms|s|m|h|d)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    n, unit = int(m[1]), m[2]
    if unit in ("ns", "us"):
        return int(n / {"ns": 1_000_000, "us": 1000}[unit])
    return n * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[unit]


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x.cast("double"), digits)


def log(x: Column, base: Column | None = None) -> Column:
    return F.ln(x) if base is None else F.ln(x) / F.ln(base)


def divide(a: Column, b: Column) -> Column:
    """As doubles; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def geo_distance(a: Column, b: Column) -> Column:
    """Metres along the great circle (haversine)."""
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geo_bearing(a: Column, b: Column) -> Column:
    """Initial bearing in degrees, from 0 to below 360."""
    p, q, d = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lon"] - a["lon"])
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def geo_within(p: Column, lat: float, lon: float, metres: float) -> Column:
    """Within metres of a centre. A box that holds the circle comes first: it reaches the scan's statistics."""
    import math

    dlat = math.degrees(metres / EARTH_M) * 1.0001
    box = p["lat"].between(lat - dlat, lat + dlat)
    return box & (geo_distance(p, point(F.lit(lat), F.lit(lon))) <= metres)


def geo_bbox(p: Column, lat0: float, lon0: float, lat1: float, lon1: float) -> Column:
    """In the box; it doesn't wrap at the antimeridian."""
    return p["lat"].between(min(lat0, lat1), max(lat0, lat1)) & p["lon"].between(min(lon0, lon1), max(lon0, lon1))


def geo_speed(a: Column, b: Column, ms: Column) -> Column:
    """Metres a second; null where no time passed."""
    return F.when(ms > 0, geo_distance(a, b) / (ms / 1000.0))


def geohash32(p: Column) -> Column:
    """Morton code of 16 bits of latitude and 16 of longitude, as a long."""

    def scaled(x: Column, low: float, span: float) -> Column:
        return F.least(F.lit(65535), F.floor((x - low) / span * 65536)).cast("long")

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(scaled(p["lat"], -90.0, 180.0)), 1).bitwiseOR(spread(scaled(p["lon"], -180.0, 360.0)))


def _offsets(p: Column) -> tuple[Column, Column]:
    import math

    x, y = p["lon"] - 105.0, p["lat"] - 35.0
    pi = math.pi
    root = F.sqrt(F.abs(x))
    common = (20 * F.sin(6 * pi * x) + 20 * F.sin(2 * pi * x)) * 2 / 3
    dlat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + common
    dlat = dlat + (20 * F.sin(pi * y) + 40 * F.sin(pi / 3 * y)) * 2 / 3 + (160 * F.sin(pi / 12 * y) + 320 * F.sin(pi / 30 * y)) * 2 / 3
    dlon = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + common
    dlon = dlon + (20 * F.sin(pi * x) + 40 * F.sin(pi / 3 * x)) * 2 / 3 + (150 * F.sin(pi / 12 * x) + 300 * F.sin(pi / 30 * x)) * 2 / 3
    rad = F.radians(p["lat"])
    magic = 1 - KRASOVSKY_EE * F.pow(F.sin(rad), 2)
    dlat = dlat * 180 / (KRASOVSKY_A * (1 - KRASOVSKY_EE) / (magic * F.sqrt(magic)) * pi)
    dlon = dlon * 180 / (KRASOVSKY_A / F.sqrt(magic) * F.cos(rad) * pi)
    return dlat, dlon


def in_china(p: Column) -> Column:
    return p["lon"].between(CHINA[0], CHINA[1]) & p["lat"].between(CHINA[2], CHINA[3])


def let(value: Column, body) -> Column:
    """body with value computed once for the row: without it, each use of a point would hold its whole expression."""
    return F.transform(F.array(value), body)[0]


def wgs84_to_gcj02(p: Column) -> Column:
    dlat, dlon = _offsets(p)
    return F.when(in_china(p), point(p["lat"] + dlat, p["lon"] + dlon)).otherwise(point(p["lat"], p["lon"]))


def gcj02_to_wgs84(p: Column, rounds: int = 6) -> Column:
    """The inverse by fixed-point steps: each takes off the offset at the last guess; the error falls a thousandfold a step."""

    def step(q: Column, _: Column) -> Column:
        dlat, dlon = _offsets(q)
        return point(p["lat"] - dlat, p["lon"] - dlon)

    start = point(p["lat"], p["lon"])
    return F.when(in_china(p), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)).otherwise(start)


def gcj02_to_bd09(p: Column) -> Column:
    z = F.sqrt(p["lon"] * p["lon"] + p["lat"] * p["lat"]) + 0.00002 * F.sin(p["lat"] * BD_FACTOR)
    t = F.atan2(p["lat"], p["lon"]) + 0.000003 * F.cos(p["lon"] * BD_FACTOR)
    return F.when(in_china(p), point(z * F.sin(t) + 0.006, z * F.cos(t) + 0.0065)).otherwise(point(p["lat"], p["lon"]))


def bd09_to_gcj02(p: Column) -> Column:
    x, y = p["lon"] - 0.0065, p["lat"] - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * BD_FACTOR)
    t = F.atan2(y, x) - 0.000003 * F.cos(x * BD_FACTOR)
    return F.when(in_china(p), point(z * F.sin(t), z * F.cos(t))).otherwise(point(p["lat"], p["lon"]))


def geo_transform(p: Column, source: str, target: str) -> Column:
    """Between wgs84, gcj02 and bd09."""
    source, target = source.lower(), target.lower()
    if {source, target} - {"wgs84", "gcj02", "bd09"}:
        raise ValueError(f"unknown coordinates: {source} to {target}")
    if source == target:
        return p
    into = {"wgs84": wgs84_to_gcj02, "bd09": bd09_to_gcj02}
    out_of = {"wgs84": gcj02_to_wgs84, "bd09": gcj02_to_bd09}
    middle = p if source == "gcj02" else let(p, lambda q: into[source](q))
    return middle if target == "gcj02" else let(middle, lambda q: out_of[target](q))


def in_polygon(p: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) corners; edges are half open."""
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(corners, corners[1:] + corners[:1], strict=True):
        if a_lat == b_lat:
            continue
        crosses = ((p["lat"] < a_lat) != (p["lat"] < b_lat)) & (p["lon"] < (b_lon - a_lon) * (p["lat"] - a_lat) / (b_lat - a_lat) + a_lon)
        crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def vector_norm(a: Column) -> Column:
    return F.sqrt(_fold(a, a, lambda x, y: x * y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return 1 - F.try_divide(inner_product(a, b), vector_norm(a) * vector_norm(b))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer; inner products are negated."""
    metric = {"euclidean": "l2", "dot": "inner_product"}.get(metric, metric)
    return {"cosine": cosine_distance, "l2": l2_distance, "inner_product": lambda x, y: -inner_product(x, y)}[metric](a, b)


def distance_score(d: Column, metric: str = "cosine") -> Column:
    """A score from 0 to 1 of a distance."""
    metric = {"euclidean": "l2", "dot": "inner_product"}.get(metric, metric)
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / 2))
    if metric == "inner_product":
        return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), d))))
    return 1 / (1 + F.greatest(F.lit(0.0), d))


def json_value(doc: Column, path: str) -> Column:
    """Text of the value at $.a.b[0]['c']; containers as JSON text; null where missing or JSON null."""
    return F.get_json_object(doc, path)


def json_typed(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), path, kind)


def json_exists(doc: Column, path: str) -> Column:
    """Whether the path is there; a JSON null is."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(doc), path, "variant").isNotNull(), F.lit(False))
