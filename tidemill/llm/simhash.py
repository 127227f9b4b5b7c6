"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints are made of the XXH64 hashes of word shingles. Each distinct fingerprint is cut into segments;
small Hamming balls around each segment are looked up in a table of all segments (one equi-join), and complete
distances are verified in the join's condition. The number of segments follows the number of fingerprints, so
that a table entry keeps few rows; every choice finds the same links. A segment value shared by more than
hot_bucket fingerprints would make pairs with the square of its size, so its fingerprints are linked through
midpoints instead: two fingerprints are within 2 * r bits exactly if balls of r bits around them share a point.
Links become components by alternating large and small stars, each round written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, staged, trim

#: Bits that linked fingerprints may differ in; words in a shingle.
BITS, SHINGLE = 4, 4


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The text's fingerprint as a signed 64-bit number; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(size, len(words))
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[k - 1 + i : k - 1 + i + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every row of docs (columns doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, size) for t in part.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def segments(n: int, bits: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment for n fingerprints.

    Of m segments at most bits % m + 1 need radius bits // m, the others one less: were each farther apart,
    the whole would differ in more than bits. Segments of about log2(n) bits keep table entries short.
    """
    m = 4 if n <= 1 << 20 else 3 if n <= 1 << 26 else 2
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a, bits // m - (i > bits % m)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most radius bits among width bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(width), r)]


def links(unique: DataFrame, n: int, bits: int = BITS, hot_bucket: int = 2000) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all pairs of unique.fp that differ in at most bits bits."""
    parts = segments(n, bits)
    value = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
    key = lambda i, v: v.bitwiseOR(F.lit(i << 60))

    def exploded(make) -> DataFrame:
        return unique.select("fp", F.explode(F.flatten(F.array(*[make(i, s, w, r) for i, (s, w, r) in enumerate(parts)]))).alias("key"))

    def around(i: int, s: int, w: int, r: int) -> Column:
        if r < 0:
            return F.expr("cast(array() as array<bigint>)")
        return F.transform(F.array(*[F.lit(m) for m in ball(w, r)]), lambda m: key(i, value(s, w).bitwiseXOR(m)))

    table = exploded(lambda i, s, w, r: F.array(key(i, value(s, w))) if r >= 0 else F.expr("cast(array() as array<bigint>)"))
    probes = exploded(around)
    sizes = table.groupBy("key").count().where(F.col("count") > hot_bucket).select("key")
    hot = staged(sizes, "hot-segments")
    more = None
    if hot.count():
        members = table.unionByName(probes).join(hot, "key", "left_semi").select("fp").distinct()
        table = table.join(hot, "key", "left_anti")
        points = members.select("fp", F.explode(F.array(*[F.lit(m) for m in ball(64, bits // 2)])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
        centre = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        more = points.join(centre, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
        if bits % 2:
            raise ValueError("midpoints need an even number of bits")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= bits
    found = probes.alias("p").join(table.alias("t"), (F.col("p.key") == F.col("t.key")) & (F.col("p.fp") < F.col("t.fp")) & near)
    found = found.select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b")).distinct()
    return found if more is None else found.unionByName(more).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component, roots themselves left out."""

    def contract(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        pairs = both.join(least, "u")
        if large:
            return pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return pairs.select("u", "m").unionByName(pairs.select(F.col("v").alias("u"), "m")).where("u <> m").select("u", F.col("m").alias("v")).distinct()

    now, before = staged(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "edges"), None
    while True:
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = staged(contract(contract(mirrored, True), False), "stars")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen


def near_duplicates(docs: DataFrame, bits: int = BITS, size: int = SHINGLE, hot_bucket: int = 2000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most bits differing bits reach. Null and wordless
    texts have fingerprint zero and link like any other. Repeated rows stay, each with the same answer; a null
    doc_id keeps its row and is never a component_id unless its component has no other. Without rows: no rows.
    """
    rows = staged(fingerprints(docs, size), "fingerprints")
    unique = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique-fingerprints")
    n = unique.count()
    root = stars(links(unique, n, bits, hot_bucket))
    named = unique.join(root, unique.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = staged(named.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
