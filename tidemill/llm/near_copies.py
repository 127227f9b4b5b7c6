"""Near copies by SimHash and exact Jaccard similarity of word shingles; cells of the sets add what SimHash misses.

A text is the set of the XXH64 hashes of its shingles; equal sets are one set. SimHash fingerprints of all sets are
linked by multi-index hashing (simhash.links), and each pair that they propose is verified on complete sets.
A fingerprint says nothing for certain: sets of similarity PART / WHOLE may differ in more bits than can be looked up.
So the pairs beyond are found by cells: hashes are dealt into m cells by their high bits, and as a shingle that only one
set has changes one cell, of two sets as similar with d such shingles all cells but d are equal, whole. In one order for
all texts, cells with many rare shingles first, they therefore share one of the first d + 1 of each. That two sets agree
on a whole cell by chance is much rarer than on one shingle, whose sharers grow in number with the input. Bounds by
size, position and parity drop most others, and the rest are verified. The order rests on a sample and changes the time
only, never the pairs.
A cell that many sets share would make pairs with the square of their number: each set is first linked with one
set of each of its cells, the least in one of CENTRES orders, and only sets of different components are paired after that, those that pass the bounds
within the join, once for all cells that the same sets share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_bytes, passing, staged, trim
from .simhash import BITS, links, stars

#: Words in a shingle; similarity from which texts are near copies, as a fraction.
SHINGLE, PART, WHOLE = 5, 4, 5
#: Texts sampled for the order of shingles; frequent shingles kept of them.
ORDER_TEXTS, ORDER_SHINGLES = 4000, 50_000
#: Bins of the parities that go through joins (words of 64); rows, and bits, that a filter sent to all tasks stands for at most.
SKETCH, FILTER_ROWS, FILTER_BITS = 16, 1 << 22, 1 << 26
#: Cells of a small set, a power of two. Sets of CELLS * 2 ** i shingles and more, up to twice that, have as many cells.
CELLS = 64
#: Orders by which the sets of a cell choose the one that all are linked with first.
CENTRES = 4
#: Sets that a task knows to have given out the prefix of.
SEEN = 100_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending; a shorter text is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    joined, k = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64).view(np.int64))


def most_unlike(na: int, nb: int) -> int:
    """Shingles at most that only one of two sets of na and nb shingles has, if they are as similar as asked."""
    return (WHOLE - PART) * (na + nb) // (WHOLE + PART)


def cells(h: np.ndarray, rank: np.ndarray, m: int, first: int) -> np.ndarray:
    """Keys of the first so many of h's m cells in the common order; h ascends, rank is -1 for rare shingles."""
    bits = m.bit_length() - 1
    place = (h >> (64 - bits)) & (m - 1)
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    keys = np.add.reduceat(h.view(np.uint64), starts) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bits)
    order = np.lexsort((keys, np.minimum.reduceat(rank, starts), -np.add.reduceat((rank < 0).astype(np.int64), starts)))[:first]
    if first > len(keys):  # empty cells are equal too
        empty = np.setdiff1d(np.arange(m), place)[: first - len(keys)].astype(np.uint64)
        return np.concatenate((keys[order], (empty << np.uint64(8)) + np.uint64(bits))).view(np.int64)
    return keys[order].view(np.int64)


def prefix(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys of cells of which any other set as similar as asked has one: first those among m cells, as many as the set's
    size asks for, then, if smaller sets with half as many cells may be as similar, those among these."""
    n = len(h)
    own = most_unlike(n, n * WHOLE // PART)
    if not own:
        return h[:0]
    m = max(CELLS, 1 << (n.bit_length() - 1))
    found = cells(h, rank, m, own + 1)
    if m > CELLS and WHOLE * (m - 1) >= PART * n:
        found = np.concatenate((found, cells(h, rank, m // 2, most_unlike(m - 1, n) + 1)))
    return found


def parities(h: np.ndarray) -> bytes:
    """Whether an odd number of h falls into each of 2 to 4 len(h) bins (a power of two, 1024 at least), by the low bits."""
    bins = 1 << max(10, (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & (bins - 1), minlength=bins).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_alike(a: bytes, na: int, b: bytes, nb: int) -> bool:
    """False only for sets less similar than asked: bins of unlike parity are no more than elements in one set alone."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (WHOLE + PART) * int(np.bitwise_count(x ^ y).sum()) <= (WHOLE - PART) * (na + nb)


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set: the bits that over half of h have, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def sketch(bits: bytes) -> list[int]:
    """parities folded to SKETCH * 64 bins, in which the same bound holds, as signed 64-bit numbers."""
    x = np.frombuffer(bits, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, SKETCH * 8), axis=0).view("<i8").tolist()


def _among(keys: DataFrame) -> Column:
    """Whether a row with doc_id and digest may be among keys; true for all of them and for few others. It spares joins
    with few rows the shuffle of all; the join decides. Beyond FILTER_ROWS keys it is true for all."""
    n = keys.count()
    if n > FILTER_ROWS:
        return F.lit(True)
    size = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(size))
    marked = np.zeros(size, np.bool_)
    marked[keys.select(place.alias("place")).toArrow().column(0).to_numpy()] = True
    sent = keys.sparkSession.sparkContext.broadcast(np.packbits(marked, bitorder="little"))

    def run(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return F.arrow_udf(run, "boolean")(place)


def left_out(docs: DataFrame, out: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, digest and others) without those that out (doc_id, digest) names."""
    gone = out.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    may = _among(out)
    some = docs.where(may).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_anti")
    return docs.where(~may).unionByName(some)


def _frequent(docs: DataFrame) -> list[int]:
    """Shingles that several sampled texts have, the most frequent last."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in part.column(0).to_pylist()]))], names=["shingle"])

    some = docs.select("text").where(F.rand(7) < min(1.0, ORDER_TEXTS / max(1, docs.count())))
    counts = some.mapInArrow(run, "shingle bigint").groupBy("shingle").count().where("count > 2")
    return [r[0] for r in counts.orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES).collect()][::-1]


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), id (equal for equal sets), n (shingles), fp (SimHash), bits (parities), sketch and prefix, in
    the common order, of every row of docs; a task gives out the prefix of most sets once, whatever their copies."""
    order = np.array(_frequent(docs), np.int64)
    by_value = np.argsort(order)
    sent = docs.sparkSession.sparkContext.broadcast((order[by_value], by_value))  # bounded by ORDER_SHINGLES

    def ranks(h: np.ndarray) -> np.ndarray:
        values, rank = sent.value
        if not len(values):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
        return np.where(values[at] == h, rank[at], -1)

    def run(batches):
        seen: set[int] = set()

        def once(i: int, h: np.ndarray) -> np.ndarray:
            if len(h) < 2 or i in seen:
                return h[:0]
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(i)
            return prefix(h, ranks(h))

        for batch in batches:
            for part in by_bytes(batch, 2):
                found = [shingles(t) for t in part.column(2).to_pylist()]
                ids = [xxhash.xxh64_intdigest(h.tobytes(), 1) if len(h) else 0 for h in found]
                bits = [parities(h) for h in found]
                first = [once(i, h) for i, h in zip(ids, found, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first)))
                own = [pa.array(ids, pa.uint64()).view(pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array([fingerprint(h) for h in found], pa.int64())]
                own += [pa.array(bits, pa.binary()), pa.array([sketch(b) for b in bits], pa.list_(pa.int64())), lists]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own], names=["doc_id", "digest", "id", "n", "fp", "bits", "sketch", "prefix"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, digest string, id bigint, n bigint, fp bigint, bits binary, sketch array<bigint>, prefix array<bigint>"
    return docs.select("doc_id", digest().alias("digest"), "text").mapInArrow(run, fields)


def digest() -> Column:
    """The text's MD5; of a null text, no MD5's value."""
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _likely(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that may_be_alike lets pass."""
    marks = staged(rows.join(_ends(pairs), "id", "left_semi").groupBy("id").agg(F.first(F.struct("n", "bits")).alias("s")), "near-bits")
    one, two = (marks.select(F.col("id").alias(x), F.col("s.n").alias(f"n{x}"), F.col("s.bits").alias(f"b{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            passed = [may_be_alike(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(passed, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ba", "na", "bb", "nb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose complete sets are as similar as asked; sets are made again of one text of each id needed."""
    pairs = staged(_likely(staged(pairs.distinct(), "near-pairs"), rows), "near-likely")
    least = rows.join(_ends(pairs), "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("s"))
    wanted = staged(least.select("id", "s.doc_id", "s.digest"), "near-wanted")
    texts = docs.select("doc_id", digest().alias("digest"), "text").where(_among(wanted.select("doc_id", "digest")))
    named = wanted.select("id", F.col("doc_id").alias("own"), F.col("digest").alias("named"))
    texts = texts.join(named, (F.col("named") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "text")

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 1):
                found = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])
        trim()

    own = staged(texts.groupBy("id").agg(F.first("text").alias("text")).mapInArrow(run, "id bigint, shingles array<bigint>"), "near-sets")
    one, two = (own.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return staged(pairs.join(one, "a").join(two, "b").where((PART + WHOLE) * both >= PART * (F.size("sa") + F.size("sb"))).select("a", "b"), "near-links")


def proposed(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints differ in BITS bits or fewer: enough of them for the same components."""
    marked = staged(rows.where("n > 1").select("fp", "id").distinct(), "near-fingerprints")
    first = staged(marked.groupBy("fp").agg(F.min("id").alias("a")), "near-prints")
    equal = marked.join(first, "fp").where("a < id").select("a", F.col("id").alias("b"))
    near = links(first.select("fp"), first.count(), BITS)
    one, two = (first.select(F.col("fp").alias(x), F.col("a").alias(f"id{x}")) for x in "ab")
    near = near.join(one, "a").join(two, "b").select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))
    return equal.unionByName(near)


def components(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the ids of rows (as sets() gives them of docs) that have near copies, roots themselves left out."""
    entries = rows.where("n > 1").select("id", "n", F.posexplode("prefix").alias("at", "cell"))
    own = F.expr(f"(n + n * {WHOLE} div {PART}) * {WHOLE - PART} div {WHOLE + PART} + 1")  # what follows is among half as many cells
    entries = entries.select("id", "n", F.when(F.col("at") < own, F.col("at")).otherwise(F.col("at") - own).alias("at"), "cell")
    same = Window.partitionBy("cell")
    order = F.xxhash64("id", F.pmod("cell", F.lit(CENTRES)))
    centre = F.min(F.struct(order.alias("order"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"))).over(same)
    shared = entries.withColumn("lo", F.min("id").over(same)).withColumn("hi", F.max("id").over(same)).withColumn("centre", centre).where("lo < hi")
    shared = staged(shared.select("id", "n", "at", "cell", "centre.a", "centre.na", "centre.ata").dropDuplicates(["cell", "id"]), "near-shared")

    def alike(na: str, nb: str, ata: str, atb: str) -> Column:
        """Whether sizes, and the places of a first common cell, allow the similarity."""
        na, nb, ata, atb = map(F.col, (na, nb, ata, atb))
        return (WHOLE * F.least(na, nb) >= PART * F.greatest(na, nb)) & ((PART + WHOLE) * F.greatest(ata, atb) <= (WHOLE - PART) * (na + nb))

    starred = shared.where((F.col("a") != F.col("id")) & alike("n", "na", "at", "ata")).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    first = _verified(proposed(rows).unionByName(starred), rows, docs)
    root = staged(stars(first), "near-roots")
    known = shared.select("cell", "id", "n", "at").join(root, shared.id == root.node, "left").select("cell", "id", "n", "at", F.coalesce("root", "id").alias("root"))
    known = known.withColumn("lo", F.min("root").over(same)).withColumn("hi", F.max("root").over(same)).withColumn("group", F.bit_xor(F.xxhash64("id")).over(same)).where("lo < hi")
    # cells that the same sets share make the same pairs: one group stands for them, with the first place of each set
    known = staged(known.groupBy("group", "id").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.min("at").alias("at")), "near-known")
    own = rows.join(known.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("sketch").alias("s"))
    known = staged(known.join(own.select("id", *[F.col("s")[i].alias(f"s{i}") for i in range(SKETCH)]), "id"), "near-sketched")
    x, y = known.alias("x"), known.alias("y")
    unlike = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    passes = alike("x.n", "y.n", "x.at", "y.at") & ((WHOLE + PART) * unlike <= (WHOLE - PART) * (F.col("x.n") + F.col("y.n")))
    apart = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & passes)
    second = _verified(apart.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), rows, docs)
    return stars(first.unionByName(second))


def kept(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of the row that stays of each component of docs: the smallest doc_id, nulls last, then the smallest digest."""
    return _best(staged(sets(docs), "near-rows"), docs)


def dropped(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct (doc_id, digest) of rows of docs that don't stay, and whether rows that stay are repeated. No other table is left."""
    with passing(docs.sparkSession):
        rows = staged(sets(docs), "near-rows")
        best = staged(_best(rows, docs), "near-kept").select(F.col("doc_id").alias("own"), F.col("digest").alias("best"))
        same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("best"))
        marked = rows.select("doc_id", "digest").join(best, same, "left")
        verdicts = marked.groupBy("doc_id", "digest").agg(F.first(F.col("best").isNotNull()).alias("stays"), F.count(F.lit(1)).alias("times"))
        verdicts = staged(verdicts, "near-verdicts")
        out = staged(verdicts.where("not stays").select("doc_id", "digest"), "near-dropped", lasting=True)
        return out, not verdicts.where("stays and times > 1").isEmpty()


def _best(rows: DataFrame, docs: DataFrame) -> DataFrame:
    root = components(rows, docs)
    best = rows.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best"))
    named = best.join(root, best.id == root.node, "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best"))
    return named.select("best.doc_id", "best.digest")
