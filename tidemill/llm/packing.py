"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most that many counts, whatever
the number of documents: it is planned on the driver, exactly and for all pieces. The reduction fixes sets that
provably dominate every other set with the same piece; the remainder is packed best fit, longest first. The plan
is a list of patterns with multiplicities; pieces find their places by their rank among pieces of equal length,
which is counted in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_ids
from .shared import staged, trim

CAPACITY = 2048

Pattern = tuple[tuple[int, ...], int]


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed (lengths, times), and what is left. A fixed set F with piece j dominates: the other pieces of any
    feasible set with j can be parted so that each part is no longer than one other piece of F. Then some best
    packing holds F, since the parts and F's pieces may change places."""
    left, fixed = {s: c for s, c in counts.items() if c > 0}, []

    def fix(sizes: list[int]) -> None:
        need = Counter(sizes)
        times = min(left[s] // k for s, k in need.items())
        fixed.append((tuple(sorted(sizes, reverse=True)), times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]

    def fitting(limit: int, *used: int) -> int | None:
        """The longest piece up to limit, besides those used."""
        i = bisect_left(order, limit + 1) - 1
        while i >= 0:
            if left.get(order[i], 0) > used.count(order[i]):
                return order[i]
            i -= 1
        return None

    changed = True
    while changed:
        changed = False
        order = sorted(left)
        for j in reversed(order):
            while left.get(j):
                room = capacity - j
                k = fitting(room, j)
                if k is None:
                    fix([j])
                elif k == room:
                    fix([j, k])
                else:
                    small, need = [], 3
                    for s in order:
                        n = min(need - len(small), left.get(s, 0) - (s == j))
                        small += [s] * max(0, n)
                        if len(small) == need:
                            break
                    if len(small) < 2 or small[0] + small[1] > room:
                        fix([j, k])
                    elif len(small) < 3 or sum(small) > room:
                        best, second = _pairs(left, order, j, room)
                        b = fitting(room - k, j, k)
                        if k >= best:
                            fix([j, k])
                        elif b is not None and b >= second:
                            fix([j, k, b])
                        else:
                            break
                    else:
                        break
                changed = True
    return fixed, left


def _pairs(left: dict[int, int], order: list[int], j: int, room: int) -> tuple[int, int]:
    """Of all pairs that fit into room beside j: the greatest sum, and the greatest shorter piece."""
    sizes = [s for s in order if left.get(s, 0) > (s == j)]
    lo, hi, best, second = 0, len(sizes) - 1, 0, 0
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room:
            hi -= 1
            continue
        if lo < hi or left[a] - (a == j) > 1:
            best, second = max(best, a + b), max(second, a)
        lo += 1
    return best, second


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest first, each piece into the fullest sequence with room; like pieces and like sequences go together."""
    open_: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], times: int) -> None:
        if not open_[room]:
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append([sizes, times])

    for s in sorted(counts, reverse=True):
        m = counts[s]
        while m > 0:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                sizes, times = open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
            else:
                room, sizes, times = capacity, (), m
            q = room // s
            whole = min(times, m // q)
            rest = m - whole * q if whole < times and m - whole * q < q else 0
            if whole:
                put(room - q * s, (*sizes, *[s] * q), whole)
            if rest:
                put(room - rest * s, (*sizes, *[s] * rest), 1)
            if sizes and (spare := times - whole - bool(rest)):
                put(room, sizes, spare)
            m -= whole * q + rest
    return [(sizes, times) for groups in open_.values() for sizes, times in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Where the piece of a length and rank goes: (sequence, offset)."""

    def __init__(self, patterns: list[Pattern]):
        self.by: dict[int, list[tuple]] = defaultdict(list)
        base = 0
        for sizes, times in patterns:
            at = 0
            for s, k in sorted(Counter(sizes).items(), reverse=True):
                self.by[s].append((k * times, k, base, at))
                at += k * s
            base += times
        self.sequences = base
        self.by = {s: np.array(x, np.int64).T for s, x in self.by.items()}
        self.ends = {s: np.cumsum(x[0]) for s, x in self.by.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for s in np.unique(length).tolist():
            mine = np.flatnonzero(length == s)
            (n, k, base, at), ends = self.by[s], self.ends[s]
            e = np.searchsorted(ends, rank[mine], side="right")
            r = rank[mine] - (ends - n)[e]
            sequence[mine], offset[mine] = base[e] + r // k[e], at[e] + r % k[e] * s
        return sequence, offset


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids as bytes) of each piece of each row of docs, and deal,
    a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "deal"]

    def run(batches):
        encoder, dealt = token_ids.Encoder(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, bounds, ids in encoder.encode(batch.column(1)):
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(capacity, sizes[doc] - piece * capacity)
                raw, at = memoryview(ids.view(np.uint8)), 4 * (bounds[doc] + piece * capacity)
                cuts = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                found = [batch.column(0).take(pa.array(first + doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(list(map(zlib.crc32, cuts)), pa.int64())]
                found += [pa.array([bytes(c) for c in cuts], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays([*found, pa.array(np.arange(dealt, dealt + len(doc)))], names=names)
                dealt += len(doc)
        del encoder
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids + ", deal bigint")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (as by pieces(), written) with sequence_id and offset.

    Ranks among pieces of a length are counted by bucket first, so that a length that many pieces share is dealt
    to many tasks, also where rows repeat. Like rows are interchangeable: each gets a place of its own.
    """
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    sent = cut.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))  # at most some tens of capacity entries
    buckets = max(64, sum(counts.values()) // 50_000)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("deal"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("deal"))
    ranked = dealt.join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + within - 1).select(*[c for c in cut.columns if c != "deal"], "rank")
    at = ranked.columns.index("length")

    def run(batches):
        for batch in batches:
            where = sent.value.of(batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x) for x in where]], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes[:-1]) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) cut and packed: one row per piece. Null and empty texts are one piece, the end id;
    repeated rows are packed each; a text of any length is cut whole; other columns of docs don't matter, whatever
    their names; without rows: no rows."""
    return pack(staged(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of pieces with ids: sequence_id and ids (little-endian unsigned 32-bit), at most a capacity each."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(rows, F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
