"""Balanced label propagation: documents into shards of equal row counts, linked documents together.

Documents with equal texts are linked. All work on labels is done on counts per (group, shard), so a group of any
size is at most as many rows as there are shards. Each round joins every group to its members' shards, proposes
the shard where most of them are, and accepts moves up to a capacity somewhat over the quota: large moves (a bounded
number) one by one and in part, small ones by hashed batches. What then exceeds a quota goes where there is room, small
groups first and whole but at the borders of the room, so that full shards can exchange documents. Rounds go on while
the number of cut edges falls. Documents without links then fill every shard to its quota, at no cost in cut edges.
Ranks are counted by bucket first and never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

SHARDS = 16
#: Batches of small moves; a move is large above this part of a shard; capacity over the quota within a round, as a part of a shard.
BATCHES, LARGE, SLACK = 256, 256, 2


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) as doc_id, size, text_crc32, law, shard, slot, grown_shard; law is rows: counts differ by one at most.

    Null texts have size 1 and crc 0 and link with no other; empty texts are equal texts. Rows with equal doc_ids
    are placed each. Other columns of docs don't matter, whatever their names. Without rows: no rows. Large groups fill
    whole shards and are cut where a shard is full.
    """
    n_all = docs.count()
    buckets = max(256, n_all // 100_000)
    text = F.col("text")
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.when(text.isNotNull(), F.md5(text.cast("binary"))).otherwise(F.concat(F.lit("00"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))).alias("g"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket"),
    )
    rows = staged(base, "shard-rows")
    quota = [n_all // shards + (s < n_all % shards) for s in range(shards)]

    per = rows.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_group = Window.partitionBy("g")
    before = F.sum("n").over(by_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(per.select("g", "bucket", "n", F.coalesce(before, F.lit(0)).alias("first"), F.sum("n").over(by_group).alias("total")), "shard-starts")
    state = staged(starts.where("total > 1").groupBy("g", F.pmod("bucket", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n").alias("n")), "shard-state")
    state, turn = staged(_within(state, quota), "shard-state"), 0
    cut = cut_edges(state)
    while cut:
        moved = _round(state, quota, n_all // shards, turn)
        if moved is None:
            break
        moved = staged(_within(staged(moved, "shard-moved"), quota), "shard-state")
        now = cut_edges(moved)
        if now >= cut:
            break
        state, cut, turn = moved, now, turn + 1

    load = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}
    free = [q - load.get(s, 0) for s, q in enumerate(quota)]
    ends = [sum(free[: s + 1]) for s in range(shards)]

    upto = F.sum("n").over(Window.partitionBy("g").orderBy("shard"))
    ranges = state.select("g", "shard", upto.alias("to")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("to", "shard"))).alias("ranges"))
    keyed = starts.join(ranges, "g", "left").select("g", "bucket", "first", "total", "ranges")
    rank = F.col("first") + F.row_number().over(Window.partitionBy("g", "bucket").orderBy("doc_id"))
    mine = F.filter("ranges", lambda r: r["to"] >= F.col("rank"))[0]["shard"]
    linked = rows.join(keyed, ["g", "bucket"]).withColumn("rank", rank).select("doc_id", "size", "text_crc32", "bucket", F.when(F.col("ranges").isNotNull(), mine).alias("own"))
    linked = staged(linked, "shard-linked")

    single = _numbered(linked.where("own is null"), ["bucket"], [])
    at = F.aggregate(F.array(*[F.lit(e).cast("long") for e in ends]), F.lit(0), lambda a, e: a + (F.col("number") >= e).cast("int"))
    placed = single.select("doc_id", "size", "text_crc32", "bucket", at.alias("shard")).unionByName(linked.where("own is not null").withColumnRenamed("own", "shard"))
    placed = staged(placed, "shard-placed")
    slots = _numbered(placed, ["bucket"], ["shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("number").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _numbered(df: DataFrame, bucket: list[str], within: list[str]) -> DataFrame:
    """df with number: gapless from 0, within each value of within; counted by bucket first."""
    keys = [*within, *bucket]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*within) if within else Window.partitionBy()
    first = F.coalesce(F.sum("__n").over(over.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, first.alias("__first"))  # a row per bucket and value
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "text_crc32"))
    return df.join(offsets, keys).withColumn("number", F.col("__first") + inner - 1).drop("__first")


def cut_edges(state: DataFrame) -> int:
    """Pairs of linked documents in different shards."""
    n = F.col("n").cast("decimal(38,0)")
    each = state.groupBy("g").agg(F.sum(n).alias("t"), F.sum(n * n).alias("q"))
    return int(each.agg(F.sum((F.col("t") * F.col("t") - F.col("q")).cast("decimal(38,0)"))).first()[0] or 0) // 2


def _round(state: DataFrame, quota: list[int], share: int, turn: int) -> DataFrame | None:
    """state after one round of accepted moves; None if there were none."""
    load = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}  # a row per shard
    free = [q + share // SLACK - load.get(s, 0) for s, q in enumerate(quota)]
    opened = [s for s, f in enumerate(free) if f > 0]
    if not opened:
        return None
    room = F.element_at(F.array(*[F.lit(max(0, f)).cast("long") for f in free]), F.col("target") + 1)
    is_open = F.col("shard").isin(opened)
    least = max(1, share // LARGE)
    whole, state = state, state.where(F.col("n") < share)  # a group that fills a shard stays there
    target = F.max_by("shard", F.when(is_open, F.struct("n", F.xxhash64("g", "shard", F.lit(turn))))).alias("target")
    best = state.groupBy("g").agg(target, F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"), F.max(is_open).alias("some"))
    wanted = state.join(best.where("parts > 1 and some"), "g").where("shard <> target")
    wanted = wanted.where(is_open | (F.col("all") <= least)).select("g", "shard", "n", "target")
    wanted = staged(wanted, "shard-moves")

    large = wanted.where(F.col("n") > least)  # their number is bounded: each is a fixed part of a shard
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("target").orderBy(F.desc("n"), "g", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = large.withColumn("ok", F.greatest(F.lit(0), F.least(F.col("n"), room - ahead)))
    taken = {r[0]: r[1] for r in large.groupBy("target").agg(F.sum("ok")).collect()}  # a row per shard

    small = wanted.where(F.col("n") <= least).withColumn("batch", F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(BATCHES)))
    batches = small.groupBy("target", "batch").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("target").orderBy("batch"))
    left = F.element_at(F.array(*[F.lit(max(0, f - taken.get(s, 0))).cast("long") for s, f in enumerate(free)]), F.col("target") + 1)
    fits = batches.withColumn("upto", upto).where(F.col("upto") <= left).select("target", "batch")
    small = small.join(F.broadcast(fits), ["target", "batch"]).withColumn("ok", F.col("n"))  # at most shards * batches rows
    done = staged(large.where("ok > 0").select("g", "shard", "target", "ok").unionByName(small.select("g", "shard", "target", "ok")), "shard-accepted")
    if not done.count():
        return None
    deltas = done.select("g", F.col("target").alias("shard"), F.col("ok").alias("n")).unionByName(done.select("g", "shard", (-F.col("ok")).alias("n")))
    return whole.unionByName(deltas).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def _within(state: DataFrame, quota: list[int]) -> DataFrame:
    """state with no shard over its quota: what is over goes to shards with room.

    The shard's smallest counts go first, in one order, and are dealt by ranges of the free room, so that groups are
    cut only where a range ends.
    """
    load = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}
    over = {s: load.get(s, 0) - q for s, q in enumerate(quota) if load.get(s, 0) > q}
    if not over:
        return state
    excess = F.element_at(F.array(*[F.lit(over.get(s, 0)).cast("long") for s in range(len(quota))]), F.col("shard") + 1)
    batch = F.floor(F.log2("n")) * BATCHES + F.pmod(F.xxhash64("g"), F.lit(BATCHES))
    hot = state.where(F.col("shard").isin(list(over))).withColumn("batch", batch)
    sums = hot.groupBy("shard", "batch").agg(F.sum("n").alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("shard").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sums.select("shard", "batch", ahead.alias("first"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "batch").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = hot.join(F.broadcast(first), ["shard", "batch"]).withColumn("at", F.col("first") + inner).withColumn("off", F.least(F.col("n"), F.greatest(F.lit(0), excess - F.col("at")))).where("off > 0")
    bases, run = {}, 0
    for s in sorted(over):
        bases[s] = run
        run += over[s]
    spans, at = [], 0
    for s, q in enumerate(quota):
        room = q - load.get(s, 0)
        if room > 0:
            spans.append((s, at, at + room))
            at += room
    base = F.element_at(F.array(*[F.lit(bases.get(s, 0)).cast("long") for s in range(len(quota))]), F.col("shard") + 1)
    place = cut.withColumn("lo", base + F.col("at")).withColumn("hi", base + F.col("at") + F.col("off"))
    parts = F.array(*[F.struct(F.lit(s).alias("shard"), (F.least(F.col("hi"), F.lit(b)) - F.greatest(F.col("lo"), F.lit(a))).cast("long").alias("n")) for s, a, b in spans])
    added = place.select("g", F.inline(F.filter(parts, lambda p: p["n"] > 0)))
    deltas = added.unionByName(place.select("g", "shard", (-F.col("off")).cast("long").alias("n")))
    return state.unionByName(deltas).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0")
