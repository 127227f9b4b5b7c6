"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after every turn. A conversation whose turns are the first turns of a
longer one is dropped, and of equal ones the smallest id stays; the rest are rendered.

Rolling hashes of turn prefixes are sums of position-weighted turn hashes, so they can be computed by parts: turns
are dealt by ranges of (conversation, turn), each task sums its own, and the few conversations that cross a border
get the sums before it. A conversation of any length is never collected into one task. Prefixes of longer
conversations then meet whole conversations in one anti-join.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Two hashes modulo this prime, by these bases (fixed values).
PRIME = (1 << 61) - 1
BASES = (1_000_003, 998_244_353)
#: Turns in a rendered part. A conversation of more turns becomes several parts.
PART_TURNS = 1000
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def turn_hash(role: str | None, text: str | None) -> tuple[int, int]:
    """Two numbers from 1 of a turn; a null and an empty string differ."""
    parts = [b"\x00" if x is None else b"\x01" + x.encode("utf-8", "surrogatepass") for x in (role, text)]
    d = hashlib.blake2b(len(parts[0]).to_bytes(8, "little") + parts[0] + parts[1], digest_size=16).digest()
    return tuple(1 + int.from_bytes(d[i : i + 8], "little") % (PRIME - 1) for i in (0, 8))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 (hashes of the turns up to pos), last, turn, role, text.

    Turns are ordered by turn (nulls first), then role and text, so that equal turn numbers have one order too.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    turn = turns.schema["turn"].dataType.simpleString()
    own = turns.select(F.col("conv_id"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = own.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def local(batches):
        part = TaskContext.get().partitionId()
        key, n, h = object(), 0, [0, 0]
        for batch in batches:
            out = ([], [], [])
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != key:
                    key, n, h = conv, 0, [0, 0]
                n += 1
                for k, x in enumerate(turn_hash(role, text)):
                    h[k] = (h[k] + x * pow(BASES[k], n, PRIME)) % PRIME
                for o, v in zip(out, (n, *h), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int64()), *batch.columns, *[pa.array(o, pa.int64()) for o in out]], names=["part", "conv_id", "turn", "role", "text", "n", "h1", "h2"])

    found = staged(ordered.mapInArrow(local, f"part bigint, conv_id {kind}, turn {turn}, role string, text string, n bigint, h1 bigint, h2 bigint"), "turn-hashes")
    ends = found.groupBy("part").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id", "n")).alias("first"), F.max_by(F.struct("conv_id", "n", "h1", "h2"), F.struct(F.col("conv_id").isNotNull(), "conv_id", "n")).alias("last"))
    before, carried = {}, None
    for r in ends.orderBy("part").toLocalIterator():  # a row per task
        known = carried is not None and carried[0] == r["first"]
        if known:
            before[r["part"]] = carried
        conv, n, h1, h2 = r["last"]
        if known and conv == carried[0]:  # one conversation fills the whole part
            n, h1, h2 = n + carried[1], (carried[2] + h1 * pow(BASES[0], carried[1], PRIME)) % PRIME, (carried[3] + h2 * pow(BASES[1], carried[1], PRIME)) % PRIME
        carried = (conv, n, h1, h2)

    def whole(batches):
        for batch in batches:
            n, h1, h2 = (batch.column(i).to_pylist() for i in (5, 6, 7))
            for i, (part, conv) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (b := before.get(part)) and b[0] == conv:
                    n[i], h1[i], h2[i] = n[i] + b[1], (b[2] + h1[i] * pow(BASES[0], b[1], PRIME)) % PRIME, (b[3] + h2[i] * pow(BASES[1], b[1], PRIME)) % PRIME
            yield pa.RecordBatch.from_arrays([*batch.columns[1:5], *[pa.array(x, pa.int64()) for x in (n, h1, h2)]], names=["conv_id", "turn", "role", "text", "pos", "h1", "h2"])

    return found.mapInArrow(whole, f"conv_id {kind}, turn {turn}, role string, text string, pos bigint, h1 bigint, h2 bigint")


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All turns with prefix hashes, and the retained conversations: conv_id, n_turns, n_copies (equal conversations)."""
    hashed = staged(prefixes(turns), "turn-prefixes")
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    distinct = ends.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    lengths = ends.select("conv_id", F.col("pos").alias("n"))
    shorter = hashed.select("conv_id", "pos", "h1", "h2").join(lengths, hashed.conv_id.eqNullSafe(lengths.conv_id)).where("pos < n").select("pos", "h1", "h2").distinct()
    kept = distinct.join(shorter, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")
    return hashed, staged(kept, "maximal-conversations")


def render(hashed: DataFrame, kept: DataFrame, template: tuple[str, str, str] = TEMPLATE, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, n_turns, n_copies, part, rendered. Null roles and texts are rendered as empty."""
    named = kept.withColumnRenamed("conv_id", "kept_id")
    own = hashed.join(named, hashed.conv_id.eqNullSafe(named.kept_id))
    start, between, end = map(F.lit, template)
    line = F.concat(start, F.coalesce("role", F.lit("")), between, F.coalesce("text", F.lit("")), end)
    part = F.floor((F.col("pos") - 1) / part_turns).cast("long")
    rows = own.select("conv_id", "n_turns", "n_copies", part.alias("part"), F.struct("pos", line.alias("line")).alias("turn"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["line"]), "")
    return rows.groupBy("conv_id", "n_turns", "n_copies", "part").agg(joined.alias("rendered"))


def formatted(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE, part_turns: int = PART_TURNS) -> DataFrame:
    """turns (conv_id, turn, role, text) collapsed and rendered.

    Of equal conversations the smallest conv_id stays; a null conv_id is a conversation of its own. Repeated turns
    are turns. Without rows: no rows.
    """
    hashed, kept = maximal(turns)
    return render(hashed, kept, template, part_turns)


SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
  coalesce('r' || role, 'n') || chr(1) || coalesce('r' || text, 'n') AS body, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM conversations),
p AS (SELECT conv_id, pos, line, md5(string_agg(md5(body), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS h, max(pos) OVER (PARTITION BY conv_id) AS n FROM t),
e AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, h),
k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = e.n AND p.h = e.h))
SELECT k.conv_id, k.n::BIGINT AS n_turns, k.n_copies, ((pos - 1) // 1000)::BIGINT AS part, string_agg(line, '' ORDER BY pos) AS rendered
FROM k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2, 3, 4"""
