"""Benchmark decontamination by a hash set of normalised test n-grams.

The benchmark's windows are few, so their hash set goes to every executor, behind a check of its size, and is made
once in each worker; the documents stream past it once, with no shuffle. Token windows are hashed in numpy, looked up in
the sorted set, and each hit is verified word by word. Of a benchmark beyond the bound only sorted hashes go out, and
hits are verified in a join on window texts; where even the hashes are too many, all windows are joined.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns, staged

#: Words in a window; bytes of benchmark text whose hash set may be in every worker (it takes about 60 times as much
#: memory); hashes that may be (8 bytes each).
WINDOW, BROADCAST_BYTES, BROADCAST_HASHES = 10, 2 << 20, 8 << 20

#: After lower-casing A-Z: digits, letters and all beyond ASCII. In UTF-8 these are just these bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("hit_spans", T.ArrayType(T.LongType()))]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Grams:
    """The benchmark's windows, by length, as sorted hashes and exact tuples of word numbers."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({str(i) for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        exact: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            for w in windows_of(words_of(text), size):
                exact[tuple(self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w)].add(number[str(item)])
        self.exact = dict(exact)
        by: dict[int, list] = defaultdict(list)
        for w in self.exact:
            by[len(w)].append(w)
        self.hashes = {n: np.unique(self._hash(np.array(ws, np.int64), n, True)) for n, ws in by.items()}

    @staticmethod
    def _hash(ids: np.ndarray, n: int, rows: bool = False) -> np.ndarray:
        """Of each row of ids, or of each window of n in a sequence of ids."""
        out = None
        for k in range(n):
            x = (ids[:, k] if rows else ids[k : len(ids) - n + 1 + k]).astype(np.uint64)
            out = x if out is None else out * _MIX + x
            out = out ^ (out >> np.uint64(29))
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Verified (start, end) word spans, and the numbers of the items that occur."""
        spans, items = [], set()
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        bad = np.concatenate(([0], np.cumsum(ids < 0)))
        for n, known in self.hashes.items():
            if len(ids) < n:
                continue
            whole = np.flatnonzero(bad[n:] == bad[:-n])
            if not len(whole):
                continue
            h = self._hash(ids, n)[whole]
            at = np.searchsorted(known, h)
            for i in whole[known[np.minimum(at, len(known) - 1)] == h].tolist():
                if (found := self.exact.get(tuple(ids[i : i + n].tolist()))) is not None:
                    spans.append((i, i + n))
                    items |= found
        return spans, items

    def report(self, texts: list[str | None]) -> list[list]:
        rows = []
        for t in texts:
            words = words_of(t)
            spans, items = self.scan(words)
            rows.append(summary(len(words), spans, [self.names[i] for i in items]))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]


def summary(n: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    hit = sum(b - a for a, b in merged)
    return n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0, [x for s in merged for x in s]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """docs (any columns, with text) and n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    hit_spans holds the merged start and end word numbers in turn. Null and wordless texts have no words and
    no hits; null or wordless items have no windows; items of one item_id count once, a null item_id under the
    name None. Columns of docs with one of these names are replaced. Repeated rows each get their answer.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total > broadcast_bytes:
        return _joined(docs, items, size, broadcast_hashes)
    sent, name = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.toLocalIterator()]), uuid.uuid4().hex

    def report():
        if name not in _OWN:
            _OWN.clear()
            _OWN[name] = Grams(sent.value, size)
        return _OWN[name].report

    return append_columns(docs, FIELDS, report)


#: The set that this worker process has made last, by its broadcast.
_OWN: dict[str, Grams] = {}


def remove_spans(text: str | None, spans: list[int] | None) -> str | None:
    """text without the words of the spans, cut from the first word's start to the last word's end."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at, out, last = [m.span() for m in WORD.finditer(raw.lower())], [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return (b"".join(out) + raw[last:]).decode("utf-8", "surrogatepass")


def _joined(docs: DataFrame, items: DataFrame, size: int, most: int) -> DataFrame:
    """The same answer by a shuffle join of window texts, for a benchmark that is too large to send out.

    Rows are keyed by a hash of their text, as equal texts have equal answers; the text itself stays where it is
    until the last join.
    """

    def windows(batches, lengths):
        for batch in batches:
            for i in range(batch.num_rows):
                key, words = batch.column(0)[i].as_py(), words_of(batch.column(1)[i].as_py())
                for n in lengths:
                    for lo in range(0, len(words) - n + 1, 4096):
                        ws = [b" ".join(words[k : k + n]) for k in range(lo, min(len(words) - n + 1, lo + 4096))]
                        at = range(len(ws))
                        if sent is not None:
                            h = np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
                            at = np.flatnonzero(sent.value[np.minimum(np.searchsorted(sent.value, h), len(sent.value) - 1)] == h).tolist()
                        if len(at):
                            yield pa.RecordBatch.from_pydict({"key": [key] * len(at), "at": [lo + k for k in at], "w": [ws[k] for k in at]}, schema=pa.schema([("key", pa.string()), ("at", pa.int64()), ("w", pa.binary())]))

    def grams(batches):
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(str(i), b" ".join(w), len(w)) for i, t in zip(names, texts, strict=True) for w in windows_of(words_of(t), size)]
            yield pa.RecordBatch.from_pydict({"item": [r[0] for r in rows], "w": [r[1] for r in rows], "n": [r[2] for r in rows]}, schema=pa.schema([("item", pa.string()), ("w", pa.binary()), ("n", pa.int64())]))

    test = staged(items.mapInArrow(grams, "item string, w binary, n bigint").distinct(), "test-windows")
    lengths = sorted(r[0] for r in test.select("n").distinct().collect())  # at most size of them
    sent = None
    if 0 < test.count() <= most:
        parts = test.select("w").mapInArrow(lambda b: (pa.RecordBatch.from_pydict({"h": pa.array([xxhash.xxh64_digest(w) for w in x.column(0).to_pylist()], pa.binary())}) for x in b), "h binary")
        sent = docs.sparkSession.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(r[0] for r in parts.toLocalIterator()), ">u8").astype(np.uint64)))
    keyed = docs.withColumn("__key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.select("__key", "text").dropDuplicates(["__key"])
    seen = texts.mapInArrow(lambda b: windows(b, lengths), "key string, at bigint, w binary")
    per = test.groupBy("w", "n").agg(F.collect_set("item").alias("items"))
    hits = seen.join(per, "w").groupBy("key").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    joined = keyed.join(hits.withColumnRenamed("key", "__key").withColumnRenamed("spans", "__spans").withColumnRenamed("items", "__items"), "__key", "left").drop("__key")
    columns = [c for c in docs.columns if c not in dict(FIELDS)]

    def finish(batches):
        for batch in batches:
            given = batch.to_pylist()
            rows = [summary(len(words_of(r["text"])), [(s["at"], s["to"]) for s in r["__spans"] or []], r["__items"] or []) for r in given]
            extra = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in columns], *[pa.array(v, k) for v, k in zip(extra, kinds, strict=True)]], names=[*columns, *[n for n, _ in FIELDS]])

    return joined.mapInArrow(finish, T.StructType([*[docs.schema[c] for c in columns], *[T.StructField(n, t) for n, t in FIELDS]]))


#: The same answer in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
h AS (SELECT k, i, n, item FROM s JOIN g USING (n, w)),
c AS (SELECT k, count(DISTINCT p) AS hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)"""
