"""Vector search: exact top k, and an inverted-file index that prunes partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.scalar import distance, distance_score


def knn(df: DataFrame, column: str, query: list[float], k: int, metric: str = "cosine", tie: str | None = None) -> DataFrame:
    """The k nearest rows by distance ascending, with a distance column: a bounded top k in each task, then one merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("distance", distance(F.col(column), q, metric)).where("distance IS NOT NULL")
    return scored.orderBy("distance", *([tie] if tie else [])).limit(k)


def vector_search(df: DataFrame, column: str, query: list[float], k: int, metric: str = "cosine", tie: str | None = None) -> DataFrame:
    """knn with vector_distance and vector_score."""
    found = knn(df, column, query, k, metric, tie).withColumnRenamed("distance", "vector_distance")
    return found.withColumn("vector_score", distance_score(F.col("vector_distance"), metric))


def scored(df: DataFrame, column: str, query: list[float], metric: str = "cosine") -> DataFrame:
    """All rows with a vector, with their vector_score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("vector_score", distance_score(distance(F.col(column), q, metric), metric)).where("vector_score IS NOT NULL")


def parse_vector(text, size: int | None = None):
    """A vector column of JSON array text."""
    v = F.from_json(text, "array<double>")
    return v if size is None else F.when(F.size(v) == size, v)


def hybrid(text_scores: DataFrame, vector_scores: DataFrame, key: str, text_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """key, bm25, vector_score, hybrid_score of (key, bm25) and (key, vector_score): text scores by their maximum."""
    most = text_scores.agg(F.max("bm25").alias("__most"))  # one row
    text = text_scores.crossJoin(F.broadcast(most)).select(key, "bm25", F.coalesce(F.try_divide("bm25", "__most"), F.lit(0.0)).alias("__t"))
    both = text.join(vector_scores.select(key, "vector_score"), key, "full")
    score = text_weight * F.coalesce("__t", F.lit(0.0)) + vector_weight * F.coalesce("vector_score", F.lit(0.0))
    return both.select(key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), score.alias("hybrid_score"))


def hybrid_measurement(near: DataFrame, docs: DataFrame, on, text_scores: DataFrame, doc_vectors: DataFrame | None = None, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), metric: str = "cosine") -> DataFrame:
    """Measurement rows with a distance, joined to documents (id) by a condition, and their hybrid_score.

    Parts: the measurement's score, text by its maximum, and the document's own vector_score; an absent one is 0.
    """
    most = text_scores.agg(F.max("bm25").alias("__most"))  # one row
    text = text_scores.crossJoin(F.broadcast(most)).select(F.col("id").alias("__tid"), F.coalesce(F.try_divide("bm25", "__most"), F.lit(0.0)).alias("text_score"))
    both = near.withColumn("measurement_score", distance_score(F.col("distance"), metric)).join(docs, on).join(text, F.col("id") == F.col("__tid"), "left").drop("__tid")
    if doc_vectors is not None:
        both = both.join(doc_vectors.select(F.col("id").alias("__vid"), "vector_score"), F.col("id") == F.col("__vid"), "left").drop("__vid")
    else:
        both = both.withColumn("vector_score", F.lit(0.0))
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("measurement_score", "text_score", "vector_score")]
    return both.withColumn("hybrid_score", sum((w * p for w, p in zip(weights[1:], parts[1:], strict=True)), weights[0] * parts[0]))


class IvfIndex:
    """Rows written by their nearest of lists centroids; a search reads the nearest probes lists only.

    Centroids are fitted on a sample of at most sample_rows vectors; every row is indexed. probes is the share of the
    lists that a search reads: recall depends on it, whatever the number of lists.
    """

    def __init__(self, lists: int = 64, probes: int = 32, sample_rows: int = 50_000, seed: int = 1):
        self.lists, self.probes, self.sample_rows, self.seed = lists, probes, sample_rows, seed
        self.centres: list[list[float]] = []
        self.path = ""

    def build(self, df: DataFrame, column: str, path: str) -> IvfIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = df.count()
        few = df.select(column).where(F.rand(self.seed) < min(1.0, 1.2 * self.sample_rows / max(1, n))).limit(self.sample_rows)
        model = KMeans(k=min(self.lists, max(1, n)), maxIter=25, seed=self.seed).fit(few.select(array_to_vector(F.col(column).cast("array<double>")).alias("features")))
        self.centres = [c.tolist() for c in model.clusterCenters()]
        lists = F.coalesce(F.get(_near_centres(self.centres, 1)(F.col(column)), 0), F.lit(0))
        df.withColumn("ivf_list", lists).repartition("ivf_list", F.pmod(F.xxhash64(column), F.lit(16))).write.partitionBy("ivf_list").parquet(path)
        self.path = path
        return self

    def search(self, spark, column: str, query: list[float], k: int, metric: str = "cosine", tie: str | None = None, probes: int | None = None) -> DataFrame:
        import math

        near = sorted(range(len(self.centres)), key=lambda i: math.dist(self.centres[i], query))[: probes or self.probes]
        return knn(spark.read.parquet(self.path).where(F.col("ivf_list").isin(near)), column, query, k, metric, tie)


    def search_many(self, queries: DataFrame, key: str, column: str, k: int, metric: str = "cosine", tie: str = "vec_id", probes: int | None = None) -> DataFrame:
        """(query, tie, distance): the k nearest rows of each of a stated set of queries (key, column)."""
        n = probes or self.probes
        near = _near_centres(self.centres, n)(F.col(column))
        lists = F.when(F.size(near) > 0, near).otherwise(F.sequence(F.lit(0), F.lit(min(n, len(self.centres)) - 1)))
        asked = queries.select(F.col(key).alias("query"), column, F.explode(lists).alias("ivf_list"))
        rows = queries.sparkSession.read.parquet(self.path).select(tie, column, "ivf_list")
        return _nearest_in_lists(rows, asked, column, k, metric, tie, "ivf_list")


def nearest_many(df: DataFrame, queries: DataFrame, key: str, column: str, k: int, metric: str = "cosine", tie: str = "vec_id") -> DataFrame:
    """(query, tie, distance): the k nearest of all rows for each of a set of queries (key, column), exactly."""
    asked = queries.select(F.col(key).alias("query"), column, F.lit(0).alias("__list"))
    return _nearest_in_lists(df.select(tie, column, F.lit(0).alias("__list")), asked, column, k, metric, tie, "__list")


#: Rows and queries that meet in one task at most, and their distances held at once.
ROWS, QUERIES, HELD = 32_768, 8_192, 1 << 21
#: Tasks that share the rows, where these are few lists of at least SPREAD_ROWS for each.
SPREAD, SPREAD_ROWS = 32, 1024


def _nearest_in_lists(rows: DataFrame, asked: DataFrame, column: str, k: int, metric: str, tie: str, part: str) -> DataFrame:
    """(query, tie, distance): the k nearest rows (tie, column, part) of each query (query, column, part) with the same part,
    a small number from 0. Parts are cut into slices of rows and of queries; each pair of slices is one bounded task, which
    returns its k nearest rows of each query. Pairs without a distance don't count."""
    count = lambda df: dict(df.groupBy(part).count().collect())  # noqa: E731  a row per list
    held, asks = count(rows), count(asked)
    both = sorted(held.keys() & asks.keys())
    spread = -(-SPREAD // max(1, len(both)))
    wide = [max(min(spread, -(-held[i] // SPREAD_ROWS)), -(-held[i] // ROWS)) if i in asks else 0 for i in range(max(both, default=0) + 1)] if both else [0]
    high = [-(-asks[i] // QUERIES) if w else 0 for i, w in enumerate(wide)]
    first = [sum(w * h for w, h in zip(wide[:i], high[:i], strict=True)) for i in range(len(wide))]
    of = lambda x: F.coalesce(F.get(F.array(*[F.lit(n) for n in x]), F.col(part)), F.lit(0))
    kinds = {rows.schema[column].dataType.simpleString(), asked.schema[column].dataType.simpleString()}
    vector = F.col(column) if kinds == {"array<float>"} else F.col(column).cast("array<double>")
    to = lambda n: F.sequence(F.lit(0), n - 1)

    own, other, name = F.pmod(F.xxhash64(tie, column), of(wide)), F.pmod(F.xxhash64("query", column), of(high)), rows.schema[tie].dataType
    left = rows.where(of(wide) > 0).select(F.col(tie).alias("__id"), F.lit(None).cast(asked.schema["query"].dataType).alias("query"), vector.alias("__v"), F.lit(False).alias("__asks"), (of(first) + own * of(high)).alias("__at"), F.explode(to(of(high))).alias("__add"))
    right = asked.where(of(high) > 0).select(F.lit(None).cast(name).alias("__id"), "query", vector.alias("__v"), F.lit(True).alias("__asks"), (of(first) + other).alias("__at"), F.explode(F.transform(to(of(wide)), lambda i: i * of(high))).alias("__add"))
    cells = left.unionByName(right).select("__id", "query", "__v", "__asks", (F.col("__at") + F.col("__add")).cast("int").alias("__cell"))
    schema = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField(tie, name), T.StructField("distance", T.DoubleType())])

    def found(cell: pa.Table) -> pa.Table:
        asks = cell["__asks"].combine_chunks()
        q, r = cell.filter(asks), cell.filter(pc.invert(asks))
        ids = r["__id"].combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        bases = _matrices(r["__v"].combine_chunks())
        for size, (at, x) in _matrices(q["__v"].combine_chunks()).items():
            if size in bases:
                base_at, base = bases[size]
                parts += [(at[i], base_at[j], d) for i, j, d in _nearest(x, *_few_copies(base, rank[base_at], k), k, metric)]
        i, j, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table([q["query"].take(pa.array(i)), ids.take(pa.array(j)), pa.array(d)], names=schema.fieldNames())

    tasks = max(1, sum(w * h for w, h in zip(wide, high, strict=True)))
    out = cells.repartitionById(tasks, "__cell").groupBy("__cell").applyInArrow(found, schema)
    return top_per_group(out, ["query"], ["distance", tie], k).select("query", tie, "distance")


def _near_centres(centres: list[list[float]], k: int):
    """A function of a vector column: the numbers of the k centres nearest by l2, nearest first; none without a distance."""

    @F.arrow_udf("array<int>")
    def near(v: pa.Array) -> pa.Array:
        base = np.array(centres, np.float64)
        i, j, size = [], [], np.zeros(len(v) + 1, np.int64)
        for at, x in (m for n, m in _matrices(v).items() if n == base.shape[1]):
            for a, b, _ in _nearest(x, base, np.arange(len(base)), np.arange(len(base)), k, "l2"):
                i.append(at[a])
                j.append(b)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
        np.add.at(size, i + 1, 1)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(j[np.argsort(i, kind="stable")], pa.int32()))

    return near


def _matrices(v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the positions of the vectors and the vectors. Those that are null or hold a null are left out."""
    sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten()
    begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    if flat.null_count:
        sizes[np.repeat(np.arange(len(v)), np.maximum(sizes, 0))[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    return {int(n): (at := np.flatnonzero(sizes == n), x[begin[at][:, None] + np.arange(n)].astype(np.float64)) for n in np.unique(sizes) if n >= 0}


def _few_copies(base: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors, of equal ones the k of least rank (others are in no result), with their ranks and positions."""
    order = np.argsort(rank, kind="stable")
    if base.shape[1]:
        _, same = np.unique(np.ascontiguousarray(base[order]).view(np.dtype((np.void, base.shape[1] * 8))).ravel(), return_inverse=True)
        by = np.argsort(same, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(same[by]) > 0])
        order = np.sort(by[np.arange(len(by)) - np.repeat(begin, np.diff(np.r_[begin, len(by)])) < k])
        order = np.argsort(rank, kind="stable")[order]
    return base[order], rank[order], order


def _sums(terms: Iterator[np.ndarray], n: int) -> np.ndarray:
    """Sums in the order of the elements, as functions.scalar has them."""
    total = np.zeros(n)
    for x in terms:
        total += x
    return total


def _nearest(x: np.ndarray, base: np.ndarray, rank: np.ndarray, own: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of x the k nearest of base by (distance, rank), as positions in x, own of those in base, and distances,
    in order. A matrix product proposes all within its rounding error; their distances are those of scalar.distance."""
    metric = {"euclidean": "l2", "dot": "inner_product"}.get(metric, metric)
    if metric not in ("cosine", "l2", "inner_product"):
        raise ValueError(f"unknown metric: {metric}")
    size = base.shape[1]
    norm = lambda m: np.sqrt(_sums((m[:, c] * m[:, c] for c in range(size)), len(m)))
    with np.errstate(all="ignore"):
        xn, bn = norm(x), norm(base)
        far = float(np.max(bn, initial=0.0))
        step = max(1, HELD // max(1, len(base)))
        for a in range(0, len(x) if len(base) else 0, step):
            q, qn = x[a : a + step], xn[a : a + step, None]
            dots = q @ base.T
            if metric == "cosine":
                about, off = -dots / (qn * bn), 1e-9
            elif metric == "l2":
                about, off = qn * qn + bn * bn - 2 * dots, 1e-9 * (qn * qn + far * far)
            else:
                about, off = -dots, 1e-9 * qn * far
            if len(base) > k:
                maybe = ~(about > np.partition(about, k - 1, axis=1)[:, k - 1 : k] + off)
            else:
                maybe = np.ones(about.shape, bool)
            i, j = np.nonzero(maybe)
            d = np.empty(len(i))
            for b in range(0, len(i), HELD // 8):
                p, r = q[i[b : b + HELD // 8]], base[j[b : b + HELD // 8]]
                if metric == "l2":
                    d[b : b + len(p)] = np.sqrt(_sums(((p[:, c] - r[:, c]) ** 2 for c in range(size)), len(p)))
                else:
                    dot = _sums((p[:, c] * r[:, c] for c in range(size)), len(p))
                    d[b : b + len(p)] = 1 - dot / (qn[i[b : b + len(p)], 0] * bn[j[b : b + len(p)]]) if metric == "cosine" else -dot
            if metric == "cosine" and (none := qn[i, 0] * bn[j] == 0).any():  # no distance to zero
                i, j, d = i[~none], j[~none], d[~none]
            order = np.lexsort((rank[j], d, i))
            i, j, d = i[order], j[order], d[order]
            begin = np.flatnonzero(np.r_[True, np.diff(i) > 0]) if len(i) else np.zeros(0, np.int64)
            kept = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)])) < k
            yield a + i[kept], own[j[kept]], d[kept]


def quantize8(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """df with 8-bit codes of each vector and the step that restores them: code * step + low."""
    v = F.col(column)
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    step = F.when(high > low, (high - low) / 255.0).otherwise(F.lit(1.0))
    codes = F.transform(v, lambda x: F.round((x.cast("double") - low) / step).cast("int"))
    return df.withColumn(name, F.struct(codes.alias("codes"), low.alias("low"), step.alias("step")))


def restore8(code):
    return F.transform(code["codes"], lambda x: x * code["step"] + code["low"])


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps only k per task before the shuffle."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= k).drop("__k")
