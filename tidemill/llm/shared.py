"""What the training-data operators share: the shared folder, staged tables and row-wise Arrow scoring."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Paths staged within passing(), which go at its end.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; where unset (as in tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df written to the shared folder and read back: computed once, short lineage, and safe when executors are lost.
    Within passing() it goes at its end, unless it is lasting."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if not lasting and (paths := _passing.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged within is deleted at the end; only lasting tables may be read after it."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def append_columns(
    df: DataFrame,
    fields: list[tuple[str, T.DataType]],
    compute: Callable[[], Callable[[list], list[list]]],
    text: str = "text",
) -> DataFrame:
    """df with further columns computed from its text column in Arrow batches.

    compute() runs once in each Python worker task and returns a function from a list of texts (None for
    null) to one list of values per field. A column of df that has a field's name is replaced.
    """
    kept = df.drop(*[n for n, _ in fields])
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    arrow = [_arrow(t) for _, t in fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = compute()
        for batch in batches:
            for part in by_bytes(batch, at):
                out = score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, t) for v, t in zip(out, arrow, strict=True)]], names=names)
        trim()

    return kept.mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that this worker no longer uses back to the system: workers wait for their next task beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batch: pa.RecordBatch, at: int, limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, so that many long texts are never held at once."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * limit / max(1, batch.column(at).nbytes))))
    for i in range(0, rows, step):
        yield batch.slice(i, step)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)
