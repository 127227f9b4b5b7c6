"""Token ids in Arrow stream files of fixed-size-list batches.

The documents' ids, each closed by an end id, form one stream in ascending doc_id order. A file holds a range of
documents as rows of equal length: input_ids (fixed-size list of unsigned ids, of 16 bits where the vocabulary allows,
else of 32) and mask (fixed-size list of bits, 1 for a token, 0 for the padding of a file's last row). All batches but
the last have as many rows, so any row's place follows by arithmetic, and a mapped file gives it without a copy.
Beside each file, a second stream lists its documents (doc_id, start within the file, n_tokens).

Files go to the shared folder under names of their own; the manifest that Spark commits names those of the
attempts that ended well, so a lost executor leaves at most an unnamed file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_ids
from .shared import fresh_path, staged, trim

#: Ids in a row; rows in a batch.
LENGTH, ROWS = 2048, 256
#: Bytes that end an Arrow stream (fixed value).
END_BYTES = 8


class Writer:
    """One file and its list of documents."""

    def __init__(self, uri: str, kind: pa.DataType, length: int = LENGTH, rows: int = ROWS, bits: int = 32):
        self.system, path = fs.FileSystem.from_uri(uri)
        self.length, self.rows, self.left, self.total = length, rows, np.zeros(0, np.uint32), 0
        self.dtype = np.dtype(f"<u{bits // 8}")
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(f"u{bits // 8}"), length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "rows": str(rows)})
        self.doc_schema = pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.system.open_output_stream(path), self.system.open_output_stream(path + ".docs")]
        self.out, self.index = (ipc.new_stream(s, k) for s, k in zip(self.sinks, (self.schema, self.doc_schema), strict=True))

    def add(self, doc_ids: pa.Array, bounds: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids: the i-th has those from bounds[i] to bounds[i + 1]."""
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(self.total + bounds[:-1]), pa.array(np.diff(bounds))], schema=self.doc_schema))
        self.total += len(ids)
        held, size = np.concatenate((self.left, ids)), self.rows * self.length
        whole = len(held) // size * size
        for at in range(0, whole, size):
            self._batch(held[at : at + size], size)
        self.left = held[whole:].copy()

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids.astype(self.dtype), mask)], schema=self.schema))

    def close(self) -> None:
        if real := len(self.left):
            whole = -(-real // self.length) * self.length
            self._batch(np.concatenate([self.left, np.zeros(whole - real, np.uint32)]), real)
        for x in (self.out, self.index, *self.sinks):
            x.close()


class Sequences:
    """Random access to a file's rows; of a local file without a copy, elsewhere by reading one batch at a time.

    All batches but the last take as many bytes, so a batch's place follows by arithmetic.
    """

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        source = (lambda p: pa.memory_map(p)) if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.file, self._docs = source(path), lambda: ipc.open_stream(source(path + ".docs"))
        self.schema = ipc.read_schema(self.file)
        self.length, self.rows = (int(self.schema.metadata[k]) for k in (b"length", b"rows"))
        self.first, self.kept = self.file.tell(), (-1, None)
        ends = self.file.size() - END_BYTES
        if self.first < ends:
            ipc.read_message(self.file)
            self.step = self.file.tell() - self.first
        self.n = -(-(ends - self.first) // self.step) if self.first < ends else 0

    def batch(self, i: int) -> pa.RecordBatch:
        if self.kept[0] != i:
            self.file.seek(self.first + i * self.step)
            self.kept = i, ipc.read_record_batch(ipc.read_message(self.file), self.schema)
        return self.kept[1]

    def __len__(self) -> int:
        return (self.n - 1) * self.rows + self.batch(self.n - 1).num_rows if self.n else 0

    def row(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of row i: views of the file's buffers."""
        batch, at = self.batch(i // self.rows), i % self.rows * self.length
        ids, mask = (c.values.slice(at, self.length) for c in batch.columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start to start + n of the file's stream, as views of its batches."""
        size = self.rows * self.length
        while n > 0:
            values = self.batch(start // size).column(0).values.to_numpy(zero_copy_only=True)
            part = values[start % size : start % size + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """doc_id, start, n_tokens of the file's documents, some at a time."""
        yield from self._docs()


def write(docs: DataFrame, vocabulary: str, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes docs (doc_id, text) and returns the manifest: part, file, n_docs, n_tokens, one row per file in doc_id order.

    Null and empty texts are the end id alone; a text of any length is written whole. Null doc_ids come first; rows with
    equal doc_ids follow each other, by a hash of their texts, so that they are dealt to several files too. Other
    columns of docs don't matter, whatever their names.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast(kind), "text").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        part, writer, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if writer is None and batch.num_rows:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.arrows"
                encoder = token_ids.Encoder(vocabulary)
                bits = 16 if encoder.library.get_vocab_size() <= 1 << 16 else 32
                writer = Writer(name, batch.column(0).type, length, rows, bits)
            for first, bounds, ids in encoder.encode(batch.column(1)) if batch.num_rows else ():
                writer.add(batch.column(0).slice(first, len(bounds) - 1), bounds, ids)
                n += len(bounds) - 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n], "n_tokens": [writer.total]})
            del encoder, writer
            trim()

    return staged(ordered.mapInArrow(run, "part bigint, file string, n_docs bigint, n_tokens bigint"), "manifest")


def read(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files, base = [], 0
    for r in manifest.orderBy("part").toLocalIterator():  # one row per file
        files.append((r["file"], base))
        base += r["n_tokens"]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                file, first = files[i]
                seq = Sequences(file)
                for docs in seq.documents():
                    crcs = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        crc = 0
                        for part in seq.tokens(start, n):
                            crc = zlib.crc32(part.astype("<u4").data, crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pc.add(docs.column(1), first), docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
