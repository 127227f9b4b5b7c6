"""Structured Streaming versions of the bucketed and stateful operators, and a file-backed message topic."""

from __future__ import annotations

import json
import os
import time as clock
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str], **made: Column) -> DataFrame:
    """Tumbling buckets with a bound on lateness: start_us, keys and the aggregates."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*[c.alias(n) for n, c in made.items()])
    return out.select(F.unix_micros("window.start").alias("start_us"), *keys, *made)


def running(stream: DataFrame, key: str, time: str, x: str, start: Callable[[], dict], step: Callable[[dict, float, float], float], timeout: str = "NoTimeout") -> DataFrame:
    """key, time, value of a state machine for each series that is kept between micro-batches.

    Rows of a micro-batch are taken in time order; step(state, time, x) changes the state, which must be JSON.
    """
    kind = stream.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("time", T.DoubleType()), T.StructField("value", T.DoubleType())])

    def run(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        own = json.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values("__t")
        values = [step(own, t, v) for t, v in zip(rows["__t"], rows["__x"], strict=True)]
        state.update((json.dumps(own),))
        yield pd.DataFrame({key: [k[0]] * len(rows), "time": rows["__t"], "value": values})

    rows = stream.select(key, F.col(time).cast("double").alias("__t"), F.col(x).cast("double").alias("__x"))
    return rows.groupBy(key).applyInPandasWithState(run, out, "state string", "append", timeout)


def cumulative_sum_step(state: dict, _t: float, x: float) -> float:
    state["sum"] = state.get("sum", 0.0) + x
    return state["sum"]


def ewma_step(alpha: float) -> Callable[[dict, float, float], float]:
    def step(state: dict, _t: float, x: float) -> float:
        state["s"] = x if "s" not in state else alpha * x + (1 - alpha) * state["s"]
        return state["s"]

    return step


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Takes what is there, once, through foreachBatch; a later run goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Topic:
    """An append-only message log in a folder of JSON line files, with cursors by consumer group.

    pull() doesn't move a cursor, ack() does: delivery is at least once. As a stream, the offsets are Spark's own.
    """

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(f"{folder}/log", exist_ok=True)

    def _files(self) -> list[tuple[int, int, str]]:
        found = []
        for n in sorted(os.listdir(f"{self.folder}/log")):
            if n.endswith(".json"):
                first, count = n.split("-")[:2]
                found.append((int(first), int(count), f"{self.folder}/log/{n}"))
        return found

    def next_offset(self) -> int:
        files = self._files()
        return files[-1][0] + files[-1][1] if files else self._meta().get("trimmed", 0)

    def _meta(self) -> dict:
        try:
            with open(f"{self.folder}/cursors") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _write(self, path: str, text: str) -> None:
        with open(f"{path}.{uuid.uuid4().hex}.tmp", "w") as f:
            f.write(text)
        os.replace(f.name, path)

    def publish(self, messages: list, now_ms: int | None = None) -> int:
        """Offset of the first of the messages, which become visible together."""
        first, now = self.next_offset(), now_ms if now_ms is not None else int(clock.time() * 1000)
        lines = "".join(json.dumps({"offset": first + i, "time": now, "body": m}) + "\n" for i, m in enumerate(messages))
        self._write(f"{self.folder}/log/{first:020d}-{len(messages)}-{now}.json", lines)
        return first

    def read(self, offset: int, n: int) -> list[dict]:
        out = []
        for first, count, path in self._files():
            if first + count > offset and len(out) < n:
                with open(path) as f:
                    out += [m for m in map(json.loads, f) if m["offset"] >= offset]
        return out[:n]

    def pull(self, group: str, n: int) -> list[dict]:
        return self.read(self._meta().get("groups", {}).get(group, 0), n)

    def ack(self, group: str, offset: int) -> None:
        """The group has done all up to and with the offset."""
        meta = self._meta()
        groups = meta.setdefault("groups", {})
        groups[group] = max(groups.get(group, 0), offset + 1)
        self._write(f"{self.folder}/cursors", json.dumps(meta))

    def trim(self, max_age_ms: int | None = None, max_bytes: int | None = None, acked: bool = False, now_ms: int | None = None) -> int:
        """Drops whole files from the oldest on: too old, beyond the size, or acknowledged by all groups. Number of messages dropped."""
        now, files = now_ms if now_ms is not None else int(clock.time() * 1000), self._files()
        meta = self._meta()
        low = min(meta.get("groups", {}).values(), default=0) if acked else 0
        total, dropped = sum(os.path.getsize(p) for *_, p in files), 0
        for first, count, path in files:
            size, at = os.path.getsize(path), int(path.rsplit("-", 1)[1][:-5])
            if not ((max_age_ms is not None and now - at > max_age_ms) or (max_bytes is not None and total > max_bytes) or first + count <= low):
                break
            os.remove(path)
            total, dropped = total - size, dropped + count
            meta["trimmed"] = first + count
        self._write(f"{self.folder}/cursors", json.dumps(meta))
        return dropped

    def stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema("offset bigint, time bigint, body string").json(f"{self.folder}/log")
