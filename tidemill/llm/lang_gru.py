"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every position, and pools the positions'
log-probabilities over the whole document. It is trained in numpy on the driver by backpropagation through time,
from windows of a bounded number of labelled texts of each language; scoring runs in Arrow batches over all windows of every text, in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns

#: Bytes in a window; states of each direction; size of a byte's vector.
WINDOW, STATES, VECTOR = 64, 8, 8
#: Distinct texts of a language that the sample takes, and windows of a text; passes over the sample and steps at least.
SAMPLE_ROWS, SAMPLE_WINDOWS, EPOCHS, STEPS = 400, 4, 8, 150
#: Windows scored at once.
BATCH = 2048

FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType())]


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2):
    """True where crc32 of the id as text leaves this remainder; a null id is read as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """All of the text's bytes as rows of size; the last is filled with the byte 0. ASCII letters in lower case."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    out = np.zeros(-(-len(raw) // size) * size, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1, size)


class Network:
    """Forward and backward gated recurrent units over bytes, and a softmax at every position."""

    def __init__(self, languages: list[str], seed: int = 1, states: int = STATES, vector: int = VECTOR):
        rng = np.random.default_rng(seed)
        self.languages, n, k = languages, states, len(languages)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"vectors": draw(256, vector) * 4, "out": draw(2 * n, k), "bias": np.zeros(k, np.float32)}
        for d in "fb":
            self.w |= {d + "in": draw(vector, 3 * n), d + "bias": np.zeros(3 * n, np.float32), d + "rec": draw(n, 3 * n)}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States at every position, x being (steps, windows) bytes; with the gates, if they are to be kept."""
        table = self.w["vectors"] @ self.w[d + "in"] + self.w[d + "bias"]
        rec, n = self.w[d + "rec"], len(self.w[d + "rec"])
        h, out, gates = np.zeros((x.shape[1], n), np.float32), np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a, r = table[x[t]], h @ rec
            a[:, : 2 * n] += r[:, : 2 * n]
            z = np.tanh(0.5 * a[:, : 2 * n])
            z *= 0.5
            z += 0.5
            update, reset = z[:, :n], z[:, n:]
            c = np.tanh(a[:, 2 * n :] + reset * r[:, 2 * n :])
            if keep:
                gates.append((t, h, update, reset, c, r[:, 2 * n :]))
            h = c + update * (h - c)
            out[t] = h
        return out, gates

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(steps, windows, languages) of windows' bytes (windows, steps)."""
        x = np.ascontiguousarray(x.T)
        f, b = self._run(x, "f", False)[0], self._run(x, "b", False)[0]
        n = f.shape[-1]
        return f @ self.w["out"][:n] + b @ self.w["out"][n:] + self.w["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all real positions of windows x with labels y, and its gradients, by backpropagation through time."""
        x = np.ascontiguousarray(x.T)
        f, gf = self._run(x, "f", True)
        b, gb = self._run(x, "b", True)
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        real = (x > 0)[..., None].astype(np.float32)
        count = max(1.0, float(real.sum()))
        loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), axis=2) + 1e-9) * real).sum()) / count
        p[:, np.arange(x.shape[1]), y] -= 1
        p *= real / count
        k, n = p.shape[-1], f.shape[-1]
        g = {"out": both.reshape(-1, 2 * n).T @ p.reshape(-1, k), "bias": p.sum((0, 1)), "vectors": np.zeros_like(self.w["vectors"])}
        up = p @ self.w["out"].T
        for d, gates, part in (("f", gf, up[..., :n]), ("b", gb, up[..., n:])):
            rec, win = self.w[d + "rec"], self.w[d + "in"]
            g |= {d + "rec": np.zeros_like(rec), d + "bias": np.zeros(3 * n, np.float32)}
            table = np.zeros((256, 3 * n), np.float32)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, h, update, reset, c, r in reversed(gates):
                dh = dh + part[t]
                dc = dh * (1 - update) * (1 - c * c)
                du = dh * (h - c) * update * (1 - update)
                dr = dc * r * reset * (1 - reset)
                da = np.concatenate([du, dr, dc], axis=1)
                drec = np.concatenate([du, dr, dc * reset], axis=1)
                g[d + "rec"] += h.T @ drec
                np.add.at(table, x[t], da)
                dh = dh * update + drec @ rec.T
            g[d + "bias"] = table.sum(0)
            g[d + "in"] = self.w["vectors"].T @ table
            g["vectors"] += table @ win.T
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, seed: int = 2) -> Network:
        rng = np.random.default_rng(seed)
        m, v, step = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2)), None, 0
        m, v = m
        passes = max(epochs, -(-STEPS // -(-len(x) // batch)))
        for _ in range(passes):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                some, step = order[i : i + batch], step + 1
                _, g = self.gradients(x[some], y[some])
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                for k, q in g.items():
                    q = q * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] += 0.1 * (q - m[k])
                    v[k] += 0.01 * (q * q - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            rate *= 0.8 ** (epochs / passes)
        return self

    def predict(self, texts: list[str | None]) -> list[list]:
        """Language and probability of each text; und and 0 for a null text or one without letters."""
        k = len(self.languages)
        if not k:
            return [["und"] * len(texts), [0.0] * len(texts)]
        total, count = np.zeros((len(texts), k)), np.zeros(len(texts))
        has = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        rows, owner = [], []

        def flush() -> None:
            x, o = np.concatenate(rows), np.concatenate(owner)
            for i in range(0, len(x), BATCH):
                part, who = x[i : i + BATCH], o[i : i + BATCH]
                logits = self.logits(part)
                logits -= logits.max(axis=2, keepdims=True)
                logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
                real = (part.T > 0)[..., None]
                np.add.at(total, who, (logits * real).sum(0))
                np.add.at(count, who, real.sum((0, 2)))
            rows.clear()
            owner.clear()

        held = 0
        for i, t in enumerate(texts):
            if has[i]:
                w = windows(t)
                rows.append(w)
                owner.append(np.full(len(w), i))
                held += len(w)
                if held >= 8 * BATCH:
                    flush()
                    held = 0
        if rows:
            flush()
        # the mean over positions, sharpened: neighbouring positions say much the same
        mean = total / np.maximum(count, 1)[:, None] * np.minimum(8, np.maximum(count, 1))[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(1)
        return [[self.languages[b] if h else "und" for b, h in zip(best.tolist(), has, strict=True)], [float(p[i, b]) if h else 0.0 for i, (b, h) in enumerate(zip(best.tolist(), has, strict=True))]]


def sample(docs: DataFrame, label: str = "lang", rows: int = SAMPLE_ROWS, per_row: int = SAMPLE_WINDOWS, size: int = WINDOW) -> list[tuple]:
    """(windows as bytes, label): of each label, per_row windows from all over each of about rows distinct texts.

    The texts are those of the lowest hashes, chosen for each label by itself and after repeats are gone, so that
    neither copies nor another label's rows take a label's place. Only windows come to the driver.
    """
    labelled = docs.where(F.col(label).isNotNull() & (F.octet_length("text") > 0)).select("text", F.col(label).cast("string").alias("y"))
    h = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 40)).alias("h")
    counts = {r[0]: r[1] for r in labelled.select("y", h).groupBy("y").agg(F.approx_count_distinct("h", 0.02)).collect()}  # a row per label
    if not counts:
        return []
    most = F.element_at(F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * rows / max(1, c))))]), F.col("y"))
    low = labelled.select("y", h).where(F.col("h") < F.lit(1 << 40) * most).distinct()
    chosen = low.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("k") <= rows).select("y", "h")
    found = labelled.withColumn("h", h).where(F.col("h") < F.lit(1 << 40) * most).join(F.broadcast(chosen), ["y", "h"])  # rows of each label at most

    def cut(batches):
        for batch in batches:
            out = []
            for text, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = windows(text, size)
                pick = np.random.default_rng(n).permutation(len(w))[:per_row]
                out.append((y, n, w[np.sort(pick)].tobytes()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["y", "h", "w"])

    got = found.select("text", "y", "h").mapInArrow(cut, "y string, h bigint, w binary").distinct().orderBy("y", "h", "w").collect()
    return [(r["w"], r["y"]) for r in got]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, per_row: int = SAMPLE_WINDOWS, epochs: int = EPOCHS) -> Network:
    """A network fitted to docs (text, lang): about rows distinct texts of each language, per_row windows of each.
    A language with fewer windows than another has its own repeated, so that each is learnt as much."""
    by: dict[str, list[np.ndarray]] = {}
    for raw, lang in sample(docs, "lang", rows, per_row):
        by.setdefault(lang, []).append(np.frombuffer(raw, np.uint8).reshape(-1, WINDOW))
    if not by:
        return Network([])
    languages = sorted(by)
    found = [np.concatenate(by[x]) for x in languages]
    most = max(map(len, found))
    x = np.concatenate([f[np.arange(most) % len(f)] for f in found])
    return Network(languages).fit(x, np.repeat(np.arange(len(languages)), most), epochs)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """docs with lang_pred and score, from whole texts. Columns of docs with these names are replaced.

    Null texts and texts without letters (empty ones too) are und with score 0; repeated rows each get their answer.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights
    return append_columns(docs, FIELDS, lambda: sent.value.predict)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs (doc_id, text, lang); learnt from rows that aren't held out, of which
    repeats count once. Other columns don't matter, whatever their names; without labelled texts all is und."""
    own = docs.select("doc_id", "text", "lang")
    network = train(own.where(~held_out()))
    return identify(own.select("doc_id", "text", held_out().alias("held_out")), network).select("doc_id", "held_out", "lang_pred", "score")
