"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of hashed vectors of the word, its beginnings and its end. Filters of several widths
slide over the words of the whole text, each keeps its maximum, and a linear layer gives the logit. The network is
trained in numpy on the driver from a bounded sample of labelled rows, whole texts. Each language has a threshold of
its own, found from the logits of all labelled rows that weren't fitted; the language is guessed from the text alone.
Scores are shifted so that every threshold is 0.7.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang_gru import held_out
from .shared import append_columns, staged

#: Hashed vectors, their size; filters of each width; widths in words.
BUCKETS, VECTOR, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
#: Labelled rows of each class that the network is fitted to at most; passes and steps at least.
SAMPLE_ROWS, EPOCHS, STEPS = 1500, 6, 400
#: A hashed vector is learnt if so many sampled texts have it; score from which a text is called toxic.
LEAST_TEXTS, THRESHOLD = 5, 0.7
#: Logits are counted in bins of this width, up to this size, for the thresholds; rows of a label that a language's own threshold needs.
BIN, SPAN, LEAST_ROWS = 0.05, 60.0, 10
#: Pull of the vectors to zero, so that what tells nothing stays small.
DECAY = 3e-4

WORD = re.compile(r"[^\W\d_]+")
FIELDS = [("logit", T.DoubleType()), ("guess", T.StringType())]


def features(word: str) -> list[int]:
    """Hashed numbers (from 1) of a word: itself, its first 3, 4 and 5 letters and its last 3."""
    return [1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in (word, "<" + word[:3], "<" + word[:4], "<" + word[:5], word[-3:] + ">")]


class Lexicon:
    """Distinct words of a batch, numbered from 1, and texts as runs of numbers, each closed by zeros.

    bounds holds each text's start and the end of the positions where its windows may start; zeros beyond keep
    the next text out of them.
    """

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        get, flat, self.bounds, spare = number.setdefault, [], [], [0] * (max(WIDTHS) - 1)
        for t in texts:
            self.bounds.append(len(flat))
            flat += [get(w, len(number) + 1) for w in WORD.findall(t.lower())] if t else []
            self.bounds.append(len(flat) + len(spare))
            flat += spare + spare
        self.ids = np.array(flat + [0], np.int64)
        self.words = list(number)

    def hashed(self) -> np.ndarray:
        return np.array([[0] * 5, *map(features, self.words)], np.int64)


class Classifier:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.alive = np.zeros(BUCKETS, bool)
        self.w = {"vectors": draw(BUCKETS, VECTOR) / 10, "out": draw(FILTERS * len(WIDTHS)), "bias": np.zeros(FILTERS * len(WIDTHS), np.float32), "base": np.zeros(1, np.float32)}
        self.w |= {f"f{k}": draw(k, VECTOR, FILTERS) for k in WIDTHS}
        self.languages: list[str] = []
        self.profiles = np.zeros((BUCKETS, 0), np.float32)
        self.priors = np.zeros(0, np.float32)

    def _maps(self, ids: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Each filter at each position; words holds the vectors of the numbers in ids."""
        n, out = len(ids), []
        for k in WIDTHS:
            made = [words @ self.w[f"f{k}"][o] for o in range(k)]
            m = made[0][ids]
            for o in range(1, k):
                m[: n - o] += made[o][ids[o:]]
            out.append(m)
        return np.concatenate(out, axis=1)

    def logits(self, lex: Lexicon, hashed: np.ndarray) -> np.ndarray:
        maps = self._maps(lex.ids, self.w["vectors"][hashed].sum(1))
        top = np.maximum.reduceat(maps, lex.bounds, axis=0)[::2]
        return np.maximum(top + self.w["bias"], 0) @ self.w["out"] + self.w["base"][0]

    def guess(self, lex: Lexicon, hashed: np.ndarray) -> list[str | None]:
        """The likeliest language of each text, by its words alone; None where no language was learnt."""
        if not self.languages:
            return [None] * (len(lex.bounds) // 2)
        known = self.profiles[hashed[:, 0]]
        known[0] = 0
        total = np.add.reduceat(known[lex.ids], lex.bounds, axis=0)[::2] + self.priors
        return [self.languages[i] for i in total.argmax(1).tolist()]

    def judge(self, texts: list[str | None]) -> list[list]:
        """Logits and guessed languages; a null, empty or wordless text has the logit of no words at all."""
        if not texts:
            return [[], []]
        lex = Lexicon(texts)
        hashed = lex.hashed()
        return [self.logits(lex, hashed).astype(float).tolist(), self.guess(lex, hashed)]

    def fit(self, rows: list[tuple[str | None, str | None, int]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Classifier:
        """To (text, lang, label) rows."""
        y = np.array([r[2] for r in rows], np.float32)
        if len(rows) == 0 or y.min() == y.max():
            self.w["base"][:] = -4.0 if len(rows) == 0 or y.max() == 0 else 4.0
            self.w["out"][:] = 0
            return self
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        lexicons = [Lexicon([r[0]]) for r in rows]
        table: dict[str, list[int]] = {}
        hashed = [np.array([[0] * 5, *[table.get(w) or table.setdefault(w, features(w)) for w in x.words]], np.int64) for x in lexicons]
        texts_with = np.zeros(BUCKETS, np.int64)
        for h in hashed:
            texts_with[np.unique(h)] += 1
        self.alive = texts_with >= LEAST_TEXTS
        self.alive[0] = False
        self.w["vectors"] *= self.alive[:, None]
        self._profile(rows, lexicons, hashed)
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(max(epochs, -(-STEPS * batch // len(rows)))):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                some, step = order[i : i + batch], step + 1
                g = self._gradients([lexicons[k] for k in some], [hashed[k] for k in some], y[some], weight[some])
                g["vectors"] *= self.alive[:, None]
                g["vectors"] += DECAY * self.w["vectors"]
                for k, q in g.items():
                    m[k] += 0.1 * (q - m[k])
                    v[k] += 0.01 * (q * q - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def _gradients(self, lexicons: list[Lexicon], hashed: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        g = {k: np.zeros_like(w) for k, w in self.w.items()}
        for lex, h, label, wt in zip(lexicons, hashed, y, weight, strict=True):
            words = self.w["vectors"][h].sum(1)
            maps = self._maps(lex.ids, words)
            at = maps.argmax(0)
            top = maps[at, np.arange(maps.shape[1])] + self.w["bias"]
            kept = np.maximum(top, 0)
            z = float(kept @ self.w["out"] + self.w["base"][0])
            d = np.float32((1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) * wt / len(y))
            g["out"] += d * kept
            g["base"] += d
            dtop = d * self.w["out"] * (top > 0)
            g["bias"] += dtop
            dwords = np.zeros_like(words)
            for j, k in enumerate(WIDTHS):
                for f in range(FILTERS):
                    c = j * FILTERS + f
                    if dtop[c]:
                        ids = lex.ids[at[c] : at[c] + k]
                        g[f"f{k}"][: len(ids), :, f] += dtop[c] * words[ids]
                        np.add.at(dwords, ids, dtop[c] * self.w[f"f{k}"][: len(ids), :, f])
            hit = np.flatnonzero(dwords.any(1))
            for column in h[hit].T:
                np.add.at(g["vectors"], column, dwords[hit])
        return g

    def _profile(self, rows: list[tuple], lexicons: list[Lexicon], hashed: list[np.ndarray]) -> None:
        """Log-likelihoods of words by language, for the guess."""
        self.languages = sorted({r[1] for r in rows if r[1] is not None})
        counts = np.ones((BUCKETS, len(self.languages)))
        for r, lex, h in zip(rows, lexicons, hashed, strict=True):
            if r[1] is not None:
                np.add.at(counts[:, self.languages.index(r[1])], h[lex.ids, 0], 1)
        known = counts.sum(1) > len(self.languages)
        self.profiles = (np.log(counts / counts.sum(0)) * known[:, None]).astype(np.float32)
        shares = np.array([1 + sum(r[1] == x for r in rows) for x in self.languages], np.float64)
        self.priors = np.log(shares / shares.sum()).astype(np.float32) if len(shares) else np.zeros(0, np.float32)

def best_cut(clean: dict[int, float], toxic: dict[int, float]) -> float:
    """Of the logits counted by bins: the cut with the best F1, amid its gap."""
    bins = sorted({*clean, *toxic})
    right, called = sum(toxic.values()), sum(toxic.values()) + sum(clean.values())
    whole, best, cut = right, -1.0, 0.0
    for k, b in enumerate(bins):  # all from bin b on are called toxic
        f1 = 2 * right / (whole + called)
        if f1 > best:
            best, cut = f1, (bins[k - 1] + 1 + b) / 2 if k else b - 1 / BIN
        right -= toxic.get(b, 0)
        called -= toxic.get(b, 0) + clean.get(b, 0)
    return cut * BIN


def calibrate(judged: DataFrame, labels: DataFrame) -> dict[str | None, float]:
    """The cut of each guessed language, and of all (at None), from judged (doc_id, logit, guess) and labels.

    All labelled rows count but those that were fitted; as these are a larger part of the rarer label, what is left of
    each label is weighted to the label's whole share. Only counts by language, label and bin come to the driver.
    """
    given = _given(labels).withColumn("fitted", _fitted(labels))
    bin_ = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("logit"))) / BIN).cast("int")
    rows = judged.join(given, "doc_id").groupBy("guess", "y", "fitted", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = [tuple(r) for r in rows.collect()]  # languages x labels x bins at most
    whole = [sum(r[4] for r in found if r[1] == y) for y in (0, 1)]
    free = [sum(r[4] for r in found if r[1] == y and not r[2]) for y in (0, 1)]
    if not all(free):
        found, free = [(g, y, False, b, n) for g, y, _, b, n in found], whole
    if not all(free):
        return {None: 0.0}
    counts: dict[str | None, list[dict[int, float]]] = {}
    for guess, y, fitted, b, n in found:
        for key in {guess, None} if not fitted else ():
            side = counts.setdefault(key, [{}, {}])[y]
            side[b] = side.get(b, 0) + n
    weighted = {k: [{b: n * whole[y] / free[y] for b, n in side.items()} for y, side in enumerate(v)] for k, v in counts.items()}
    return {k: best_cut(*weighted[k]) for k, v in counts.items() if k is None or min(sum(side.values()) for side in v) >= LEAST_ROWS}


def _given(labels: DataFrame) -> DataFrame:
    """doc_id and y of labels, each pair once."""
    return labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic").cast("int") != 0).cast("int").alias("y")).distinct()


def _hash():
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))


def _fitted(labels: DataFrame, per: int = SAMPLE_ROWS):
    """Whether a labelled row is fitted: four fifths of those with the lowest hashes of their ids, about per of each label."""
    counts = {r[0]: r[1] for r in _given(labels).groupBy("y").count().collect()}  # two rows
    part = F.when(F.col("y") == 1, F.lit(min(1.0, per / counts.get(1, 1)))).otherwise(F.lit(min(1.0, per / counts.get(0, 1))))
    return (_hash() < F.lit(1 << 40) * part) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) > 0)


def sample(docs: DataFrame, labels: DataFrame, per: int = SAMPLE_ROWS) -> list[tuple]:
    """(text, lang, label) of the rows that are fitted, whole texts; of rows with one id, that of the least text hash."""
    chosen = _given(labels).where(_fitted(labels, per)).withColumn("h", _hash())
    one = F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("d")
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "y").agg(one).orderBy("h", "doc_id", "y").collect()
    return [(r["d"]["text"], r["d"]["lang"], r["y"]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, per: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Classifier:
    """A classifier fitted to labels (doc_id, toxic) of docs (doc_id, text, lang); lang only teaches the guess."""
    return Classifier().fit(sample(docs.select("doc_id", "text", "lang"), labels, per), epochs)


def judge(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs with logit and guess, from whole texts. Columns of docs with these names are replaced.

    Null, empty and wordless texts get the logit of no words; repeated rows each get their answer.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # some MB, whatever the input
    return append_columns(docs, FIELDS, lambda: sent.value.judge)


def decide(judged: DataFrame, cuts: dict[str | None, float]) -> DataFrame:
    """judged with score and predicted in place of logit and guess."""
    own = {k: v for k, v in cuts.items() if k is not None}
    cut = F.lit(cuts.get(None, 0.0))
    if own:
        cut = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("guess")), cut)
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("logit") - cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))))
    kept = judged.drop("score", "predicted").withColumn("score", 1 / (1 + F.exp(-z)))
    return kept.withColumn("predicted", (F.col("logit") >= cut).cast("int")).withColumn("score", F.when(F.col("predicted") == 1, F.greatest("score", F.lit(THRESHOLD))).otherwise(F.least("score", F.lit(float(np.nextafter(THRESHOLD, 0)))))).drop("logit", "guess")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang and any others) with score and predicted: trained on labels, judged once, with cuts from
    all labelled rows. Columns of docs with the names score, predicted, logit and guess are replaced."""
    judged = staged(judge(docs, train(docs, labels)), "judged")
    return decide(judged, calibrate(judged.select("doc_id", "logit", "guess"), labels))


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of docs; learnt from labels of rows that aren't held out.

    Without labels, or with one label only, all rows have one verdict. Labels of unknown, null or repeated ids don't
    matter; an id with both labels counts as each. Without rows: no rows.
    """
    kept = labels.where(~held_out("doc_id", 3, 1))
    own = docs.select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    classifier = train(own, kept)
    judged = staged(judge(own.select("doc_id", "text", "held_out"), classifier).drop("text"), "judged")
    return decide(judged, calibrate(judged, kept)).select("doc_id", "held_out", "score", "predicted")
