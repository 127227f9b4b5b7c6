import random
import zlib

import numpy as np

from tidemill.llm import toxic_cnn
from tidemill.llm.queries import op4_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = op4_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc > 0.97
    assert sum(s >= 0.7 for s in bad) > 0.85 * len(bad) and sum(s >= 0.7 for s in good) < 0.03 * len(good)


def made(n, seed=0):
    """Rows of which the odd ones hold a word of a kind."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randrange(5, 60))]
        if i % 2:
            words[rng.randrange(len(words))] = "zounds" + rng.choice("abc")
        rows.append((" ".join(words), "en" if i % 3 else "fr", i % 2))
    return rows


def test_training_is_repeatable_and_finds_words():
    rows = made(300)
    a, b = toxic_cnn.Classifier().fit(rows[:200]), toxic_cnn.Classifier().fit(rows[:200])
    logits = a.judge([r[0] for r in rows])[0]
    assert logits == b.judge([r[0] for r in rows])[0]
    assert sum((z > 0) == r[2] for z, r in zip(logits[200:], rows[200:], strict=True)) >= 95


def plain_logit(c, text):
    """Word by word and filter by filter."""
    words = [c.w["vectors"][toxic_cnn.features(w)].sum(0) for w in toxic_cnn.WORD.findall((text or "").lower())]
    zero, z = np.zeros(toxic_cnn.VECTOR), float(c.w["base"][0])
    for j, k in enumerate(toxic_cnn.WIDTHS):
        padded = words + [zero] * 4
        for f in range(toxic_cnn.FILTERS):
            top = max(sum(float(padded[i + o] @ c.w[f"f{k}"][o][:, f]) for o in range(k)) for i in range(len(words) + 2))
            z += max(0.0, top + float(c.w["bias"][j * toxic_cnn.FILTERS + f])) * float(c.w["out"][j * toxic_cnn.FILTERS + f])
    return z


def test_scores_match_brute_force():
    rows = made(120)
    c = toxic_cnn.Classifier().fit(rows)
    texts = [r[0] for r in rows[:30]] + [None, "", "12 34", "zoundsa", "a b zoundsb"]
    assert np.allclose(c.judge(texts)[0], [plain_logit(c, t) for t in texts], atol=1e-3)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    c = toxic_cnn.Classifier()
    c.w = {k: rng.standard_normal(v.shape) if k != "vectors" else v.astype(np.float64) * 10 for k, v in c.w.items()}
    texts, y, weight = ["one two three four", "two five six", "seven"], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    lex = [toxic_cnn.Lexicon([t]) for t in texts]
    hashed = [x.hashed() for x in lex]

    def loss():
        z = np.array([plain_logit(c, t) for t in texts])
        return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() / len(y))

    c.w["vectors"][0] = 0
    g = c._gradients(lex, hashed, y, weight)
    g["vectors"][0] = 0  # the spare positions' vector, never learnt
    for k, w in c.w.items():
        i = np.unravel_index(int(np.abs(g[k]).argmax()), w.shape)
        was, e, found = w[i], 1e-5, []
        for d in (e, -e):
            w[i] = was + d
            found.append(loss())
        w[i] = was
        assert abs((found[0] - found[1]) / 2 / e - g[k][i]) < 1e-3 * max(1, abs(g[k][i])), k


def test_thresholds_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(1.5 if i % 7 == 0 else -1.5, 1.0), rng.choice(["en", "fr", "de"]), int(i % 7 == 0)) for i in range(6000)]
    judged = spark.createDataFrame([r[:3] for r in rows] + [(None, 9.0, "en"), (7, 9.0, None)], "doc_id bigint, logit double, guess string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 5] + [(1, None), (None, 1), (10**9, 1)], "doc_id bigint, toxic int").unionByName(spark.createDataFrame([(8, 0)] * 50, "doc_id bigint, toxic int"))
    cuts = toxic_cnn.calibrate(judged, labels)
    assert set(cuts) == {None, "en", "fr", "de"}
    chosen = {r.doc_id for r in toxic_cnn._given(labels).where(~toxic_cnn._fitted(labels)).collect()}
    whole = [sum(r[0] % 5 > 0 and r[3] == y for r in rows) for y in (0, 1)]
    for lang in ("en", "fr", "de"):
        mine = [(z, y) for i, z, g, y in rows if g == lang and i in chosen]
        free = [sum(i in chosen and y == k for i, _, _, y in rows) for k in (0, 1)]

        def f1(cut, mine=mine, free=free):
            hit = sum(z >= cut and y for z, y in mine) * whole[1] / free[1]
            false = sum(z >= cut and not y for z, y in mine) * whole[0] / free[0]
            return 2 * hit / (sum(y for _, y in mine) * whole[1] / free[1] + hit + false)

        assert f1(cuts[lang]) > max(f1(b * toxic_cnn.BIN) for b in range(-100, 100)) - 1e-3
    assert toxic_cnn.calibrate(judged, labels.limit(0)) == {None: 0.0}


def test_edges(spark):
    rows = [(i, ("bad words here" if i % 2 else "good words there") + f" x{i}", "en") for i in range(60)]
    rows += [(100, None, None), (101, "", "en"), (102, "bad " * 40_000, "en"), (103, "12", "en"), (None, "bad", "en"), (5, "bad words here x5", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS score", "'x' AS y", "2 AS h")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    got = toxic_cnn.predicted(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].score == by[101].score == by[103].score
    assert by[1].predicted == 1 and by[2].predicted == 0 and by[102].predicted == 1
    assert toxic_cnn.predicted(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxic_cnn.predicted(docs, labels.limit(0)).collect()} == {0}
