import zlib

import numpy as np

from tidemill.llm import lang_gru
from tidemill.llm.queries import op6_language

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = lang_gru.Network(["a", "b", "c"], states=3, vector=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.integers(0, 256, (4, 6)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for k, w in net.w.items():
        i = (int(x[1, 3]), 1) if k == "vectors" else tuple(int(rng.integers(0, s)) for s in w.shape)
        was, e, loss = w[i], 1e-3, []
        for d in (e, -e):
            w[i] = was + d
            loss.append(net.gradients(x, y)[0])
        w[i] = was
        assert abs((loss[0] - loss[1]) / 2 / e - g[k][i]) < 1e-4, k


def test_probabilities_match_brute_force():
    """Position by position, one window at a time."""
    net = lang_gru.Network(["a", "b", "c"], seed=4)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(x, d):
        n = lang_gru.STATES
        h, out = np.zeros(n), {}
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = net.w["vectors"][x[t]] @ net.w[d + "in"] + net.w[d + "bias"]
            r = h @ net.w[d + "rec"]
            update, reset = sig(a[:n] + r[:n]), sig(a[n : 2 * n] + r[n : 2 * n])
            h = update * h + (1 - update) * np.tanh(a[2 * n :] + reset * r[2 * n :])
            out[t] = h
        return out

    texts = ["a", "Two words", "é" * 50, "x y " * 90]
    for text, lang, score in zip(texts, *net.predict(texts), strict=True):
        total, count = np.zeros(3), 0
        for w in lang_gru.windows(text):
            f, b = states(w, "f"), states(w, "b")
            for t in range(len(w)):
                if w[t]:
                    z = np.concatenate([f[t], b[t]]) @ net.w["out"] + net.w["bias"]
                    total += z - np.log(np.exp(z).sum())
                    count += 1
        p = np.exp(total / count * min(8, count))
        p /= p.sum()
        assert lang == net.languages[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_every_language_is_learnt_whatever_repeats(spark):
    french = "le chien et la maison sont dans la grande rue de la ville"
    english = [f"the river {a} ran to the {b} and the men were there" for a in range(50) for b in "abcdefghij"]
    rows = [(i, french, "fr") for i in range(2000)] + [(2000 + i, t, "en") for i, t in enumerate(english * 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {y for _, y in lang_gru.sample(docs)} == {"en", "fr"}
    got = lang_gru.predicted(docs)
    wrong = got.join(docs.select("doc_id", "lang"), "doc_id").where("lang <> lang_pred").count()
    assert wrong < 0.01 * len(rows)


def test_windows_come_from_whole_texts(spark):
    docs = spark.createDataFrame([("a" * 64 * 500 + "b" * 64 * 500, "x")], "text string, lang string")
    raw = lang_gru.sample(docs, per_row=200)[0][0]
    assert 30 < raw.count(b"b" * 64) < 170


def test_held_out_accuracy(spark):
    rows = op6_language(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.95 * len(held)


def test_edges(spark):
    rows = [(i, t, g) for i in range(8) for t, g in [("the river ran to the mill and the men were there", "en"), ("der Fluss und die Mühle und das Haus sind nicht weit", "de")]]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 -- 4", None), (103, "das Haus und die Mühle " * 5000, None), (104, "the mill", None), (104, "the mill", None), (None, "und die", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS score", "'x' AS lang_pred")
    got = lang_gru.predicted(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[103][0] == "de" and by[104][0] == "en"
    assert lang_gru.predicted(docs.limit(0)).count() == 0
    none = lang_gru.predicted(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null"))
    assert none.count() == 0 or {r.lang_pred for r in none.collect()} <= {"und"}
