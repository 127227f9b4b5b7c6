import hashlib
import re

from tidemill.llm import decontam
from tidemill.llm.queries import op10_decontaminate

SF = "/root/testdata/sf0.01"


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    grams = [(str(i), [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))]) for i, t in items if (w := plain(t))]
    by = {}
    for name, ws in grams:
        for w in ws:
            by.setdefault(w, set()).add(name)
    lengths = {len(w) for w in by}
    out = []
    for doc, text in docs:
        w, hit, names = plain(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in by:
                    hit |= set(range(k, k + n))
                    names |= by[g]
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", ("doc_id", "text")), read("benchmark", ("item_id", "text")))
    got = sorted((tuple(r) for r in op10_decontaminate(spark, SF).collect()), key=str)
    assert got == want
    assert any(r[5] for r in got)


def test_edges_and_both_ways(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "x, Y! z"), (3, "x, Y! z"), (4, f"Before {long.upper()} after"), (5, " ".join(f"w{i}" for i in range(5, 14))), (None, "Àx y"), (6, f"{long} {long}")]
    items = [(10, long), (9, "x y Z"), (9, "x y Z"), (11, None), (12, "..."), (None, "Àx")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'q' AS n_hit", "1 AS extra")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    for most, hashes in ((1 << 20, 0), (0, 1 << 20), (0, 0)):
        out = decontam.contamination(d, b, broadcast_bytes=most, broadcast_hashes=hashes)
        assert "extra" in out.columns and len(out.columns) == len(set(out.columns))
        cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted((tuple(r) for r in out.select(*cols).collect()), key=str) == want
        assert decontam.contamination(d.limit(0), b, broadcast_bytes=most).count() == 0
        assert decontam.contamination(d, b.limit(0), broadcast_bytes=most).where("contaminated").count() == 0


def test_remove_spans():
    assert decontam.remove_spans("Ab, cd; ef gh.", [1, 3]) == "Ab,  gh."
    assert decontam.remove_spans(None, []) is None
