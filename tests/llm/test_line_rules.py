import re
from collections import Counter

from tidemill.llm import line_rules
from tidemill.llm.queries import op9_line_rules

SF = "/root/testdata/sf0.01"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = SPLIT.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if twice[g] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def test_base_counts_match_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_line_rules(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {d: base(t) for d, t in docs.items()}
    assert not any(r.kept and r.base_failed for r in rows)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert sum(r.kept for r in rows if r.doc_id in good) > 0.97 * sum(not r.base_failed for r in rows if r.doc_id in good)


def test_rules(spark):
    prose = "The river ran low that summer and the mill stood still for weeks, so they mended nets. " * 3
    prose = " ".join(f"{w}{i}" for i, w in enumerate(prose.split())) + "."
    cases = [
        (1, prose, True, prose),
        (2, "Home | About | News | Contact\n" + prose, True, prose),
        (3, prose + "\nAll Rights Reserved 2020", True, prose),
        (4, "\n".join(f"word{i}### word{i + 99}*** x{i}%%%" for i in range(20)), False, None),
        (5, None, False, None),
        (6, "", False, None),
        (7, ("one two three four five six seven eight\n") * 6, False, None),
        (8, " ".join(["x"] * 30), False, None),
    ]
    docs = spark.createDataFrame([(c[0], c[1]) for c in cases for _ in range(2)], "doc_id bigint, text string").selectExpr("*", "'a' AS t", "1 AS kept", "2 AS words")
    rows = line_rules.line_quality(docs).collect()
    assert len(rows) == 2 * len(cases)
    by = {r.doc_id: r for r in rows}
    for i, text, kept, clean in cases:
        assert tuple(by[i])[1:7] == base(text), i
        assert (by[i].kept, by[i].kept_text) == (kept, clean), i
    assert line_rules.line_quality(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i % 9001}" for i in range(20_000))
    row = line_rules.line_quality(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert tuple(row)[1:7] == base(text)
