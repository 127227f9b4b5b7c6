from collections import Counter

from tidemill.llm import licenses
from tidemill.llm.queries import op8_licenses

SF = "/root/testdata/sf0.01"

#: Notices in the synthetic documents.
NOTICES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


def test_query_matches_the_notices(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in op8_licenses(spark, SF).collect()}
    assert got == {d: {n for line, n in NOTICES.items() if line in t} for d, t in docs.items()}
    assert len(Counter(x for v in got.values() for x in v)) == 4


def test_wording_differences_decide():
    scan = licenses.Scanner().scan
    for name, _, text in licenses.TEMPLATES:
        assert scan(f"Some words before it.\n{text}\nAnd a last line of words.")[0] == [name], name
        assert scan(text.upper())[0] == [name]
    assert scan("Licensed under the Apache License, Version 1.1.")[0] == []
    assert scan("Licensed under CC BY-NC-SA 4.0.")[0] == ["CC-BY-NC-SA-4.0"]
    assert scan("A driving licence is needed to drive here.")[0] == []
    assert scan("This work is licensed under the GNU General Public Licence, version 3.")[0] == ["GPL-3.0"]
    wrapped = "\n".join(["# Permission is hereby granted, free of charge, to any person", "# obtaining a copy of this software and associated documentation", '# files (the "Software"), to deal in the Software without', "# restriction, including without limitation the rights to use, copy,", "# modify, merge, publish, distribute, sublicense, and/or sell copies of", "# the Software"])
    assert scan("x\n" + wrapped)[0] == ["MIT"] and scan("x\n" + wrapped)[3] == [1, 7]


def test_edges(spark):
    long = "word " * 30_000 + "Released under the MIT License. " + "word " * 30_000
    rows = [(1, None), (1, None), (2, ""), (3, long), (None, "Released under the MIT License.\n" * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS spans", "'a' AS other")
    got = [(r.doc_id, r.licenses) for r in licenses.scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (1, []), (2, []), (3, ["MIT"]), (None, ["MIT"])], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


MIT = [t for n, _, t in licenses.TEMPLATES if n == "MIT"][-1]
GPL = [t for n, _, t in licenses.TEMPLATES if n == "GPL-3.0-or-later"][0]


def wrapped(text, lines):
    own = text.split()
    size = -(-len(own) // lines)
    return [" ".join(own[i : i + size]) for i in range(0, len(own), size)]


def test_no_notice_is_lost_at_a_block_end_or_by_wrapping():
    scan = licenses.Scanner().scan
    for between in range(12):
        for lines in (1, 4, 9, 31):
            text = "\n".join([*wrapped(MIT, lines), *["some plain words of a line"] * between, *wrapped(GPL, lines)])
            assert sorted(scan(text)[0]) == ["GPL-3.0-or-later", "MIT"], (between, lines)


def test_blocks_follow_the_longest_template():
    own = " ".join(f"term{i}" for i in range(600))
    scan = licenses.Scanner([("OWN", "term599", "This license says " + own)]).scan
    for text in ("This license says " + own, "word " * 3000 + "This license says " + own + " word" * 3000, "\n".join(("a b\nThis license says " + own).split())):
        assert scan(text)[0] == ["OWN"]


def test_query_matches_brute_force(spark):
    """Every template's words against every line, in order and alone; savings and candidates by the lines' words."""
    import zstandard

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op8_licenses(spark, SF).collect()}
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
    for r in rows:
        spans, saved = [], 0
        for i, line in enumerate((r.text or "").split("\n")):
            if not any(" ".join(licenses.words(n)) in " ".join(licenses.words(line)) for n in NOTICES):
                continue
            spans += [i, i + 1]
            raw = " ".join(licenses.words(line)).encode()
            for _, _, t in licenses.TEMPLATES:
                d = zstandard.ZstdCompressionDict(" ".join(licenses.words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                given = zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                saved = max(saved, len(plain.compress(raw)) - len(given.compress(raw)))
        found = got[r.doc_id]
        assert [int(x) for x in found.line_spans.split(",") if x] == spans, r.doc_id
        assert (found.n_candidates, found.best_saving) == (len(spans) // 2, saved), r.doc_id
