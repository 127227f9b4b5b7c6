import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemill.llm import simhash
from tidemill.llm.queries import op5_simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    want = sorted(zip([r.doc_id for r in docs], [f"{f:016x}" for f in fps], plain_components(fps, [r.doc_id for r in docs]), strict=True))
    assert sorted(tuple(r) for r in op5_simhash(spark, SF).collect()) == want


def test_links_for_each_number_of_segments_and_hot_buckets(spark, monkeypatch):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(14):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    unique = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, first bigint").cache()
    want = plain_components(fps, list(range(len(fps))))
    for n in (10, 1 << 21, 1 << 27):
        for hot in (2000, 3):
            edges = simhash.links(unique, n, 4, hot).collect()
            root = {i: i for i in signed}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[find(a)] = find(b)
            groups, expect = {}, {}
            for i, f in enumerate(signed):
                groups.setdefault(find(f), set()).add(i)
                expect.setdefault(want[i], set()).add(i)
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_stars_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    found = dict(tuple(r) for r in simhash.stars(edges).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, 1), (3, text, 1), (None, text, 2), (2, None, 3), (1, "", 4), (9, "word " * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int").withColumn("component_id", F.lit("x"))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, 3), (3, 3), (None, 3), (2, 1), (1, 1), (9, 9)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.where("doc_id is null")).first().component_id is None
