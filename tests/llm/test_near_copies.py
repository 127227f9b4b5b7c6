import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import near_copies, shared

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = text.encode().lower().split() if text else []
    k = min(5, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_kept(rows):
    """Rows (doc_id, text) that stay by all pairs."""
    found = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        k, group = (d is None, d or 0), find(i)
        best[group] = min(best.get(group, (k, t)), (k, t), key=lambda x: x[0])
    return sorted((k[1] if not k[0] else None for k, _ in best.values()), key=str)


def test_stage_keeps_what_all_pairs_keep(spark):
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=str) == plain_kept(rows)


def test_families_of_near_copies_at_the_edge(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 90))]
        for _ in range(14):
            mine = list(text)
            for _ in range(rng.randrange(4)):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine[: len(mine) - rng.randrange(3)])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id for r in near_copies.kept(docs).collect()), key=str) == plain_kept(rows)


def test_ids_repeated_or_missing(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "thirteen fourteen fifteen sixteen")
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, a), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS row", "'x' AS digest")
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (2, None)], key=str)
    assert near_copies.kept(docs.limit(0)).count() == 0


def test_parities_never_drop_a_similar_pair():
    rng = np.random.default_rng(5)
    passed = dict.fromkeys((True, False), 0)
    for n in (1, 3, 40, 127, 128, 129, 700, 5000):
        for _ in range(60):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            take = int(len(a) * rng.uniform(0.4, 1.0))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[:take]], rng.integers(-(2**63), 2**63 - 1, rng.integers(0, n // 4 + 1)))))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            alike = 5 * both >= 4 * (len(a) + len(b) - both)
            found = near_copies.may_be_alike(near_copies.parities(a), len(a), near_copies.parities(b), len(b))
            assert found == near_copies.may_be_alike(near_copies.parities(b), len(b), near_copies.parities(a), len(a))
            assert found or not alike
            passed[found] += 1
    assert min(passed.values()) > 50


def test_simhash_proposes_and_prefixes_add_the_rest(spark):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(6)]
    rows = []
    for t in texts:
        rows += [t, [*t[:-1], "x"], ["y", *t[1:]], [*t[:-40], *[f"z{i}" for i in range(9)]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id bigint, text string")
    found = near_copies.sets(docs).cache()
    print_of = {r.id: r.fp for r in found.collect()}
    for r in found.collect():
        h = near_copies.shingles(" ".join(rows[r.doc_id]))
        assert r.fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in h) > len(h))
    near = {(a, b) for a in print_of for b in print_of if a < b and ((print_of[a] ^ print_of[b]) & (2**64 - 1)).bit_count() <= near_copies.BITS}
    got = {(r.a, r.b) for r in near_copies.proposed(found).collect()}
    assert got <= near and len(near) >= 6
    rootless = near_copies.components(found.withColumn("prefix", F.expr("cast(array() AS array<bigint>)")), docs)
    least = {i: i for i in print_of}
    for _ in print_of:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    # without prefixes, what SimHash finds is linked, and nothing else
    assert {(r.node, r.root) for r in rootless.collect()} == {(i, r) for i, r in least.items() if i != r}
    assert near_copies.components(found, docs).count() == 18


def test_sketches_never_drop_a_similar_pair():
    rng = np.random.default_rng(6)
    passed = dict.fromkeys((True, False), 0)
    for n in (2, 30, 146, 400, 3000):
        for _ in range(60):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[: int(len(a) * rng.uniform(0.4, 1.0)) + 1]], rng.integers(-(2**63), 2**63 - 1, rng.integers(0, n // 4 + 1)))))
            both = len(np.intersect1d(a, b))
            x, y = (near_copies.sketch(near_copies.parities(s)) for s in (a, b))
            found = 9 * sum(((i ^ j) & (2**64 - 1)).bit_count() for i, j in zip(x, y, strict=True)) <= len(a) + len(b)
            assert len(x) == near_copies.SKETCH and (found or 5 * both < 4 * (len(a) + len(b) - both))
            passed[found] += 1
    assert min(passed.values()) > 50


def test_a_group_of_half_alike_texts_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        mine = list(base)
        for at in rng.sample(range(150), 7):  # about 0.5 to 0.7 alike, near copies nowhere or nearly so
            mine[at] = f"x{i}-{at}"
        rows.append((i, " ".join(mine)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: sizes.append(pairs.distinct().count()) or verified(pairs, *more))
    assert sorted((r.doc_id for r in near_copies.kept(docs).collect()), key=str) == plain_kept(rows)
    assert len(sizes) == 2 and sizes[1] < 250 * 249 / 2 / 20


def test_stage_leaves_no_tables_but_what_it_drops(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, None), (None, "x"), (None, "x"), (None, "y")], "doc_id bigint, text string")
    out = dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, SF)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["near-dropped"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d e f"), (2, None), (None, "x"), (None, "y")], key=str)


def test_left_out_is_an_anti_join_with_or_without_its_filter(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("nullif(id, 7) AS doc_id", "concat('d', id % 50) AS digest", "id")
    out = docs.where("id % 9 = 0 OR id = 7").select("doc_id", "digest")
    for most in (near_copies.FILTER_ROWS, 10):
        monkeypatch.setattr(near_copies, "FILTER_ROWS", most)
        assert sorted(r.id for r in near_copies.left_out(docs, out).collect()) == [i for i in range(4000) if i % 9 and i != 7]
        assert near_copies.left_out(docs, out.limit(0)).count() == 4000


def test_prefixes_of_cells_share_one_cell_of_every_similar_pair():
    rng = np.random.default_rng(7)
    for n in (4, 5, 9, 63, 64, 100, 127, 128, 130, 159, 161, 255, 256, 319, 700, 1023, 1024, 1100):
        for _ in range(25):
            pool = np.unique(rng.integers(-(2**63), 2**63 - 1, 2 * n + 4))
            ranks = np.where(rng.random(len(pool)) < rng.choice((0, 0.5, 1)), np.arange(len(pool)), -1)
            size = rng.integers(n, n * 5 // 4 + 1)
            most = near_copies.most_unlike(n, size)
            gone = max(0, most - (size - n)) // 2  # as unlike as they may be, at random or all in one stretch
            mixed = rng.permutation(len(pool)) if rng.random() < 0.7 else np.arange(len(pool))
            a, b = np.sort(mixed[:n]), np.sort(mixed[gone : gone + size])
            both = len(np.intersect1d(a, b))
            assert 5 * both >= 4 * (n + size - both)
            x, y = (near_copies.prefix(pool[i], ranks[i]) for i in (a, b))
            assert np.array_equal(a, b) or len(np.intersect1d(x, y))


def test_long_texts_with_a_few_common_passages_make_few_pairs(spark, monkeypatch):
    rng = random.Random(10)
    passages = [" ".join(f"p{i}-{j}" for j in range(60)) for i in range(150)]
    rows = [(i, " ".join(rng.sample(passages, 20))) for i in range(200)]  # most pairs share some, none is a near copy
    rows.append((200, rows[0][1] + " one more word"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: sizes.append(pairs.count()) or verified(pairs, *more))
    assert sorted(r.doc_id for r in near_copies.kept(docs).collect()) == list(range(200))
    assert sizes[1] < 200
