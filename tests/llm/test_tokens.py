import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemill.llm import arrow_tokens, packing
from tidemill.llm.queries import op3_arrow_tokens, op7_packing
from tidemill.llm.token_ids import Encoder, vocabulary

SF = "/root/testdata/sf0.001"
BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def library(path):
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("keep", [3, 400_000])
def test_encoder_matches_the_library(path, keep):
    rng = random.Random(1)
    letters = "<=`_(ab'sT re.,;:!?%#1٣é́Σς   \x1c\x1f\x85 \n\t\r  中ß’İ|~"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [None, "", " " * 40, "x" * 300 + " y.", "<|endoftext|> a", "Word, word. WORD\nThe end"]
    whole = library(path)
    got = []
    for first, bounds, ids in Encoder(path, keep=keep).encode(pa.array(["cut off", *texts]).slice(1), chunk=2000):
        assert first == len(got)
        got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [whole(t) for t in texts]


def test_arrow_query_matches_the_library(spark):
    whole, at, want = library(BYTES), 0, []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = whole(r.text)
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in op3_arrow_tokens(spark, SF).collect()) == want


@pytest.mark.parametrize("bits", [16, 32])
def test_arrow_rows_are_equal_and_mapped(tmp_path, bits):
    uri = f"file://{tmp_path}/a.arrows"
    out = arrow_tokens.Writer(uri, pa.int64(), length=8, rows=2, bits=bits)
    stream = list(range(1, 38))
    out.add(pa.array([5]), np.array([0, 20]), np.array(stream[:20], "<u4"))
    out.add(pa.array([6]), np.array([0, 17]), np.array(stream[20:], "<u4"))
    out.close()
    seq = arrow_tokens.Sequences(uri)
    assert len(seq) == 5
    ids, mask = seq.row(4)
    assert ids.tolist() == [33, 34, 35, 36, 37, 0, 0, 0] and mask.to_pylist() == [True] * 5 + [False] * 3
    assert not ids.flags.owndata
    assert [x for p in seq.tokens(3, 30) for x in p.tolist()] == stream[3:33]
    assert [r for b in seq.documents() for r in zip(*[c.to_pylist() for c in b.columns], strict=True)] == [(5, 0, 20), (6, 20, 17)]


def test_arrow_nulls_repeats_and_empty(spark):
    rows = [(2, "b"), (2, "b"), (1, None), (None, ""), (3, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS start")
    whole, at, want = library(BYTES), 0, []
    for d, t in [(None, ""), (1, None), (2, "b"), (2, "b"), (3, "word " * 30_000)]:
        want.append((d, at, len(whole(t)), crc(whole(t))))
        at += len(whole(t))
    got = arrow_tokens.read(arrow_tokens.write(docs, BYTES, 16, 4)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert arrow_tokens.read(arrow_tokens.write(docs.limit(0), BYTES)).count() == 0


def check_packing(rows, whole, docs, capacity):
    want = []
    for d, t in docs:
        ids = whole(t)
        want += [(d, k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity])) for k in range(0, len(ids), capacity)]
    assert sorted([r[:5] for r in rows], key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r[3] for r in rows) // capacity)


def test_packing_query(spark):
    rows = [tuple(r) for r in op7_packing(spark, SF).collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(rows, library(WORDS), docs, 2048)
    assert used <= least * 1.01 + 1


def test_packing_edges(spark):
    docs = [(1, None), (1, None), (None, "a b c"), (2, "word " * 5000), (3, "x " * 15), (4, "x " * 14)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 AS offset")
    rows = [tuple(r) for r in packing.packed(frame, WORDS, 16).collect()]
    check_packing(rows, library(WORDS), docs, 16)
    assert packing.packed(frame.limit(0), WORDS).count() == 0
    cut = packing.pieces(frame, WORDS, 16, with_ids=True)
    placed = packing.pack(cut.cache(), 16)
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(placed).collect()}
    assert sum(map(len, ids.values())) == sum(r[3] for r in rows) and max(map(len, ids.values())) <= 16


def best(sizes, capacity):
    """The fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)
    least = len(sizes)

    def place(i, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if i == len(sizes):
            least = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return least


def test_reduction_keeps_a_best_packing():
    rng = random.Random(3)
    for _ in range(150):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, left = packing.reduce(counts, 20)
        again = [s for p, n in fixed for s in p * n] + [s for s, n in left.items() for _ in range(n)]
        assert sorted(again) == sorted(sizes)
        assert all(sum(p) <= 20 for p, _ in fixed)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best(rest, 20) if rest else 0) == best(sizes, 20)


def test_best_fit_by_counts_equals_piece_by_piece():
    rng = random.Random(4)
    for _ in range(100):
        sizes = sorted((rng.randrange(1, 31) for _ in range(rng.randrange(1, 60))), reverse=True)
        rooms = []
        for s in sizes:
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(30 - s)
        got = packing.best_fit({s: sizes.count(s) for s in sizes}, 30)
        assert sorted(30 - sum(p) for p, n in got for _ in range(n)) == sorted(rooms)
        assert sorted(s for p, n in got for s in p * n) == sorted(sizes)
