import random

import pytest

from tidemill.llm import chat
from tidemill.llm.queries import op1_chat

SF = "/root/testdata/sf0.01"


def brute(rows, part_turns=1000):
    def key(x):
        return tuple((v is not None, v if v is not None else "") for v in x)

    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    talks = {c: [(r, x) for t, r, x in sorted(v, key=lambda q: (key(q[:1]), key(q[1:])))] for c, v in by.items()}
    out = []
    for c, v in talks.items():
        same = [k for k, w in talks.items() if w == v]
        if any(len(w) > len(v) and w[: len(v)] == v for w in talks.values()):
            continue
        if c != min((k for k in same if k is not None), default=None):
            continue
        for p in range(0, len(v), part_turns):
            out.append((c, len(v), len(same), p // part_turns, "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v[p : p + part_turns])))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op1_chat(spark, SF).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_snapshots_in_many_tasks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        base = random.Random(c % 7)
        n = rng.choice([1, 2, 3, 5, 300])
        rows += [(c, t, base.choice(["user", "assistant", None]), base.choice(["a", "b", "", None])) for t in range(n)]
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (50, None, "user", "y"), (None, 0, "user", "n"), (None, 1, None, "m")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS pos", "2 AS h1")
        got = sorted((tuple(r) for r in chat.formatted(turns, part_turns=100).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, 100)
    assert chat.formatted(turns.limit(0)).count() == 0
