"""Greedy selection in rounds, first-k merges and the quality filter against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolake.operators import matching

SCHEMA = "session long, frame_idx long, quality double"


def greedy(rows, top_n, apart):
    out = []
    for s in sorted({r[0] for r in rows}):
        own, kept = [r for r in rows if r[0] == s], []
        if len(own) <= top_n:
            out += [(s, r[1]) for r in own]
            continue
        for _, f, q in sorted((r for r in own if r[2] is not None), key=lambda r: (-r[2], r[1])):
            if len(kept) < top_n and all(abs(f - k) > apart for k in kept):
                kept.append(f)
        out += [(s, f) for f in kept]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "rounds"), [(50, 1), (300, 3), (4096, 4)])
def test_rounds_give_the_greedy_walk(spark, chunk, rounds):
    """Random, rising (one kept each round and chunk end), tied and repeated qualities; negative frames; a short session."""
    rng = np.random.default_rng(chunk)
    rows = [(1, int(f), float(q)) for f, q in zip(rng.integers(-200, 1500, 300), rng.random(300))]
    rows += [(2, f, f / 500) for f in range(0, 400, 3)] + [(3, int(f), float(q)) for f, q in zip(rng.integers(0, 600, 150), rng.integers(0, 3, 150))]
    rows += [(4, 7, 0.5), (4, 8, 0.4)] + [(5, f, None if f % 2 else 0.3) for f in range(40)]
    got = sorted(map(tuple, matching.diverse_top_n(spark.createDataFrame(rows, SCHEMA), 20, 10, chunk, rounds).collect()))
    assert got == greedy(rows, 20, 10)


def test_first_rows_of_a_key(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k, v in zip(rng.integers(0, 3, 900) ** 2, rng.permutation(900))]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    first = matching.first_k(df, ["k"], [F.desc("v")], 10, salts=4)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()  # tasks bound a key's rows before the shuffle
    got = sorted((r.k, r["rank"], r.v) for r in first.collect())
    assert got == sorted((k, n + 1, v) for k in (0, 1, 4) for n, v in enumerate(sorted((v for q, v in rows if q == k), reverse=True)[:10]))


def test_short_sessions_fail_where_that_is_asked(spark):
    rows = [(1, f, 0.9) for f in range(12)] + [(2, f, 0.25) for f in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert matching.filter_quality(df).count() == 16
    assert matching.filter_quality(df.where("session = 1"), fewest=5).count() == 12
    with pytest.raises(Exception, match="fewer than 5 estimates in session 2"):
        matching.filter_quality(df, fewest=5).collect()
