"""Two nearest descriptors by blocks against all pairs."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolake.operators import matching, nearest

SCHEMA = "k bigint, camera int, desc_id bigint, d array<float>, x double, y double"


def descriptors(seed, shape):
    """Clusters, a hot vector, ties and lone vectors in two views of some frames."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for k, n in shape.items():
        centers = rng.normal(size=(6, 8)) * 5
        for camera in (0, 1):
            for i in range(n):
                v = centers[rng.integers(6)] + rng.normal(size=8) * (0.3 if rng.random() < 0.9 else 4)
                v = np.round(v, 1) if i % 3 == 0 else v
                v = centers[0] if i % 5 == 0 else v
                rows.append((k, camera, at, [float(x) for x in v.astype(np.float32)], float(at), float(-at)))
                at += 1
    return rows


def by_hand(rows, ratio, least):
    out = []
    frames = collections.defaultdict(lambda: ([], []))
    for r in rows:
        if r[3] is not None:
            frames[r[0]][r[1]].append(r)
    for k, (a, b) in frames.items():
        if len(a) < least or len(b) < least:
            continue
        for r in a:
            near = sorted((float(np.sqrt(sum((np.float64(p) - np.float64(q)) ** 2 for p, q in zip(r[3], t[3])))), t[2], t) for t in b)[:2]
            if len(near) > 1 and near[0][0] < ratio * near[1][0]:
                out.append((k, r[2], near[0][1], r[4], r[5], near[0][2][4], near[0][2][5], round(near[0][0], 6)))
    return sorted(out)


@pytest.mark.parametrize("block", [16, 64, 2048])
def test_matches_are_those_of_all_pairs(spark, block):
    rows = descriptors(block, {1: 150, 2: 40, 3: 12, 4: 70})
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r)[:7] + (round(r.dist, 6),) for r in matching.match_descriptors(df, ["k"], 0.9, 20, block).collect())
    assert got == by_hand(rows, 0.9, 20) and len(got) > 20


def test_far_blocks_are_left_out(spark):
    """Well separated clusters: a query meets few blocks, and no task gets more than a chunk."""
    rng = np.random.default_rng(2)
    vectors = [(1, i, [float(x) for x in (np.eye(8)[i % 8] * 100 + rng.normal(size=8))]) for i in range(1600)]
    df = spark.createDataFrame(vectors, "k bigint, id bigint, d array<double>")
    two = nearest.two_nearest(df.where("id % 2 = 0"), df.where("id % 2 = 1 OR id % 16 = 0"), ["k"], 100).collect()
    data = np.array([v[2] for v in vectors])
    targets = [i for i in range(1600) if i % 2 == 1 or i % 16 == 0]
    for r in two:
        far = np.sqrt(((data[targets] - data[r.id]) ** 2).sum(1))
        assert r.dist == pytest.approx(np.sort(far)[r.place - 1], abs=1e-9)
    assert len(two) == 2 * 800
    pivots = df.where("id < 8").select("k", F.col("id").alias("pivot"), F.col("d").alias("p"))
    placed = nearest.place(df, pivots, ["k"], 100)
    blocks = pivots.join(placed.groupBy("k", "pivot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")), ["k", "pivot"])
    asked = df.where("id % 2 = 0").withColumns({"bound": F.lit(10.0), "done": F.col("id") % 8})
    assert nearest.other_blocks(asked, blocks, ["k"], 100).count() == 0


def test_nothing_to_match(spark):
    df = spark.createDataFrame(descriptors(1, {1: 19}), SCHEMA)
    assert matching.match_descriptors(df, ["k"]).count() == matching.match_descriptors(df.limit(0), ["k"]).count() == 0
