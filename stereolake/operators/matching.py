"""Feature correspondences between two views and robust epipolar estimates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.tables import cut
from . import nearest

PAIR = ["session", "frame_idx"]


def match_descriptors(descriptors: DataFrame, key: list[str], ratio: float = 0.72, least: int = 20, block: int = 2048) -> DataFrame:
    """Nearest descriptor of the other view where it is clearly nearer than the second; none where a view has under `least`.

    Exact, by `nearest.two_nearest`: tasks hold blocks of at most `block` descriptors whatever a frame's share of all. Equal
    descriptors of a view are asked for once, and two of them stand for all as targets. Descriptor ids are unique in a frame.
    """
    counts = descriptors.groupBy(*key).agg(*[F.count_if(F.col("camera") == k).alias(f"n{k}") for k in (0, 1)]).where(f"n0 >= {least} AND n1 >= {least}").select(*key)
    rows = descriptors.join(counts, key, "left_semi")
    asked, given = rows.where("camera = 0"), rows.where("camera = 1")
    vectors = asked.groupBy(*key, "d").agg(F.min("desc_id").alias("id"))
    targets = given.select(*key, F.col("desc_id").alias("id"), "d").withColumn("copy", F.row_number().over(Window.partitionBy(*key, "d").orderBy("id"))).where("copy <= 2").drop("copy")
    two = nearest.two_nearest(vectors.select(*key, "id", "d"), targets, key, block)
    best = two.groupBy(*key, "id").agg(F.max(F.when(F.col("place") == 1, F.struct(F.col("target").alias("id1"), "dist"))).alias("m"), F.max(F.when(F.col("place") == 2, F.col("dist"))).alias("second"))
    best = best.where(F.col("m.dist") < ratio * F.col("second")).select(*key, "id", "m.*")
    ends = given.select(*key, F.col("desc_id").alias("id1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    starts = asked.select(*key, "d", F.col("desc_id").alias("id0"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    clear = best.join(vectors, [*key, "id"]).drop("id").join(ends, [*key, "id1"])
    return starts.join(clear, [*key, "d"]).select(*key, "id0", "id1", "x0", "y0", "x1", "y1", "dist")


def first_k(rows: DataFrame, by: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each key by the order, with their rank from 1: merged in three steps, none of which sorts a whole key.

    Each task keeps k rows of each key before anything is shuffled (Spark's window group limit, for k up to 1000), a key's
    rows are merged by salt, and one task sees at most salts * k of them. Rows that the order doesn't tell apart are chosen
    at will.
    """
    salt = F.pmod(F.xxhash64(*[F.struct(*rows.columns)]), F.lit(salts)).alias("_salt")
    some = rows.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def grid_cap(matches: DataFrame, key: list[str], order: str, width: int, height: int, rows: int = 4, cols: int = 4, cap: int = 30) -> DataFrame:
    """The first `cap` matches of each image cell, in match order; cells at the far border take what lies beyond."""
    col = F.least((F.col("x0") / (width / cols)).cast("int"), F.lit(cols - 1))
    row = F.least((F.col("y0") / (height / rows)).cast("int"), F.lit(rows - 1))
    return first_k(matches.withColumns({"cell_row": row, "cell_col": col}), [*key, "cell_row", "cell_col"], [F.col(order)], cap)


def sampled(frames: DataFrame, every: int, warmup: int = 60, start: int = 0) -> DataFrame:
    first = start + warmup
    return frames.where((F.col("frame_idx") >= first) & (F.pmod(F.col("frame_idx") - first, F.lit(every)) == 0))


def take_first(rows: DataFrame, n: int, order: str = "frame_idx", by: str = "session") -> DataFrame:
    return first_k(rows, [by], [F.col(order)], n).drop("rank")


def accept(estimates: DataFrame, min_inliers: int = 80, min_ratio: float = 0.25) -> DataFrame:
    return estimates.where((F.col("n_inliers") >= min_inliers) & (F.col("inlier_ratio") >= min_ratio))


def with_quality(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("quality", g.estimate_quality(F.col("n_inliers"), F.col("inlier_ratio"), F.col("mean_sampson")))


def filter_quality(estimates: DataFrame, least: float = 0.35, fallback: float = 0.2, enough: int = 10, fewest: int = 0) -> DataFrame:
    """Estimates of at least a quality; sessions in which fewer than `enough` are left use the fallback.

    fewest: where a session has fewer estimates in all, the job fails and names it (the command line of the reference run
    asks for 5); 0 lets every session through.
    """
    counts = estimates.groupBy("session").agg(F.count_if(F.col("quality") >= least).alias("good"), F.count(F.lit(1)).alias("pool"))
    floor = F.when(F.col("good") >= enough, least).otherwise(fallback)
    if fewest:
        short = F.raise_error(F.concat(F.lit(f"fewer than {fewest} estimates in session "), F.col("session").cast("string")))
        floor = F.when(F.col("pool") < fewest, short.cast("double")).otherwise(floor)
    counts = counts.select(F.col("session").alias("_session"), floor.alias("_floor"))
    return estimates.join(counts, F.col("session").eqNullSafe(F.col("_session"))).where(F.col("quality") >= F.col("_floor")).drop("_session", "_floor")


def diverse_top_n(estimates: DataFrame, top_n: int = 80, apart: int = 30, chunk: int = 4096, rounds: int = 4) -> DataFrame:
    """(session, frame_idx): best first, those more than `apart` frames from every kept one; all where no more than top_n are.

    Walking in quality order keeps an estimate unless a better kept one is near. So whatever is best among the remaining
    ones within `apart` frames is kept, all over the sessions at once, and what is near to it goes; rounds of this give the
    walk's result, of which the top_n best are taken. Frames lie in chunks with a margin that `rounds` rounds can't reach
    beyond, so a session is never in one task. Ties go by frame; of equal frames the best counts, null qualities don't.
    """
    sizes = estimates.groupBy("session").agg(F.count(F.lit(1)).alias("pool"))
    few = estimates.join(sizes.where(F.col("pool") <= top_n).select("session"), "session", "left_semi").select("session", F.col("frame_idx").cast("bigint").alias("frame_idx"))
    many = estimates.where("quality IS NOT NULL").join(sizes.where(F.col("pool") > top_n).select("session"), "session", "left_semi")
    left = cut(many.groupBy("session", F.col("frame_idx").cast("bigint").alias("frame_idx")).agg(F.max("quality").alias("quality")), "estimates")
    kept, margin = [], 2 * apart * rounds
    near = Window.partitionBy("session", "chunk").orderBy("frame_idx").rangeBetween(-apart, apart)
    place = F.struct("quality", (-F.col("frame_idx")).alias("f"))
    while left.limit(1).count():
        at = F.col("frame_idx")
        low, high = F.floor((at - margin) / chunk), F.floor((at + margin) / chunk)
        rows = left.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("state", F.lit(0))  # 0 open, 1 kept, 2 near to a kept one
        for _ in range(rounds):
            best = F.max(F.when(F.col("state") == 0, place)).over(near)
            rows = rows.withColumn("state", F.when((F.col("state") == 0) & (best == place), 1).otherwise(F.col("state")))
            rows = rows.withColumn("state", F.when((F.col("state") == 0) & (F.count_if(F.col("state") == 1).over(near) > 0), 2).otherwise(F.col("state")))
        rows = cut(rows.where(F.col("chunk") == F.floor(at / chunk)).where("state < 2").select("session", "frame_idx", "quality", "state"), "estimates")
        kept.append(rows.where("state = 1").drop("state"))
        left = rows.where("state = 0").drop("state")
    if not kept:
        return few
    best = first_k(reduce(DataFrame.unionByName, kept), ["session"], [F.desc("quality"), F.asc("frame_idx")], top_n)
    return few.unionByName(best.select("session", "frame_idx"))


def epipolar_stats(matches: DataFrame, f: g.Matrix, key: list[str], limit: float = 2.0) -> DataFrame:
    d = g.epipolar_distance(f, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return matches.withColumn("d", d).groupBy(*key).agg(F.avg("d").alias("mean_px"), F.max("d").alias("max_px"), F.count_if(F.col("d") > limit).alias("n_over"))


def sampson_stats(matches: DataFrame, f: g.Matrix, key: list[str], threshold: float = 1.5) -> DataFrame:
    """Matches within the threshold, their share, and their mean squared distance."""
    s = g.sampson(f, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    near = F.col("s") < threshold * threshold
    return matches.withColumn("s", s).groupBy(*key).agg(F.count_if(near).alias("n_inliers"), (F.count_if(near) / F.count(F.lit(1))).alias("inlier_ratio"), F.coalesce(F.avg(F.when(near, F.col("s"))), F.lit(0.0)).alias("mean_sampson"))


def rank2(f: np.ndarray) -> np.ndarray:
    """Matrices (n, 3, 3) without their smallest singular value, of unit norm."""
    u, s, vt = np.linalg.svd(f)
    s[:, 2] = 0
    out = u @ (s[:, :, None] * vt)
    return out / np.maximum(np.linalg.norm(out, axis=(1, 2), keepdims=True), 1e-300)


def _eight_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fundamental matrices (n, 3, 3) of rank 2 from point sets (n, m, 2), m at least 8."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(1, keepdims=True)
        size = np.sqrt(2) / np.maximum(np.linalg.norm(p - mean, axis=2).mean(1), 1e-9)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = size
        t[:, :2, 2] = -size[:, None] * mean[:, 0]
        t[:, 2, 2] = 1
        return (p - mean) * size[:, None, None], t

    (p, ta), (q, tb) = scaled(a), scaled(b)
    one = np.ones(p.shape[:2])
    rows = np.stack([q[..., 0] * p[..., 0], q[..., 0] * p[..., 1], q[..., 0], q[..., 1] * p[..., 0], q[..., 1] * p[..., 1], q[..., 1], p[..., 0], p[..., 1], one], axis=2)
    # the direction that eight equations leave open ends an orthogonal basis; more of them need the least singular value
    f = np.linalg.qr(np.swapaxes(rows, 1, 2), mode="complete")[0][..., -1] if rows.shape[1] == 8 else np.linalg.svd(rows)[2][:, -1]
    out = np.swapaxes(tb, 1, 2) @ rank2(f.reshape(-1, 3, 3)) @ ta
    return out / np.maximum(np.linalg.norm(out, axis=(1, 2), keepdims=True), 1e-300)


def samples_needed(ratio: float, confidence: float) -> int:
    """Samples of eight of which one is clean with this confidence where a share `ratio` of the matches is right."""
    return max(1, math.ceil(math.log(1 - confidence) / math.log1p(-min(ratio, 0.999) ** 8)))


def _hypotheses(a: np.ndarray, b: np.ndarray, threshold: float, confidence: float, least_ratio: float, seed: int, keep: int = 4, chunk: int = 256) -> np.ndarray:
    """The `keep` best of sampled matrices (n, 3, 3), drawn in chunks until the best inlier ratio so far needs no more."""
    rng, n = np.random.default_rng(seed), len(a)
    ha, hb = np.c_[a, np.ones(n)], np.c_[b, np.ones(n)]
    best, found, done, need = np.zeros(0, dtype=int), np.zeros((0, 3, 3)), 0, samples_needed(least_ratio, confidence)
    while done < need:
        pick = np.argpartition(rng.random((chunk, n)), 7, axis=1)[:, :8]
        f = _eight_points(a[pick], b[pick])
        la, lb = ha @ np.swapaxes(f, 1, 2), hb @ f
        s = np.einsum("nd,hnd->hn", hb, la) ** 2 / np.maximum((la[..., :2] ** 2).sum(2) + (lb[..., :2] ** 2).sum(2), 1e-300)
        best, found = np.r_[best, (s < threshold**2).sum(1)], np.r_[found, f]
        top = np.argsort(-best, kind="stable")[:keep]
        best, found, done = best[top], found[top], done + chunk
        need = min(need, samples_needed(max(best[0] / n, least_ratio), confidence))
    return found


def estimate_fundamental(matches: DataFrame, key: list[str], threshold: float = 1.5, seed: int = 11, confidence: float = 0.9995, least_ratio: float = 0.4, pool: int = 512) -> DataFrame:
    """(key, f, n_matches, n_inliers, inlier_ratio, mean_sampson) of each frame pair by sampled eight-point hypotheses.

    Hypotheses are drawn from a seeded pool of a key's matches, so a task's arrays are bounded whatever the key's size: as
    many as a clean sample needs at the given confidence and the best inlier ratio so far. `least_ratio` bounds them (11 595
    for 0.4): from there on the confidence is kept, below it an estimate may be missed. The best few of the pool then meet
    all matches by a join and the one with most matches within the threshold wins. Keys of fewer than 8 matches give no row.
    """
    fields = ", ".join(f"{k} {dict(matches.dtypes)[k]}" for k in key)
    points = ["x0", "y0", "x1", "y1"]

    def solve(batches):
        for batch in batches:
            ends = np.asarray(batch["x0"].offsets) - batch["x0"].offsets[0].as_py()
            own = np.stack([batch[p].flatten().to_numpy(zero_copy_only=False) for p in points], axis=1)
            found = [_hypotheses(own[lo:hi, :2], own[lo:hi, 2:], threshold, confidence, least_ratio, seed) for lo, hi in zip(ends, ends[1:])]
            sizes = [len(f) for f in found]
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            flat = np.concatenate([np.zeros(0), *[f.ravel() for f in found]])
            made = [pa.array(np.concatenate([np.zeros(0, dtype=int), *map(np.arange, sizes)]), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 9, pa.int32()), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*[batch[k].take(rows) for k in key], *made], [*key, "h", "f"])

    drawn = first_k(matches.select(*key, *points), key, [F.xxhash64(F.lit(seed), *points), *map(F.col, points)], pool).drop("rank")
    drawn = drawn.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*points))).alias("p")).where(F.size("p") >= 8)
    tried = drawn.select(*key, *[F.col(f"p.{p}").alias(p) for p in points]).mapInArrow(solve, f"{fields}, h int, f array<double>")
    s = g.sampson(g.from_array("f", 3, 3), *map(F.col, points))
    scored = matches.select(*key, *points).join(tried, key).withColumn("s", s).withColumn("near", F.col("s") < threshold * threshold)
    counted = scored.groupBy(*key, "h").agg(F.first("f").alias("f"), F.count(F.lit(1)).alias("n_matches"), F.count_if("near").alias("n_inliers"), F.coalesce(F.avg(F.when(F.col("near"), F.col("s"))), F.lit(0.0)).alias("mean_sampson"))
    best = counted.groupBy(*key).agg(F.max_by(F.struct("f", "n_matches", "n_inliers", "mean_sampson"), F.struct("n_inliers", (-F.col("h")).alias("h"))).alias("b"))
    return best.select(*key, "b.f", "b.n_matches", "b.n_inliers", (F.col("b.n_inliers") / F.col("b.n_matches")).alias("inlier_ratio"), "b.mean_sampson")


def ordered_estimates(estimates: DataFrame, most: int = 120, by: str = "session") -> DataFrame:
    """Adds quality, accepted (among the first `most` acceptable estimates in frame order) and place, the order of these by quality."""
    good = take_first(accept(estimates), most, by=by)
    order = Window.partitionBy(by).orderBy(F.col("quality").desc(), "frame_idx")
    placed = with_quality(good).withColumn("place", F.row_number().over(order)).select(F.col(by).alias("p_by"), F.col("frame_idx").alias("p_frame"), "place")
    rated = with_quality(estimates)
    return rated.join(placed, (rated[by] == placed["p_by"]) & (rated["frame_idx"] == placed["p_frame"]), "left").drop("p_by", "p_frame").withColumn("accepted", F.col("place").isNotNull())
