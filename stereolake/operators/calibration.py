"""Self-calibration: focal scans over many epipolar estimates, motion from essential matrices, quality rules."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def focal_grid(width: int, height: int, steps: int = 300, low: float = 0.4, high: float = 3.5) -> list[float]:
    diagonal = math.hypot(width, height)
    return [diagonal * (low + (high - low) * i / (steps - 1)) for i in range(steps)]


def _residuals(m: np.ndarray, f: np.ndarray, cx: float, cy: float) -> np.ndarray:
    """(n, k): how far K'FK is from an essential matrix for fundamental matrices (n, 3, 3) and focal lengths (n or 1, k).

    With T, A and D the elementary symmetric functions of the squared singular values of E (T is E's squared norm, D its
    squared determinant, A the sum of squared 2x2 minors), the squared norm of 2EE'E - tr(EE')E is T^3 - 4TA + 12D. As
    E = diag(f, f, 1) M diag(f, f, 1), all three are polynomials in f^2 whose seven coefficients follow from M alone, so a
    block of estimates meets all focal lengths in a few products of arrays. Matrices of no norm count 1.
    """
    shift = np.array([[1.0, 0.0, cx], [0.0, 1.0, cy], [0.0, 0.0, 1.0]])
    m = shift.T @ m @ shift
    minors = np.cross(m[:, [1, 2, 0]], m[:, [2, 0, 1]])  # rows of the cofactor matrix
    det = (m[:, 0] * minors[:, 0]).sum(1)

    def parts(v: np.ndarray) -> list[np.ndarray]:
        """Sums of squares of the upper left block, of the rest of the last row and column, and of the last entry."""
        v = v * v
        return [x[:, None] for x in (v[:, :2, :2].sum((1, 2)), v[:, 2, :2].sum(1) + v[:, :2, 2].sum(1), v[:, 2, 2])]

    (a, b, c), (p, q, r) = parts(m), parts(minors)
    f2 = f * f
    norm = (a * f2 + b) * f2 + c
    safe = np.maximum(norm, 1e-300)
    area = ((r * f2 + q) * f2 + p) * (f2 / safe) ** 2
    volume = (det[:, None] * f2 / safe) ** 2 * (f2 * f2 / safe)
    return np.where(norm < 1e-20, 1.0, np.sqrt(np.maximum(1 - 4 * area + 12 * volume, 0)))


def _cost(estimates: DataFrame, width: int, height: int, grid: list[float], centred: bool = False, weigh: bool = True) -> DataFrame:
    """(session, f, cost): the quality-weighted mean residual at each focal length of a grid of fixed size.

    centred: the grid is a list of steps from each row's column f, kept between f_low and f_high. Estimates are shuffled so
    that those of a session follow each other (a session too large for a task is split by Spark); a task then gives about one
    array of sums for each of its sessions, not one for each estimate. These are gathered by session and added up.
    """
    names = [f"f{i}{j}" for i in range(3) for j in range(3)]
    steps = np.array(grid)
    extra = ["f", "f_low", "f_high"] if centred else []

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            m, q = pdf[names].to_numpy(float).reshape(-1, 3, 3), pdf["quality"].to_numpy(float) if weigh else np.ones(len(pdf))
            keys, at = np.unique(pdf["session"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(keys), len(steps) + 2))  # the weight and the centre last
            sums[:, -2] = np.bincount(at, weights=q, minlength=len(keys))
            for lo in range(0, len(pdf), 256):
                part = slice(lo, lo + 256)
                f = steps[None]
                if centred:
                    own, low, high = (pdf[c].to_numpy(float)[part, None] for c in extra)
                    f = np.clip(own + steps[None], low, high)
                    sums[at[part], -1] = own[:, 0]
                heads = np.flatnonzero(np.diff(at[part], prepend=-1))
                np.add.at(sums[:, :-2], at[part][heads], np.add.reduceat(q[part, None] * _residuals(m[part], f, width / 2, height / 2), heads, axis=0))
            yield _arrays(keys, sums)

    def add(batches):
        own, held = None, None  # a session goes on when its last row has been seen, be it batches later
        for batch in batches:
            if not batch.num_rows:
                continue
            session, rows = np.asarray(batch["session"]), np.asarray(batch["sums"].flatten()).reshape(batch.num_rows, -1)
            heads = np.flatnonzero(np.append(True, np.diff(session) != 0))
            keys, sums = session[heads], np.add.reduceat(rows, heads, axis=0)
            sums[:, -1] = rows[heads, -1]
            if own is not None and own == keys[0]:
                sums[0, :-1] += held[:-1]
            elif own is not None:
                keys, sums = np.append(own, keys), np.vstack([held, sums])
            own, held = keys[-1], sums[-1]
            yield _arrays(keys[:-1], sums[:-1])
        if own is not None:
            yield _arrays(np.array([own]), held[None])

    kind = "session bigint, sums array<double>"
    blocks = estimates.select("session", "quality", *names, *extra).hint("rebalance", "session").sortWithinPartitions("session").mapInArrow(run, kind)
    whole = blocks.repartition("session").sortWithinPartitions("session").mapInArrow(add, kind)
    sums = whole.select("session", F.get("sums", F.lit(len(steps))).alias("weight"), F.get("sums", F.lit(len(steps) + 1)).alias("centre"), F.posexplode(F.slice("sums", 1, len(steps))).alias("pos", "part"))
    f = F.col("centre") + F.get(F.array(*map(F.lit, grid)), F.col("pos"))
    return sums.select("session", f.alias("f"), (F.col("part") / F.col("weight")).alias("cost"))


def _arrays(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """(session, sums) of rows of equal length."""
    ends = pa.array(np.arange(len(keys) + 1) * sums.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], ["session", "sums"])


def focal_scan(estimates: DataFrame, width: int, height: int, steps: int = 300) -> DataFrame:
    """(session, f, cost) over the scan's focal lengths. The grid is a parameter of fixed size, met by every estimate."""
    return _cost(estimates, width, height, focal_grid(width, height, steps))


def mean_essential_residual(estimates: DataFrame, focal: DataFrame, width: int, height: int, send: bool = False) -> DataFrame:
    """(session, f, residual): the plain mean of the estimates' residuals at each session's focal length (session, f).

    Estimates whose essential matrix vanishes don't count; sessions without any other have 1. send: sessions are few enough
    to send their focal lengths to all tasks, so estimates aren't shuffled; else Spark's size check decides.
    """
    own = focal.select("session", "f")
    near = estimates.drop("f").join(F.broadcast(own) if send else own, "session").withColumns({"f_low": F.col("f"), "f_high": F.col("f")})
    k = g.intrinsics(F.col("f"), width / 2, height / 2)
    near = near.where(g.norm(g.matmul(g.transpose(k), g.matmul(g.columns("f"), k))) > 1e-10)
    mean = _cost(near, width, height, [0.0], centred=True, weigh=False).select("session", F.col("cost").alias("residual"))
    return focal.select("session", "f").join(mean, "session", "left").withColumn("residual", F.coalesce("residual", F.lit(1.0)))


def best_focal(scan: DataFrame) -> DataFrame:
    """(session, f, cost) of the first minimum."""
    return scan.groupBy("session").agg(F.min(F.struct("cost", "f")).alias("m")).select("session", "m.f", "m.cost")


def focal_refine(estimates: DataFrame, width: int, height: int, steps: int = 300, tolerance: float = 0.1, send: bool = False) -> DataFrame:
    """(session, f, cost): the scan's minimum, then finer scans of 41 points around it until the step is below tolerance.

    All sessions take a round together; the number of rounds follows from the scan's step, not from the data. send: as in
    `mean_essential_residual`.
    """
    grid = focal_grid(width, height, steps)
    best, step = best_focal(focal_scan(estimates, width, height, steps)), grid[1] - grid[0]
    while step >= tolerance:
        own = best.select("session", "f")
        near = estimates.drop("f").join(F.broadcast(own) if send else own, "session").withColumns({"f_low": F.lit(grid[0]), "f_high": F.lit(grid[-1])})
        tried = _cost(near, width, height, [k * step / 20 for k in range(-20, 21)], centred=True)
        best = best_focal(tried.withColumn("f", F.least(F.greatest("f", F.lit(grid[0])), F.lit(grid[-1]))))
        step /= 20
    return best


def gates(estimates: DataFrame, result: DataFrame, width: int, height: int) -> DataFrame:
    """(session, enough, fov_ok, residual_ok, metric_ok, rms_ok) of results (session, f, residual, scale, rms).

    At least 20 estimates of quality 0.4; a field of view between 20 and 160 degrees; a mean essential residual below 0.05;
    a metric scale that was applied; a target calibration's error below 1 pixel, null where there is none.
    """
    good = estimates.groupBy("session").agg((F.count_if(F.col("quality") >= 0.4) >= 20).alias("enough"))
    fov = g.fov_degrees(math.hypot(width, height), F.col("f"))
    return good.join(result, "session").select("session", "enough", ((fov > 20) & (fov < 160)).alias("fov_ok"), (F.col("residual") < 0.05).alias("residual_ok"), F.col("scale").isNotNull().alias("metric_ok"), (F.col("rms") < 1.0).alias("rms_ok"))


def advice(results: DataFrame) -> DataFrame:
    """(session, advice) of (session, n_good, residual, f_scan, f_metric): what to do next, joined by '; '."""
    shift = F.abs(F.col("f_metric") - F.col("f_scan")) / F.col("f_scan")
    said = [
        F.when(F.col("n_good") < 30, "more footage with texture"),
        F.when(F.col("residual") > 0.05, "check radial distortion"),
        F.when(shift > 0.15, "check arena bounds and coverage"),
    ]
    joined = F.array_join(F.array_compact(F.array(*said)), "; ")
    return results.select("session", F.when(joined == "", "solid").otherwise(joined).alias("advice"))


def report(estimates: DataFrame, scan: DataFrame, result: DataFrame, width: int, height: int, frame: str = "event_id") -> DataFrame:
    """(session, part, name, x, y, grade): the tables of a calibration report, one under the other.

    `curve` is the scan (x focal length, y cost); `quality` (x frame) and `sampson` (x inliers, y mean distance) are the
    estimates' scatter plots with a grade for each point; `parameter`, `gate` (1 passed, 0 not, null not told) and `advice`
    come by name. result: (session, f, f_scan, f_metric, residual, scale, rms); what it doesn't know is null.
    """
    diagonal = math.hypot(width, height)
    rows = lambda df, part, name, x, y, grade: df.select("session", F.lit(part).alias("part"), name.cast("string").alias("name"), x.cast("double").alias("x"), y.cast("double").alias("y"), grade.cast("string").alias("grade"))
    c, none = F.col, F.lit(None)
    quality = F.when(c("quality") >= 0.4, "good").otherwise("poor")
    distance = F.when(c("mean_sampson") < 0.5, "good").when(c("mean_sampson") < 1.5, "fair").otherwise("poor")
    counts = estimates.groupBy("session").agg(F.count_if(c("quality") >= 0.4).alias("n_good"), F.count(F.lit(1)).alias("n_used"))
    told = result.join(counts, "session")
    named = {"focal": c("f"), "focal_by_diagonal": c("f") / diagonal, "fov_degrees": g.fov_degrees(diagonal, c("f")), "f_scan": c("f_scan"), "f_metric": c("f_metric"), "scale": c("scale"), "residual": c("residual"), "n_used": c("n_used"), "n_good": c("n_good")}
    listed = told.select("session", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), v.cast("double").alias("v")) for n, v in named.items()])).alias("e"))
    gated = gates(estimates, result, width, height)
    passed = gated.select("session", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in gated.columns[1:]])).alias("e"))
    parts = [
        rows(scan, "curve", none, c("f"), c("cost"), none),
        rows(estimates, "quality", none, c(frame), c("quality"), quality), rows(estimates, "sampson", none, c("n_inliers"), c("mean_sampson"), distance),
        rows(listed, "parameter", c("e.n"), none, c("e.v"), none), rows(passed, "gate", c("e.n"), none, c("e.v"), none), rows(advice(told), "advice", none, none, none, c("advice")),
    ]
    return reduce(DataFrame.unionByName, parts)


def compare(auto: DataFrame, target: DataFrame) -> DataFrame:
    """(session, diff_pct, agreement) of focal lengths (session, f) from two calibrations."""
    diff = F.abs(F.col("f") - F.col("t_f")) / F.col("t_f") * 100
    both = auto.join(target.select("session", F.col("f").alias("t_f")), "session").withColumn("diff_pct", diff)
    return both.select("session", "diff_pct", F.when(F.col("diff_pct") < 2, "excellent").when(F.col("diff_pct") < 5, "good").when(F.col("diff_pct") < 10, "fair").otherwise("poor").alias("agreement"))


def robust_span(points: DataFrame, key: str = "session") -> DataFrame:
    """(key, span_x, span_y, span_z): from the 2nd to the 98th percentile."""
    spread = {v: F.percentile(v, F.array(F.lit(0.02), F.lit(0.98))) for v in "xyz"}
    return points.groupBy(key).agg(*[(spread[v][1] - spread[v][0]).alias(f"span_{v}") for v in "xyz"])


def metric_scale(spans: DataFrame, arena: tuple[float, float, float]) -> DataFrame:
    """(session, scale, focal_factor): median of arena over reconstruction by axis, 1 where no axis has an extent."""
    axes = F.array(*[F.when(F.col(f"span_{v}") > 1e-6, F.lit(float(a)) / F.col(f"span_{v}")) for v, a in zip("xyz", arena)])
    long = spans.select("session", F.explode_outer(F.array_compact(axes)).alias("ratio"))
    return long.groupBy("session").agg(F.coalesce(F.median("ratio"), F.lit(1.0)).alias("scale")).withColumn("focal_factor", F.sqrt("scale"))


def motions(estimates: DataFrame, f: float | str, cx: float, cy: float) -> DataFrame:
    """(session, event_id, options): the four candidate motions of each estimate, by batched decompositions of essential matrices.

    f is a focal length or the column that holds each row's. Rows whose essential matrix vanishes, or isn't finite, have none
    and are left out.
    """
    names = [f"f{i}{j}" for i in range(3) for j in range(3)]

    def solve(batches):
        for pdf in batches:
            e = essentials(pdf[names].to_numpy(float).reshape(-1, 3, 3), pdf["focal"].to_numpy(float), cx, cy)
            sound = np.isfinite(e).all((1, 2)) & (np.sqrt((e * e).sum((1, 2))) >= 1e-10)
            if not sound.any():
                continue
            r, t = options_of(e[sound])
            rows = [[{"r": m.ravel().tolist(), "t": v.tolist()} for m, v in zip(*own)] for own in zip(r, t)]
            yield pd.DataFrame({"session": pdf["session"][sound], "event_id": pdf["event_id"][sound], "options": rows})

    kept = estimates.select("session", "event_id", *names, (F.col(f) if isinstance(f, str) else F.lit(float(f))).alias("focal"))
    return kept.mapInPandas(solve, "session bigint, event_id bigint, options array<struct<r: array<double>, t: array<double>>>")


def essentials(m: np.ndarray, f: np.ndarray, cx: float, cy: float) -> np.ndarray:
    """K'FK for matrices (n or 1, 3, 3) and focal lengths (n)."""
    k = np.zeros((len(f), 3, 3))
    k[:, 0, 0] = k[:, 1, 1] = f
    k[:, 0, 2], k[:, 1, 2], k[:, 2, 2] = cx, cy, 1
    return k.transpose(0, 2, 1) @ m @ k


def options_of(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (n, 4, 3, 3) and directions (n, 4, 3) that essential matrices (n, 3, 3) leave open."""
    u, _, vt = np.linalg.svd(e)
    u[np.linalg.det(u) < 0] *= -1
    vt[np.linalg.det(vt) < 0] *= -1
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    one, two, t = u @ w @ vt, u @ w.T @ vt, u[:, :, 2]
    return np.stack([one, one, two, two], 1), np.stack([t, -t, t, -t], 1)


def choose_motion(options: DataFrame, matches: DataFrame, f: float | Column, cx: float, cy: float) -> DataFrame:
    """(session, event_id, r, t, n_front): of the candidate motions the one with most matches in front of both cameras.

    matches: (session, event_id, x0, y0, x1, y1); f may be a column of theirs. Depths are the closed-form ones of two rays.
    """
    # one row a match and motion; file sizes say little about the lists, so neither side is taken for small
    tried = options.select("session", "event_id", F.posexplode("options").alias("pos", "o")).join(matches.hint("merge"), ["session", "event_id"])
    ray = lambda n: [(F.col(f"x{n}") - cx) / f, (F.col(f"y{n}") - cy) / f, F.lit(1.0)]
    r = [[F.col("o.r")[3 * i + j] for j in range(3)] for i in range(3)]
    a = [g.total(r[i][j] * ray(0)[j] for j in range(3)) for i in range(3)]
    b, t = ray(1), [F.col("o.t")[i] for i in range(3)]
    dot = lambda p, q: g.total(m * n for m, n in zip(p, q))
    det = dot(a, a) * dot(b, b) - dot(a, b) * dot(a, b) + 1e-12
    z0 = (dot(a, b) * dot(b, t) - dot(b, b) * dot(a, t)) / det
    z1 = (dot(a, a) * dot(b, t) - dot(a, b) * dot(a, t)) / det
    counted = tried.groupBy("session", "event_id", "pos").agg(F.count_if((z0 > 0) & (z1 > 0)).alias("n_front"), F.first("o").alias("o"))
    best = counted.groupBy("session", "event_id").agg(F.max_by(F.struct("n_front", "o"), F.struct("n_front", (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("session", "event_id", "b.o.r", "b.o.t", "b.n_front")


def raw_projections(calib: DataFrame) -> DataFrame:
    """(session, camera, p): the projection matrices of each session's rig, twelve numbers row by row.

    K0 [I | 0] and K1 [R | T] with R the nine numbers of column r; where the rows are of rectified images, the stored
    matrices p0 and p1.
    """
    zero = F.lit(0.0)
    k0 = g.intrinsics(F.col("f0"), F.col("cx"), F.col("cy"))
    k1 = g.intrinsics(F.col("f1"), F.col("cx"), F.col("cy"))
    r = g.from_array("r", 3, 3)
    raw0 = [[*row, zero] for row in k0]
    raw1 = g.matmul(k1, [[*row, F.col(t)] for row, t in zip(r, ("tx", "ty", "tz"))])
    flat = lambda m: F.array(*[g.c(v) for row in m for v in row])
    p0, p1 = F.when(F.col("rectified"), F.col("p0")).otherwise(flat(raw0)), F.when(F.col("rectified"), F.col("p1")).otherwise(flat(raw1))
    return calib.select("session", F.posexplode(F.array(p0, p1)).alias("camera", "p"))


def attach_cameras(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """Adds p0 and p1, the matrices of each row's session, from (session, camera, p). Rows of sessions without both are dropped.

    Sessions are few beside their rows; whether they are broadcast is left to Spark's size check.
    """
    views = [F.max(F.when(F.col("camera") == k, F.col("p"))).alias(f"p{k}") for k in (0, 1)]
    both = cameras.groupBy("session").agg(*views).where("p0 IS NOT NULL AND p1 IS NOT NULL")
    return rows.join(both, "session")


def baseline(calib: DataFrame, warn: float = 1.5) -> DataFrame:
    return calib.select("session", F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz")).alias("baseline"), (F.col("rms_stereo") > warn).alias("poor"))
