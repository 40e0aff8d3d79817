"""Landmark trajectories: triangulation, smoothing, gap filling, statistics, all sessions at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .calibration import attach_cameras

TRACK = ["session", "name"]


def last_wins(kp: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Of rows with one key the one with the greatest position."""
    rest = [x for x in kp.columns if x not in key]
    best = kp.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("r"))
    return best.select(*key, *[F.col("r")[x].alias(x) for x in rest])


def match_views(kp2d: DataFrame) -> DataFrame:
    """(session, frame_idx, name, x0, y0, x1, y1, confidence): landmarks seen by both cameras, in one shuffle.

    Confidence is the lower of the two. Of duplicates in a view the last (by event_id) counts.
    """
    value = F.struct("px", "py", "confidence")
    views = [F.max_by(F.when(F.col("camera") == k, value), F.when(F.col("camera") == k, F.col("event_id"))).alias(f"v{k}") for k in (0, 1)]
    both = kp2d.groupBy("session", "frame_idx", "name").agg(*views).where("v0 IS NOT NULL AND v1 IS NOT NULL")
    return both.select("session", "frame_idx", "name", *[F.col(f"v{k}.{s}").alias(f"{a}{k}") for k in (0, 1) for s, a in (("px", "x"), ("py", "y"))], F.least("v0.confidence", "v1.confidence").alias("confidence"))


def unmatched(kp2d: DataFrame) -> DataFrame:
    """Keypoints without a partner in the other view."""
    other = kp2d.select("session", "frame_idx", "name", (1 - F.col("camera")).alias("camera")).distinct()
    return kp2d.join(other, ["session", "frame_idx", "name", "camera"], "left_anti")


def solver(shared0: g.Matrix | None = None, shared1: g.Matrix | None = None):
    """Function of (x0, y0, x1, y1, p0, p1) that gives the null vector of a match's four linear equations as x, y, z.

    p0 and p1 are each row's twelve numbers; a camera that all rows share is given here instead, and its column ignored.
    """

    def matrices(own: pd.Series, shared: g.Matrix | None, n: int) -> np.ndarray:
        p = own.to_list() if shared is None else [np.array(shared, dtype=float)]
        return np.broadcast_to(np.stack(p).reshape(-1, 3, 4) if n else np.zeros((0, 3, 4)), (n, 3, 4))

    @F.pandas_udf("x double, y double, z double")
    def solve(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, own0: pd.Series, own1: pd.Series) -> pd.DataFrame:
        n = len(x0)
        a, b = matrices(own0, shared0, n), matrices(own1, shared1, n)
        rows = np.stack([x0.to_numpy()[:, None] * a[:, 2] - a[:, 0], y0.to_numpy()[:, None] * a[:, 2] - a[:, 1], x1.to_numpy()[:, None] * b[:, 2] - b[:, 0], y1.to_numpy()[:, None] * b[:, 2] - b[:, 1]], axis=1)
        h = np.linalg.svd(rows)[2][:, -1, :] if n else np.zeros((0, 4))
        return pd.DataFrame(h[:, :3] / h[:, 3:], columns=["x", "y", "z"])

    return solve


def triangulate(matches: DataFrame, p0: g.Camera = "p0", p1: g.Camera = "p1") -> DataFrame:
    """Adds x, y, z: the null vector of the four linear equations of a match, by batched decompositions.

    A camera is a 3x4 matrix for all rows or the name of a column with twelve numbers, so that sessions of many rigs go
    through one job. Matches with a coordinate that is not finite are dropped before, as no decomposition of them exists.
    """
    finite = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")) for n in ("x0", "y0", "x1", "y1")]
    ok = finite[0] & finite[1] & finite[2] & finite[3]
    solve = solver(*[None if isinstance(p, str) else p for p in (p0, p1)])
    own = [F.col(p) if isinstance(p, str) else F.array().cast("array<double>") for p in (p0, p1)]
    # declared non-deterministic so that filters on its result don't evaluate it a second time
    solved = matches.where(ok).withColumn("p", solve.asNondeterministic()("x0", "y0", "x1", "y1", *own))
    return solved.select(*matches.columns, "p.x", "p.y", "p.z")


def triangulate_keypoints(kp2d: DataFrame, p0: g.Camera = "p0", p1: g.Camera = "p1", min_confidence: float = 0.3, max_reprojection_px: float = 20.0, cameras: DataFrame | None = None) -> DataFrame:
    """(session, frame_idx, name, x, y, z, confidence, reproj_err): matched, confident, triangulated, close in both views.

    With cameras (session, camera, p) every session is seen by its own rig, else p0 and p1 hold for all.
    """
    matches = match_views(kp2d).where(F.col("confidence") >= min_confidence)
    points = triangulate(attach_cameras(matches, cameras) if cameras is not None else matches, p0, p1)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    err = (g.reprojection_error(p0, x, y, z, F.col("x0"), F.col("y0")) + g.reprojection_error(p1, x, y, z, F.col("x1"), F.col("y1"))) / 2
    return points.withColumn("reproj_err", err).where(g.keep_error(F.col("reproj_err"), max_reprojection_px)).select("session", "frame_idx", "name", "x", "y", "z", "confidence", "reproj_err")


def smooth(kp3d: DataFrame, frames: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Gaussian smoothing of each landmark over its observed frames, mirror edges, no new points.

    Every observed frame meets the kernel's offsets, reflected into the session's frames, and the observed values there;
    weights are divided by the weight that met a value. Confidence and error pass through.
    """
    if sigma <= 0:
        return kp3d
    kernel = F.array(*[F.struct(F.lit(k).alias("offset"), F.lit(w).alias("weight")) for k, w in g.gaussian_kernel(sigma)])
    at = kp3d.join(frames, "session").select("session", "name", "frame_idx", "n_frames", F.inline(kernel))
    at = at.select("session", "name", "frame_idx", "weight", g.reflected(F.col("frame_idx") + F.col("offset"), F.col("n_frames")).alias("source"))
    values = kp3d.where("x IS NOT NULL AND NOT isnan(x)").select(*TRACK, F.col("frame_idx").alias("source"), "x", "y", "z")
    met = at.join(values, [*TRACK, "source"])
    means = met.groupBy(*TRACK, "frame_idx").agg(*[(F.sum(F.col("weight") * F.col(v)) / F.sum("weight")).alias(v) for v in "xyz"])
    return means.join(kp3d.select(*TRACK, "frame_idx", "confidence", "reproj_err"), [*TRACK, "frame_idx"])


def gaps(kp3d: DataFrame) -> DataFrame:
    """Each point with the next one of its landmark and the number of frames missing between."""
    order = Window.partitionBy(*TRACK).orderBy("frame_idx")
    following = {f"next_{v}": F.lead(v).over(order) for v in ("frame_idx", "x", "y", "z", "confidence")}
    return kp3d.withColumns(following).withColumn("gap", F.col("next_frame_idx") - F.col("frame_idx") - 1)


def gap_report(kp3d: DataFrame) -> DataFrame:
    """(session, name, first_missing, last_missing, gap) of every gap between two points."""
    return gaps(kp3d).where("gap > 0").select(*TRACK, (F.col("frame_idx") + 1).alias("first_missing"), (F.col("next_frame_idx") - 1).alias("last_missing"), "gap")


def fill_gaps(kp3d: DataFrame, max_gap: int = 10) -> DataFrame:
    """Points as they are, and linear interpolations inside gaps of at most max_gap frames (error 0, confidence 0.8 of the lower end)."""
    step = gaps(kp3d).where((F.col("gap") > 0) & (F.col("gap") <= max_gap)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("gap").cast("int"))))
    t = F.col("k") / (F.col("gap") + 1)
    filled = step.select(*TRACK, (F.col("frame_idx") + F.col("k")).alias("frame_idx"), *[g.lerp(F.col(v), F.col(f"next_{v}"), t).alias(v) for v in "xyz"], (0.8 * F.least("confidence", "next_confidence")).alias("confidence"), F.lit(0.0).alias("reproj_err"))
    return kp3d.select(filled.columns).unionByName(filled)


def dense(kp3d: DataFrame, frames: DataFrame) -> DataFrame:
    """Every landmark at every frame of its session, null where it wasn't seen."""
    spine = kp3d.select(*TRACK).distinct().join(frames, "session").select(*TRACK, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame_idx"))
    return spine.join(kp3d, [*TRACK, "frame_idx"], "left")


def stats(kp3d: DataFrame, frames: DataFrame) -> DataFrame:
    """(session, name, detection_rate, n_detected, mean_repr_err, max_repr_err); errors of 0 (filled points) don't count."""
    seen = F.when(F.col("reproj_err") > 0, F.col("reproj_err"))
    found = kp3d.groupBy(*TRACK).agg(F.countDistinct("frame_idx").alias("n_detected"), F.coalesce(F.avg(seen), F.lit(0.0)).alias("mean_repr_err"), F.coalesce(F.max(seen), F.lit(0.0)).alias("max_repr_err"))
    return found.join(frames, "session").select(*TRACK, (F.col("n_detected") / F.col("n_frames")).alias("detection_rate"), "n_detected", "mean_repr_err", "max_repr_err")


def world_bounds(kp3d: DataFrame, pad: float = 50.0) -> DataFrame:
    """(session, x_min .. z_max) around the points; a fixed box where a session has none."""
    finite = {v: F.when(~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z"), F.col(v)) for v in "xyz"}
    box = {"x": (-500.0, 500.0), "y": (-500.0, 500.0), "z": (0.0, 500.0)}
    aggs: list[Column] = []
    for v in "xyz":
        aggs += [F.coalesce(F.min(finite[v]) - pad, F.lit(box[v][0])).alias(f"{v}_min"), F.coalesce(F.max(finite[v]) + pad, F.lit(box[v][1])).alias(f"{v}_max")]
    return kp3d.groupBy("session").agg(*aggs)


def vocabulary(kp3d: DataFrame) -> DataFrame:
    return kp3d.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def detection_rate(kp3d: DataFrame, frames: DataFrame) -> DataFrame:
    seen = kp3d.groupBy("session").agg(F.countDistinct("frame_idx").alias("n_seen"))
    return frames.join(seen, "session", "left").select("session", (F.coalesce("n_seen", F.lit(0)) / F.col("n_frames")).alias("rate"))


def visible_joints(kp3d: DataFrame, least: float = 0.1) -> DataFrame:
    """(session, frame_idx, n_visible, share): landmarks seen in a frame, and their share of all that the session knows."""
    known = kp3d.groupBy("session").agg(F.countDistinct("name").alias("n_names"))
    seen = kp3d.where(F.col("confidence") > least).groupBy("session", "frame_idx").agg(F.countDistinct("name").alias("n_visible"))
    return seen.join(known, "session").select("session", "frame_idx", "n_visible", (F.col("n_visible") / F.col("n_names")).alias("share"))


def edge_index(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges as pairs of positions in a session's sorted names; edges with an unknown end go."""
    a = names.select("session", F.col("name").alias("a"), F.col("idx").alias("ia"))
    b = names.select("session", F.col("name").alias("b"), F.col("idx").alias("ib"))
    return a.join(F.broadcast(edges), "a").join(b, ["session", "b"]).select("session", "a", "b", "ia", "ib")


def bones(kp3d: DataFrame, edges: DataFrame, least: float = 0.1) -> DataFrame:
    """Segments of skeleton edges of which both joints are visible in a frame, and their lengths."""
    seen = kp3d.where(F.col("confidence") > least)
    a = seen.select("session", "frame_idx", F.col("name").alias("a"), *[F.col(v).alias(f"a{v}") for v in "xyz"])
    b = seen.select("session", "frame_idx", F.col("name").alias("b"), *[F.col(v).alias(f"b{v}") for v in "xyz"])
    both = a.join(F.broadcast(edges), "a").join(b, ["session", "frame_idx", "b"])
    return both.select("session", "frame_idx", "a", "b", F.sqrt(g.total((F.col(f"a{v}") - F.col(f"b{v}")) * (F.col(f"a{v}") - F.col(f"b{v}")) for v in "xyz")).alias("length"))


def names_indexed(kp3d: DataFrame) -> DataFrame:
    """(session, name, idx): position of a landmark among the sorted names of its session."""
    return kp3d.select(*TRACK).distinct().withColumn("idx", F.row_number().over(Window.partitionBy("session").orderBy("name")) - 1)
