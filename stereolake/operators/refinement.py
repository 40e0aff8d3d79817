"""Refining focal lengths with matches: motion of the best estimate, the arena's extent, reprojection error, and all in a row.

Estimates are (session, event_id, f00 .. f22, quality), matches (session, event_id, x0, y0, x1, y1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.tables import cut
from .calibration import choose_motion, essentials, focal_refine, mean_essential_residual, metric_scale, motions, robust_span

#: Estimates whose focal lengths a task tries at once, and points of which it holds the intermediate arrays.
AT_ONCE = 2048
POINTS_AT_ONCE = 8192
#: Sessions up to which a round sends their focal lengths to all tasks; with more, estimates are dealt by session each round.
SESSIONS_SENT = 2_000_000


def gathered(estimates: DataFrame, matches: DataFrame) -> DataFrame:
    """(session, event_id, place, m, points): a row for each estimate, written: its place by quality in its session (of equal
    ones the first by event_id), its nine numbers, and its matches' x0, y0, x1, y1 one after the other, null without any.

    Matches are shuffled here only; all that follows reads this table, most of it a few rows of each session.
    """
    names = [f"f{i}{j}" for i in range(3) for j in range(3)]
    order = Window.partitionBy("session").orderBy(F.col("quality").desc(), "event_id")
    ranked = estimates.select("session", "event_id", F.row_number().over(order).alias("place"), F.array(*names).alias("m"))
    points = matches.groupBy("session", "event_id").agg(F.flatten(F.collect_list(F.array("x0", "y0", "x1", "y1"))).alias("points"))
    return cut(ranked.join(points.hint("merge"), ["session", "event_id"], "left"), "gathered")


def _matches(rows: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1 to gathered rows, a row for each match."""
    listed = rows.where("points IS NOT NULL").withColumn("at", F.explode(F.sequence(F.lit(0), F.size("points") - 4, F.lit(4))))
    return listed.select(*[c for c in rows.columns if c != "points"], *[F.col("points")[F.col("at") + n].alias(v) for n, v in enumerate(("x0", "y0", "x1", "y1"))])


def extrinsics(estimates: DataFrame, matches: DataFrame, focal: DataFrame, width: int, height: int) -> DataFrame:
    """(session, f, r, t, found): the motion of each session's best estimate at its focal length (session, f).

    The best is the one of highest quality, of equal ones the first by event_id. Where its essential matrix vanishes, or no
    match of it is there to choose by, found is false, r the identity and t (1, 0, 0).
    """
    return _extrinsics(gathered(estimates, matches), focal, width, height)


def _extrinsics(rows: DataFrame, focal: DataFrame, width: int, height: int) -> DataFrame:
    cx, cy = width / 2, height / 2
    best = rows.where("place = 1").join(focal.select("session", "f"), "session")
    named = best.select("session", "event_id", "f", *[F.col("m")[3 * i + j].alias(f"f{i}{j}") for i in range(3) for j in range(3)])
    seen = _matches(best.select("session", "event_id", "f", "points"))
    chosen = choose_motion(motions(named, "f", cx, cy), seen, F.col("f"), cx, cy).select("session", "r", "t")
    still = [F.array(*map(F.lit, row)) for row in ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0])]
    out = focal.select("session", "f").join(chosen, "session", "left")
    return out.select("session", "f", F.coalesce("r", still[0]).alias("r"), F.coalesce("t", still[1]).alias("t"), F.col("r").isNotNull().alias("found"))


def points_in_front(rows: DataFrame, least: int = 5) -> DataFrame:
    """(session, x, y, z): the triangulated matches of gathered rows with cameras p0 and p1, those in front of the camera and
    not next to infinity, of rows that keep at least so many. Matches with a coordinate that is not finite don't count.

    A homogeneous point of unit length has the last coordinate 1 / sqrt(1 + x^2 + y^2 + z^2), which must exceed 1e-6.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part["points"].offsets)) // 4)
                points = np.asarray(part["points"].flatten(), dtype=float).reshape(-1, 4)
                sound = np.isfinite(points).all(1)
                row, points = row[sound], points[sound]
                p, q = (np.asarray(part[c].flatten(), dtype=float).reshape(-1, 3, 4)[row] for c in ("p0", "p1"))
                lines = [points[:, n, None] * camera[:, 2] - camera[:, n % 2] for n, camera in enumerate((p, p, q, q))]
                h = np.linalg.svd(np.stack(lines, axis=1))[2][:, -1]
                with np.errstate(all="ignore"):
                    at = h[:, :3] / h[:, 3:]
                    front = (at[:, 2] > 0) & ((at * at).sum(1) + 1 < 1e12)
                front &= np.bincount(row[front], minlength=part.num_rows)[row] >= least
                yield pa.RecordBatch.from_arrays([part["session"].take(pa.array(row[front])), *map(pa.array, at[front].T)], ["session", *"xyz"])

    return rows.where("points IS NOT NULL").select("session", "points", "p0", "p1").mapInArrow(run, f"session {dict(rows.dtypes)['session']}, x double, y double, z double")


def metric_refine(estimates: DataFrame, matches: DataFrame, focal: DataFrame, arena: tuple[float, float, float], width: int, height: int, most: int = 40, least: int = 10) -> DataFrame:
    """(session, f, f_metric, scale): focal lengths (session, f) corrected by the arena's known extent.

    The motion of the best estimate triangulates the matches of the first estimates; the arena's extent over the points'
    robust extent, the median of the axes, is the scale, and its square root corrects f. Sessions without a motion or
    without points keep f, with a scale of 1. The first estimates are `most` of each session by quality, of which those
    with fewer than `least` matches then go.
    """
    return _metric(gathered(estimates, matches), focal, arena, width, height, most, least)


def _metric(rows: DataFrame, focal: DataFrame, arena: tuple[float, float, float], width: int, height: int, most: int = 40, least: int = 10) -> DataFrame:
    cx, cy = width / 2, height / 2
    pose = _extrinsics(rows, focal, width, height).where("found")
    k, zero = g.intrinsics(F.col("f"), cx, cy), F.lit(0.0)
    flat = lambda m: F.array(*[g.c(v) for row in m for v in row])
    rt = [[*row, F.col("t")[i]] for i, row in enumerate(g.from_array("r", 3, 3))]
    cameras = pose.select("session", flat([[*row, zero] for row in k]).alias("p0"), flat(g.matmul(k, rt)).alias("p1"))
    first = rows.where((F.col("place") <= most) & (F.size("points") >= 4 * least)).select("session", "points")
    points = points_in_front(first.join(cameras, "session"))
    scale = metric_scale(robust_span(points), arena).select("session", "scale")
    out = focal.select("session", "f").join(scale, "session", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return out.select("session", "f", (F.col("f") * F.sqrt("scale")).alias("f_metric"), "scale")


def _last_direction(x0: np.ndarray, y0: np.ndarray, h: list[np.ndarray], k: list[np.ndarray], rounds: int = 6) -> list[np.ndarray]:
    """Vectors, of no fixed length or sign, that the matrices A with the rows (-1, 0, x0, 0), (0, -1, y0, 0), h and k shorten most:
    eigenvectors to the smallest eigenvalue of A'A. Vectors whose third element is 0 come out as 0.

    The characteristic polynomial has the squared determinant of A and the squared length of its adjugate as the last two
    coefficients, both short by the zeros of A. Newton's rounds from 0 rise to its smallest root, until none moves. A column
    of the adjugate of what is left when the root is taken off the diagonal is the vector.
    """
    g = {(i, j): h[i] * h[j] + k[i] * k[j] for i in range(4) for j in range(i, 4)}
    far = x0 * x0 + y0 * y0
    g[0, 0], g[1, 1], g[0, 2], g[1, 2], g[2, 2] = g[0, 0] + 1, g[1, 1] + 1, g[0, 2] - x0, g[1, 2] - y0, g[2, 2] + far
    trace = g[0, 0] + g[1, 1] + g[2, 2] + g[3, 3]
    pairs = sum(g[i, i] * g[j, j] - g[i, j] * g[i, j] for i in range(4) for j in range(i + 1, 4))
    p, q = (r[0] * x0 + r[1] * y0 + r[2] for r in (h, k))
    whole = p * k[3] - h[3] * q
    a, b, c, d = k[3] * h[0] - h[3] * k[0], k[3] * h[1] - h[3] * k[1], p * k[0] - q * h[0], p * k[1] - q * h[1]
    triples = (a * a + b * b + h[3] * h[3] + k[3] * k[3]) * (far + 1) + c * c + d * d + p * p + q * q + 2 * whole * (whole - x0 * a - y0 * b)
    whole *= whole
    root = np.zeros_like(trace)
    for _ in range(rounds):
        value, slope = root - trace, 4 * root - 3 * trace
        for c, own in ((pairs, 2 * pairs), (-triples, -triples), (whole, None)):
            value *= root
            value += c
            if own is not None:
                slope *= root
                slope += own
        with np.errstate(all="ignore"):
            last, root = root, np.maximum(root - np.where(slope < 0, value / slope, 0.0), 0.0)
        if (np.abs(root - last) <= 1e-15 * trace).all():
            break
    zero, one, three = [g[0, 0] - root, g[0, 1], g[0, 2], g[0, 3]], [g[0, 1], g[1, 1] - root, g[1, 2], g[1, 3]], [g[0, 3], g[1, 3], g[2, 3], g[3, 3] - root]
    minor = {(i, j): zero[i] * one[j] - zero[j] * one[i] for i in range(4) for j in range(i + 1, 4)}
    out = []
    for left in range(4):
        i, j, m = (n for n in range(4) if n != left)
        own = three[i] * minor[j, m] - three[j] * minor[i, m] + three[m] * minor[i, j]
        out.append(own if left % 2 == 0 else -own)
    return out


def _motion_parts(m: np.ndarray, f: np.ndarray, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """B (n, k, 3, 3), t and v (n, k, 3), sound (n, k) of estimates (n, 3, 3) at focal lengths (n, k): the rotations that their
    essential matrices leave open are t v' + B and t v' - B, the directions t and -t.

    t and v span the left and right null space of E, and B = ([t]E + E[v]) / (s1 + s2) with the singular values s. Another
    focal length multiplies the first two rows and columns of E, which moves the null spaces in closed form, so one
    decomposition of an estimate does for all. Matrices of full rank are decomposed at each focal length.
    """
    middle = f[:, f.shape[1] // 2]
    base = essentials(m, middle, cx, cy)
    finite = np.isfinite(base).all((1, 2))
    base = np.where(finite[:, None, None], base, np.eye(3))
    # arrays of (3, 3, k, n) and (3, k, n), as which numbers of a focal length follow each other; read as told above
    near = np.ascontiguousarray((f / middle[:, None]).T)
    scale = np.stack([near, near, np.ones_like(near)])
    e = np.ascontiguousarray(base.transpose(1, 2, 0))[:, :, None] * scale[:, None] * scale
    norm = np.sqrt((e * e).sum((0, 1)))
    sound = (finite & np.isfinite(norm) & (norm >= 1e-10)).T
    u, s, vt = np.linalg.svd(base)
    same = np.linalg.det(u) * np.linalg.det(vt)  # of both bases, or of none, the turn is the right one
    unit = lambda x: x / np.sqrt((x * x).sum(0))
    t, v, b = unit(u[:, :, 2].T[:, None] / scale), unit((vt[:, 2] * same[:, None]).T[:, None] / scale), np.empty_like(e)
    for i in range(3):
        for j in range(3):
            i1, i2, j1, j2 = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
            b[i, j] = t[i1] * e[i2, j] - t[i2] * e[i1, j] + e[i, j1] * v[j2] - e[i, j2] * v[j1]
    with np.errstate(all="ignore"):
        b *= np.sqrt(2 / (b * b).sum((0, 1)))
    b, t, v, e = b.transpose(3, 2, 0, 1), t.T, v.T, e.transpose(3, 2, 0, 1)
    full = (s[:, 2] > 1e-12 * s[:, 1])[:, None] & sound
    u, _, vt = np.linalg.svd(e[full])
    b[full] = u[:, :, 1, None] * vt[:, None, 0] - u[:, :, 0, None] * vt[:, None, 1]
    t[full], v[full] = u[:, :, 2], vt[:, 2] * (np.linalg.det(u) * np.linalg.det(vt))[:, None]
    return b, t, v, sound


def _reprojection(m: np.ndarray, points: np.ndarray, sizes: np.ndarray, f: np.ndarray, cx: float, cy: float) -> np.ndarray:
    """(n, k): the mean squared reprojection error of both views at focal lengths (n, k), NaN where fewer than 5 points are in front.

    m are estimates (n, 3, 3), points the matches (p, 4) of all of them, one after the other, sizes (n) their numbers. For
    each focal length the motion with most matches in front is taken and the matches are triangulated with it: the direct
    linear solution, by the smallest eigenvector of its normal matrix. Estimates of about the same size are taken together,
    as columns of arrays whose rows are their points.
    """
    out, order = np.full(f.shape, np.nan), np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return out
    parts, starts = _motion_parts(m[order], f[order], cx, cy), np.cumsum(sizes) - sizes
    centred = np.ascontiguousarray((points - [cx, cy, cx, cy]).T)
    lo = 0
    while lo < len(order):
        # the largest estimate is the last one, so fewer are taken where that has more points
        hi = lo + max(1, POINTS_AT_ONCE // sizes[order[min(len(order), lo + POINTS_AT_ONCE // sizes[order[lo]]) - 1]] if sizes[order[lo]] <= POINTS_AT_ONCE else 1)
        own, hi = order[lo:hi], min(hi, len(order))
        place = np.arange(sizes[own[-1]])[:, None]
        there = place < sizes[own]
        seen = centred[:, np.where(there, starts[own] + place, starts[own])]
        for at in range(f.shape[1]):
            out[own, at] = _mean_error(seen / f[own, at], None if there.all() else there, *[np.ascontiguousarray(x[lo:hi, at].T) for x in parts[:3]])
        lo = hi
    out[order] *= np.where(parts[3], f[order] ** 2, np.nan)
    return out


def _mean_error(seen: np.ndarray, there: np.ndarray | None, b: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(n): mean squared errors of matches (4, p, n), in units of the focal length, for motions in parts: b' (3, 3, n), t and v (3, n)."""
    x0, y0, x1, y1 = seen
    real = (lambda flags: flags) if there is None else (lambda flags: flags & there)
    # depths of two rays in units of the same positive number, for the rotations t v' + b and t v' - b and the direction t
    w, s = v[0] * x0 + v[1] * y0 + v[2], t[0] * x1 + t[1] * y1 + t[2]
    turned = [b[0, i] * x0 + b[1, i] * y0 + b[2, i] for i in range(3)]
    met = turned[0] * x1 + turned[1] * y1 + turned[2]
    z0, z1, d0, d1 = w * (s * s - x1 * x1 - y1 * y1 - 1), s * (x0 * x0 + y0 * y0 + 1 - w * w), met * s, -met * w
    sides = []
    for a, c in ((z0 + d0, z1 + d1), (z0 - d0, z1 - d1)):
        p, q = a > 0, c > 0
        sides += [real(p & q).sum(0), real((a < 0) & (c < 0)).sum(0)]
    best = np.argmax(np.stack(sides), axis=0)  # of equal ones the first
    turn, d = np.where(best < 2, 1.0, -1.0), np.where(best % 2 == 0, 1.0, -1.0) * t
    q = [[t[i] * v[j] + turn * b[j, i] for j in range(3)] for i in range(3)]
    # rows (-1, 0, x0, 0), (0, -1, y0, 0), h and k; the focal length is a factor of all of them
    h = [x1 * q[2][i] - q[0][i] for i in range(3)] + [x1 * d[2] - d[0]]
    k = [y1 * q[2][i] - q[1][i] for i in range(3)] + [y1 * d[2] - d[1]]
    x, y, z, one = _last_direction(x0, y0, h, k)
    with np.errstate(all="ignore"):
        length = 1 / np.sqrt(x * x + y * y + z * z + one * one)
        ahead = real(z * length / (one * length + 1e-12) > 0)
        other = [q[i][0] * x + q[i][1] * y + q[i][2] * z + d[i] * one for i in range(3)]
        near, far = 1 / z, 1 / other[2]
        error = (x * near - x0) ** 2 + (y * near - y0) ** 2 + (other[0] * far - x1) ** 2 + (other[1] * far - y1) ** 2
        n = ahead.sum(0)
        return np.where(n >= 5, np.where(ahead, error, 0).sum(0) / (2 * n), np.nan)


def bundle_scan(estimates: DataFrame, matches: DataFrame, focal: DataFrame, width: int, height: int, tolerance: float = 1e-3) -> DataFrame:
    """(session, f, cost): the focal length near (session, f) with the least mean reprojection error of the estimates.

    Each round tries 21 values of log f around the best so far, the first within 0.5 of it, the next ones a tenth as far
    apart, until they are less than the tolerance apart. An estimate's matches are those of one pair of frames, so they are
    gathered in one row; they are shuffled once and written, not once a round: focal lengths, a number for each session, are
    sent to the estimates where they are up to SESSIONS_SENT. Sessions in which no estimate can be triangulated keep f, with a cost
    of 1e6.
    """
    return _bundle(gathered(estimates, matches), focal, width, height, tolerance)


def _bundle(rows: DataFrame, focal: DataFrame, width: int, height: int, tolerance: float = 1e-3) -> DataFrame:
    pairs = rows.where("points IS NOT NULL").select("session", "m", "points")
    best, step = cut(focal.select("session", "f"), "bundle-start"), 0.05
    cx, cy, offsets = width / 2, height / 2, np.arange(-10, 11)

    def errors(batches, step):
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                m, points = (np.asarray(part[c].flatten(), dtype=float) for c in ("m", "points"))
                sizes, f = np.diff(np.asarray(part["points"].offsets)) // 4, np.asarray(part["f"], dtype=float)
                tried = _reprojection(m.reshape(-1, 3, 3), points.reshape(-1, 4), sizes, f[:, None] * np.exp(offsets * step), cx, cy)
                ends = pa.array(np.arange(len(tried) + 1) * len(offsets), pa.int32())
                yield pa.RecordBatch.from_arrays([part["session"], pa.ListArray.from_arrays(ends, pa.array(tried.ravel(), from_pandas=True))], ["session", "errors"])

    while True:
        own = best.select("session", "f")
        sent = F.broadcast(own) if own.count() <= SESSIONS_SENT else own
        tried = pairs.join(sent, "session").mapInArrow(lambda b, step=step: errors(b, step), "session bigint, errors array<double>")
        # a row for each session and task, with all sums, not one for each of the focal lengths
        costs = tried.groupBy("session").agg(*[F.coalesce(F.avg(F.get("errors", F.lit(n))), F.lit(1e6)).alias(f"c{n}") for n in range(len(offsets))])
        ranked = [F.struct(F.col(f"c{n}").alias("cost"), F.lit(abs(n - 10)).alias("away"), F.lit(n).alias("pos")) for n in range(len(offsets))]
        least = costs.select("session", F.array_min(F.array(*ranked)).alias("m"))
        found = best.select("session", "f").join(least, "session", "left")
        found = found.select("session", (F.col("f") * F.exp(F.coalesce(F.col("m.pos") - 10, F.lit(0)) * step)).alias("f"), F.coalesce("m.cost", F.lit(1e6)).alias("cost"))
        if step < tolerance:
            return found
        best, step = cut(found, "bundle-round"), step / 10


def run_focal_estimation(estimates: DataFrame, matches: DataFrame, width: int, height: int, arena: tuple[float, float, float] | None = None, bundle: bool = False, steps: int = 300, tolerance: float = 0.1) -> DataFrame:
    """(session, f, f_scan, f_metric, scale, n_estimates, residual): the whole self-calibration, a row for each session.

    The refined scan, then the arena's correction and the search by reprojection error where asked for, and the mean
    essential residual at the final focal length. f_metric and scale are null without an arena.
    """
    rows = None if matches is None else gathered(estimates, matches)
    send = rows is not None and rows.where("place = 1").count() <= SESSIONS_SENT
    scanned = cut(focal_refine(estimates, width, height, steps, tolerance, send).select("session", "f"), "focal")
    out = scanned.select("session", F.col("f").alias("f_scan"))
    final = scanned
    if arena is None:
        out = out.withColumns({n: F.lit(None).cast("double") for n in ("f_metric", "scale")})
    else:
        metric = cut(_metric(rows, scanned, arena, width, height), "metric")
        out = out.join(metric.select("session", "f_metric", "scale"), "session")
        final = metric.select("session", F.col("f_metric").alias("f"))
    if bundle:
        final = cut(_bundle(rows, final, width, height).select("session", "f"), "bundled")
    counted = estimates.groupBy("session").agg(F.count(F.lit(1)).alias("n_estimates"))
    out = out.join(counted, "session").join(mean_essential_residual(estimates, final, width, height, send), "session")
    return out.select("session", "f", "f_scan", "f_metric", "scale", "n_estimates", "residual")
