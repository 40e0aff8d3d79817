"""Projective geometry as column expressions: plain arithmetic that stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list]
#: A 3x4 matrix for all rows, or the column that holds each row's as twelve numbers.
Camera = str | Matrix
BEHIND = -1e9


def c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def total(terms) -> Column:
    """Sum of columns in order."""
    out = None
    for t in terms:
        out = t if out is None else out + t
    return out


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return [[total(c(a[i][k]) * c(b[k][j]) for k in range(len(b))) for j in range(len(b[0]))] for i in range(len(a))]


def transpose(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a)]


def columns(prefix: str) -> Matrix:
    """The 3x3 matrix in nine columns prefix00 .. prefix22."""
    return [[F.col(f"{prefix}{i}{j}") for j in range(3)] for i in range(3)]


def from_array(name: str, rows: int, cols: int) -> Matrix:
    """A matrix in an array column, row by row."""
    return [[F.col(name)[i * cols + j] for j in range(cols)] for i in range(rows)]


def intrinsics(f, cx, cy) -> Matrix:
    return [[f, 0.0, cx], [0.0, f, cy], [0.0, 0.0, 1.0]]


def camera(p: Camera) -> Matrix:
    return from_array(p, 3, 4) if isinstance(p, str) else p


def project(p: Camera, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a point under a 3x4 matrix; points at or behind the camera get a pixel that is in no image."""
    u, v, w = (c(r[0]) * x + c(r[1]) * y + c(r[2]) * z + c(r[3]) for r in camera(p))
    return F.when(w <= 0, BEHIND).otherwise(u / w), F.when(w <= 0, BEHIND).otherwise(v / w), w


def in_image(px: Column, py: Column, width: int, height: int) -> Column:
    return (px >= 0) & (px < width) & (py >= 0) & (py < height)


def pixel(value: Column, size: int) -> Column:
    """Rounded half to even, then clipped into the image."""
    return F.greatest(F.least(F.rint(value), F.lit(float(size - 1))), F.lit(0.0)).cast("int")


def reprojection_error(p: Camera, x: Column, y: Column, z: Column, px: Column, py: Column) -> Column:
    u, v, w = (c(r[0]) * x + c(r[1]) * y + c(r[2]) * z + c(r[3]) for r in camera(p))
    return F.sqrt((u / w - px) * (u / w - px) + (v / w - py) * (v / w - py))


def keep_error(err: Column, most: float) -> Column:
    """An error that isn't a number can't exceed a limit, so it is kept."""
    return F.isnan(err) | (err <= most)


def _line(m: Matrix, x: Column, y: Column) -> list[Column]:
    return [c(r[0]) * x + c(r[1]) * y + c(r[2]) for r in m]


def sampson(f: Matrix, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """First-order squared distance of a match to the epipolar constraint; 0 where its scale vanishes."""
    a, b = _line(f, x0, y0), _line(transpose(f), x1, y1)
    inner = x1 * a[0] + y1 * a[1] + a[2]
    scale = a[0] * a[0] + a[1] * a[1] + b[0] * b[0] + b[1] * b[1]
    return F.when(scale > 1e-12, inner * inner / scale).otherwise(0.0)


def epipolar_distance(f: Matrix, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Mean of the distances of both points to the line of the other."""
    a, b = _line(f, x0, y0), _line(transpose(f), x1, y1)
    d1 = F.abs(x1 * a[0] + y1 * a[1] + a[2]) / F.sqrt(a[0] * a[0] + a[1] * a[1])
    d0 = F.abs(x0 * b[0] + y0 * b[1] + b[2]) / F.sqrt(b[0] * b[0] + b[1] * b[1])
    return (d0 + d1) / 2


def norm(m: Matrix) -> Column:
    return F.sqrt(total(v * v for r in m for v in r))


def estimate_quality(n_inliers: Column, ratio: Column, mean_sampson: Column) -> Column:
    return 0.35 * F.least(n_inliers / 300.0, F.lit(1.0)) + 0.35 * ratio + 0.30 * F.exp(-mean_sampson / 0.5)


def fov_degrees(diagonal, f: Column) -> Column:
    return F.degrees(2 * F.atan(c(diagonal) / (2 * f)))


def undistort_radial(x: Column, y: Column, cx, cy, f, k1, k2, k3, rounds: int = 8) -> tuple[Column, Column]:
    """Undistorted pixel by fixed-point rounds, each from the distorted point.

    A round only shortens or lengthens the ray of the distorted point, so the state is one factor.
    """
    xd, yd = (x - c(cx)) / c(f), (y - c(cy)) / c(f)
    square = xd * xd + yd * yd

    def step(t: Column, _: Column) -> Column:
        r2 = square * t * t
        return 1 / (1 + c(k1) * r2 + c(k2) * r2 * r2 + c(k3) * r2 * r2 * r2)

    t = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(1.0), step)
    return xd * t * c(f) + c(cx), yd * t * c(f) + c(cy)


def rotation(rx, ry, rz) -> Matrix:
    """Rotation matrix of a rotation vector; the identity for a vanishing one."""
    rx, ry, rz = c(rx), c(ry), c(rz)
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    tiny = angle < 1e-12
    n = [F.when(tiny, 0.0).otherwise(v / angle) for v in (rx, ry, rz)]
    cos, sin = F.cos(angle), F.sin(angle)
    cross = [[F.lit(0.0), -n[2], n[1]], [n[2], F.lit(0.0), -n[0]], [-n[1], n[0], F.lit(0.0)]]
    return [[(cos if i == j else F.lit(0.0)) + (1 - cos) * n[i] * n[j] + sin * cross[i][j] for j in range(3)] for i in range(3)]


def rigid(r: Matrix, t: list, x: Column, y: Column, z: Column) -> list[Column]:
    """r p + t; a point with any coordinate that is not a number passes as not a number."""
    odd = F.isnan(x) | F.isnan(y) | F.isnan(z)
    return [F.when(odd, F.lit(float("nan"))).otherwise(c(row[0]) * x + c(row[1]) * y + c(row[2]) * z + c(s)) for row, s in zip(r, t)]


def project_distorted(x: Column, y: Column, z: Column, rvec: tuple, t: tuple, fx, fy, cx, cy, k1, k2, k3) -> tuple[Column, Column]:
    """Pixel of a point in arena coordinates under a posed camera with radial distortion."""
    px, py, pz = rigid(rotation(*rvec), list(t), x, y, z)
    u, v = px / pz, py / pz
    r2 = u * u + v * v
    scale = 1 + c(k1) * r2 + c(k2) * r2 * r2 + c(k3) * r2 * r2 * r2
    return u * scale * c(fx) + c(cx), v * scale * c(fy) + c(cy)


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight) up to four sigmas."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k - radius, w / sum(weights)) for k, w in enumerate(weights)]


def reflected(j: Column, n: Column) -> Column:
    """Index in [0, n) of any index under half-sample mirror edges."""
    m = F.pmod(j, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def voxel_center(i: Column, size, origin) -> Column:
    return (i + 0.5) * c(size) + c(origin)


def voxel_index(x: Column, size, origin) -> Column:
    """The cell that holds a coordinate: the inverse of voxel_center."""
    return F.floor((x - c(origin)) / c(size)).cast("int")
