"""Pixel tables: background models, morphology, blobs and silhouettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

FRAME = ["session", "camera", "frame_idx"]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel of odd size: each row as wide as the ellipse there."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = int(round(r * (max(r * r - dy * dy, 0) ** 0.5) / r)) if r else 0
        out += [(dx, dy) for dx in range(-half, half + 1)]
    return out


def background(pixels: DataFrame, history: int = 300, threshold: float = 40.0, floor: float = 4.0) -> DataFrame:
    """Adds foreground: squared deviation from the mean of the preceding frames above threshold times their variance.

    One Gaussian a pixel over a sliding window stands for the mixture model; without a past a pixel is background.
    """
    past = Window.partitionBy("session", "camera", "x", "y").orderBy("frame_idx").rowsBetween(-history, -1)
    mean, var = F.avg("v").over(past), F.greatest(F.var_pop("v").over(past), F.lit(floor))
    return pixels.withColumns({"mean": mean, "var": var}).withColumn("foreground", F.coalesce((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")) > threshold * F.col("var"), F.lit(False)))


def _moved(frames: np.ndarray, dx: int, dy: int, fill: bool) -> np.ndarray:
    """Pixels (n, h, w) read at (x + dx, y + dy), `fill` beyond the image."""
    h, w = frames.shape[1:]
    out = np.full_like(frames, fill)
    out[:, max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = frames[:, max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def morph(frames: np.ndarray, steps: tuple[str, ...], kernel: list[tuple[int, int]]) -> np.ndarray:
    """Dilations and erosions of images (n, h, w), an array operation for each offset of the kernel.

    Beyond the border nothing is set for a dilation and nothing is missing for an erosion.
    """
    for step in steps:
        grow = step == "dilate"
        out = np.full_like(frames, not grow)
        for dx, dy in kernel:
            if abs(dx) < frames.shape[2] and abs(dy) < frames.shape[1]:
                out = out | _moved(frames, -dx, -dy, False) if grow else out & _moved(frames, dx, dy, True)
        frames = out
    return frames


def _morphed(mask: DataFrame, steps: tuple[str, ...], kernel: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Dilations and erosions of frames, one after the other, of a shuffle by frame: a frame's pixels are one bounded array.

    Blocks of frames are bitmaps, see `morph`.
    """

    def run(cells: pa.Array) -> pa.Array:
        found, sizes = [], []
        per = max(1, (1 << 22) // (width * height))
        for lo in range(0, len(cells), per):
            part = cells.slice(lo, per)
            counts = np.asarray(pc.list_value_length(part)).astype(np.int64)
            frames = np.zeros((len(part), height * width), dtype=bool)
            frames[np.repeat(np.arange(len(part)), counts), np.asarray(part.flatten())] = True
            frames = morph(frames.reshape(-1, height, width), steps, kernel)
            row, at = np.nonzero(frames.reshape(len(part), -1))
            found.append(at.astype(np.int32))
            sizes.append(np.bincount(row, minlength=len(part)))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else [0]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))

    inside = mask.where(f"px >= 0 AND px < {width} AND py >= 0 AND py < {height}")
    packed = inside.groupBy(*FRAME).agg(F.collect_set((F.col("py") * width + F.col("px")).cast("int")).alias("cells"))
    out = packed.select(*FRAME, F.explode(F.arrow_udf(run, "array<int>")("cells")).alias("cell"))
    return out.select(*FRAME, (F.col("cell") % width).alias("px"), F.expr(f"cell div {width}").cast("int").alias("py"))


def dilate(mask: DataFrame, kernel: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    return _morphed(mask, ("dilate",), kernel, width, height)


def erode(mask: DataFrame, kernel: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Pixels of which all neighbours under the kernel that lie in the image are set; pixels beyond the border don't count."""
    return _morphed(mask, ("erode",), kernel, width, height)


def close(mask: DataFrame, kernel: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    return _morphed(mask, ("dilate", "erode"), kernel, width, height)


def open_(mask: DataFrame, kernel: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    return _morphed(mask, ("erode", "dilate"), kernel, width, height)


def _runs(rows: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first x, last x, run of each pixel) of pixels sorted by row and x: maximal runs of neighbours in a row."""
    fresh = np.ones(len(xs), dtype=bool)
    fresh[1:] = (np.diff(rows) != 0) | (np.diff(xs) != 1)
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], len(xs)) - 1
    return rows[start], xs[start], xs[stop], np.cumsum(fresh) - 1


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components under edges (a, b): unions of arrays, halving paths in between."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def label_runs(rows: np.ndarray, xs: np.ndarray, reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(label of each pixel, runs' labels) of pixels sorted by row and x; a label is the least run of a component.

    Runs of neighbouring rows touch where they overlap, with reach 1 also at corners (8-connected), with 0 not (4-connected).
    Several images go in one call if their row numbers are more than one apart.
    """
    if not len(xs):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row, first, last, of = _runs(rows, xs)
    low = xs.min() - 1
    span = int(xs.max() - low) + 2
    starts, stops = row * span + first - low, row * span + last - low
    lo = np.searchsorted(stops, (row + 1) * span + first - low - reach, side="left")
    hi = np.searchsorted(starts, (row + 1) * span + last - low + reach, side="right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    root = joined(len(row), a, b)
    return root[of], root


def holes(ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Background pixels (y, x) that a blob encloses: those a 4-connected walk from outside its box doesn't reach."""
    y0, x0 = ys.min() - 1, xs.min() - 1
    free = np.ones((ys.max() - y0 + 2, xs.max() - x0 + 2), dtype=bool)
    free[ys - y0, xs - x0] = False
    y, x = np.nonzero(free)
    label, _ = label_runs(y, x, reach=0)
    inside = label != label[0]
    return y[inside] + y0, x[inside] + x0


def label_blobs(mask: DataFrame, min_area: int = 1, fill: bool = False, tile: int | None = None) -> DataFrame:
    """(session, camera, frame_idx, px, py, blob, area): 8-connected blobs of at least min_area pixels, with holes filled if asked.

    Pixels of a row that touch are runs, runs of neighbouring rows that touch are united, all in arrays and for many frames
    at a time. A blob is numbered by its first pixel in row order. The foreground of a frame is one row; with tile (pixels a
    side) it is one row for each tile instead, so that images may exceed a task, and labels are merged across the borders.
    """
    if tile:
        if fill:
            raise ValueError("holes are filled in whole images only")
        return _tiled_blobs(mask, min_area, tile)
    frames = mask.groupBy(*FRAME).agg(F.sort_array(F.collect_set(F.struct("py", "px"))).alias("p"))
    kind = pa.struct([("px", pa.int32()), ("py", pa.int32()), ("blob", pa.int64()), ("area", pa.int64())])

    def run(ys: pa.Array, xs: pa.Array) -> pa.Array:
        y, x = (np.asarray(v.flatten()).astype(np.int64) for v in (ys, xs))
        counts = np.asarray(pc.list_value_length(ys)).astype(np.int64)
        frame = np.repeat(np.arange(len(counts)), counts)
        if not len(y):
            return pa.array([[] for _ in counts], pa.list_(kind))
        height = int(y.max() - y.min()) + 3
        label, _ = label_runs(frame * height + y - y.min(), x)
        # blobs in order of their frames and first pixels
        _, blob, area = np.unique(label, return_inverse=True, return_counts=True)
        keep = area[blob] >= min_area
        frame, y, x, blob = frame[keep], y[keep], x[keep], blob[keep]
        if fill and len(blob):
            order = np.argsort(blob, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(blob[order])) + 1)
            more = [(holes(y[own], x[own]), own[0]) for own in parts]
            sizes = [len(h[0]) for h, _ in more]
            at = np.repeat([k for _, k in more], sizes)
            y, x = (np.concatenate([v, *[h[side] for h, _ in more]]) for side, v in enumerate((y, x)))
            frame, blob = np.concatenate([frame, frame[at]]), np.concatenate([blob, blob[at]])
        order = np.lexsort([x, y, blob])
        frame, y, x, blob = frame[order], y[order], x[order], blob[order]
        _, number, area = np.unique(blob, return_inverse=True, return_counts=True)
        area = area[number] if len(number) else area
        first = np.searchsorted(frame, np.arange(len(counts) + 1))
        number = number - np.append(number, 0)[first[:-1]].repeat(np.diff(first))
        values = pa.StructArray.from_arrays([pa.array(v, t.type) for v, t in zip((x, y, number, area), kind)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)

    labelled = F.arrow_udf(run, "array<struct<px: int, py: int, blob: bigint, area: bigint>>")
    return frames.select(*FRAME, F.explode(labelled(F.col("p.py"), F.col("p.px"))).alias("b")).select(*FRAME, "b.*")


def _tiled_blobs(mask: DataFrame, min_area: int, tile: int) -> DataFrame:
    """label_blobs of images cut into tiles: blobs of each tile, then components of what touches across borders."""
    own = [F.floor(F.col(v) / tile).cast("int").alias(t) for v, t in (("px", "tx"), ("py", "ty"))]
    cells = mask.select(*FRAME, "px", "py").distinct().select(*FRAME, "px", "py", *own)
    tiles = cells.groupBy(*FRAME, "tx", "ty").agg(F.sort_array(F.collect_list(F.struct("py", "px"))).alias("p"))

    def run(ys: pa.Array, xs: pa.Array) -> pa.Array:
        y, x = (np.asarray(v.flatten()).astype(np.int64) for v in (ys, xs))
        counts = np.asarray(pc.list_value_length(ys)).astype(np.int64)
        part = np.repeat(np.arange(len(counts)), counts)
        label, _ = label_runs(part * (tile + 2) + y % tile, x % tile)
        # a blob of a tile is named by its first pixel
        _, first, number = np.unique(label, return_index=True, return_inverse=True)
        kind = pa.struct([("px", pa.int32()), ("py", pa.int32()), ("ny", pa.int32()), ("nx", pa.int32())])
        values = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (x, y, y[first][number], x[first][number])], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    local = F.arrow_udf(run, "array<struct<px: int, py: int, ny: int, nx: int>>")
    rows = cut(tiles.select(*FRAME, "tx", "ty", F.explode(local(F.col("p.py"), F.col("p.px"))).alias("b")).select(*FRAME, "tx", "ty", "b.px", "b.py", F.struct("b.ny", "b.nx").alias("node")), "tile-blobs")
    edge = rows.where(" OR ".join(f"pmod({v}, {tile}) IN (0, {tile - 1})" for v in ("px", "py")))
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    asked = edge.select(*FRAME, F.col("node").alias("a"), "px", "py", "tx", "ty", F.explode(ahead).alias("d")).select(*FRAME, "a", (F.col("px") + F.col("d.dx")).alias("px"), (F.col("py") + F.col("d.dy")).alias("py"), F.col("tx").alias("ax"), F.col("ty").alias("ay"))
    touching = asked.join(edge, [*FRAME, "px", "py"]).where("tx <> ax OR ty <> ay").select(*FRAME, "a", F.col("node").alias("b")).distinct()

    def merge(pairs: pd.DataFrame) -> pd.DataFrame:
        names = sorted({tuple(v) for c in ("ay", "by") for v in zip(pairs[c], pairs["ax" if c == "ay" else "bx"])})
        number = {name: k for k, name in enumerate(names)}
        a, b = (np.array([number[v] for v in zip(pairs[y], pairs[x])]) for y, x in (("ay", "ax"), ("by", "bx")))
        root = joined(len(names), a, b)
        to = [names[r] for r in root]
        return pd.DataFrame({**{k: pairs[k].iloc[0] for k in FRAME}, "ny": [n[0] for n in names], "nx": [n[1] for n in names], "ry": [t[0] for t in to], "rx": [t[1] for t in to]})

    kinds = dict(mask.dtypes)
    flat = touching.select(*FRAME, *[F.col(f"{n}.n{v}").alias(f"{n}{v}") for n in "ab" for v in "yx"])
    roots = flat.groupBy(*FRAME).applyInPandas(merge, ", ".join([*[f"{k} {kinds[k]}" for k in FRAME], "ny int, nx int, ry int, rx int"]))
    roots = roots.select(*FRAME, F.struct("ny", "nx").alias("node"), F.struct(F.col("ry").alias("ny"), F.col("rx").alias("nx")).alias("root"))
    nodes = rows.groupBy(*FRAME, "node").agg(F.count(F.lit(1)).alias("pixels")).join(roots, [*FRAME, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    whole = nodes.groupBy(*FRAME, "root").agg(F.sum("pixels").alias("area")).where(F.col("area") >= min_area)
    whole = whole.withColumn("blob", F.row_number().over(Window.partitionBy(*FRAME).orderBy("root")).cast("long") - 1)
    named = nodes.select(*FRAME, "node", "root").join(whole, [*FRAME, "root"]).select(*FRAME, "node", "blob", "area")
    return rows.join(named, [*FRAME, "node"]).select(*FRAME, "px", "py", "blob", "area")


def largest_blob(blobs: DataFrame, min_area: int = 400) -> DataFrame:
    best = blobs.where(F.col("area") >= min_area).groupBy(*FRAME).agg(F.max(F.struct("area", (-F.col("blob")).alias("b"))).alias("m")).select(*FRAME, (-F.col("m.b")).alias("blob"))
    return blobs.join(best, [*FRAME, "blob"])


def moments(mask: DataFrame) -> DataFrame:
    """(session, camera, frame_idx, area, cx, cy, hx, hy, tx, ty): centroid, and ends of the major axis of the moment ellipse.

    Head and tail are null for fewer than five pixels; which end is the head is not known.
    """
    sums = mask.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("area"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.var_pop("px").alias("sx"), F.var_pop("py").alias("sy"), F.covar_pop("px", "py").alias("sxy"))
    big = ((F.col("sx") + F.col("sy")) + F.sqrt((F.col("sx") - F.col("sy")) * (F.col("sx") - F.col("sy")) + 4 * F.col("sxy") * F.col("sxy"))) / 2
    angle = 0.5 * F.atan2(2 * F.col("sxy"), F.col("sx") - F.col("sy"))
    half = 2 * F.sqrt(big)
    dx, dy = half * F.cos(angle), half * F.sin(angle)
    enough = F.col("area") >= 5
    ends = {"hx": F.col("cx") + dx, "hy": F.col("cy") + dy, "tx": F.col("cx") - dx, "ty": F.col("cy") - dy}
    return sums.select(*FRAME, "area", "cx", "cy", *[F.when(enough, v).alias(k) for k, v in ends.items()])


def silhouettes(pixels: DataFrame, width: int, height: int, ksize: int = 7, min_area: int = 500, grow: int = 3, **model) -> DataFrame:
    """Foreground of pixel series, closed, opened, without small blobs, holes filled, grown."""
    raw = background(pixels, **model).where("foreground").select(*FRAME, F.col("x").alias("px"), F.col("y").alias("py"))
    kernel = ellipse(ksize)
    clean = open_(close(raw, kernel, width, height), kernel, width, height)
    return dilate(label_blobs(clean, min_area, fill=True).select(*FRAME, "px", "py"), ellipse(2 * grow + 1), width, height)


def centroid_detector(pixels: DataFrame, width: int, height: int, ksize: int = 7, min_area: int = 400, **model) -> DataFrame:
    """(session, camera, frame_idx, name, px, py, confidence) of the largest moving blob of each frame."""
    raw = background(pixels, **model).where("foreground").select(*FRAME, F.col("x").alias("px"), F.col("y").alias("py"))
    kernel = ellipse(ksize)
    blob = largest_blob(label_blobs(open_(close(raw, kernel, width, height), kernel, width, height)), min_area)
    found = moments(blob.select(*FRAME, "px", "py"))
    points = F.array(*[F.struct(F.lit(n).alias("name"), F.col(x).alias("px"), F.col(y).alias("py"), F.lit(c).alias("confidence")) for n, x, y, c in (("centroid", "cx", "cy", 1.0), ("head", "hx", "hy", 0.75), ("tail", "tx", "ty", 0.75))])
    return found.select(*FRAME, F.explode(points).alias("k")).select(*FRAME, "k.*").where("px IS NOT NULL")


def normalize_depth(pixels: DataFrame, low: float = 0.001, high: float = 0.999, top: float = 65535.0, kind: str = "unsigned") -> DataFrame:
    """Adds v8: values as 8 bits by the rule for their type, clipped and truncated.

    `byte` values stay as they are. `unsigned` ones of more bits are scaled from the percentiles of their stream's first and
    last frame, up to the type's greatest value `top` where the upper percentile isn't above the lower. `float` values go
    from 0 to 1. A range below 1 counts as 1.
    """
    if kind not in ("byte", "unsigned", "float"):
        raise ValueError(f"no rule for {kind} values")
    clipped = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)).cast("int")
    if kind != "unsigned":
        return pixels.withColumn("v8", F.col("v").cast("int") if kind == "byte" else clipped(F.col("v") * 255))
    ends = pixels.groupBy("session", "camera").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    sample = pixels.join(ends, ["session", "camera"]).where("frame_idx = a OR frame_idx = b")
    span = sample.groupBy("session", "camera").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p"))
    a, b = F.col("p")[0], F.when(F.col("p")[1] > F.col("p")[0], F.col("p")[1]).otherwise(top)
    return pixels.join(span, ["session", "camera"]).withColumn("v8", clipped((F.col("v") - a) / F.greatest(b - a, F.lit(1.0)) * 255)).drop("p")


def remap(pixels: DataFrame, maps: DataFrame) -> DataFrame:
    """(session, camera, frame_idx, ox, oy, v): output pixels (ox, oy) read bilinearly at (sx, sy); 0 beyond the image.

    Every frame has every output pixel of its camera's map; those that read nothing are 0.
    """
    x0, y0 = F.floor("sx"), F.floor("sy")
    wx, wy = F.col("sx") - x0, F.col("sy") - y0
    parts = F.array(*[F.struct((x0 + a).cast("int").alias("x"), (y0 + b).cast("int").alias("y"), ((wx if a else 1 - wx) * (wy if b else 1 - wy)).alias("w")) for a in (0, 1) for b in (0, 1)])
    wanted = maps.select("camera", "ox", "oy", F.explode(parts).alias("s")).select("camera", "ox", "oy", "s.*").where("w > 0")
    read = pixels.join(wanted, ["camera", "x", "y"]).select(*FRAME, "ox", "oy", (F.col("w") * F.col("v")).alias("v"))
    black = pixels.select(*FRAME).distinct().join(maps.select("camera", "ox", "oy"), "camera").select(*FRAME, "ox", "oy", F.lit(0.0).alias("v"))
    return read.unionByName(black).groupBy(*FRAME, "ox", "oy").agg(F.sum("v").alias("v"))
