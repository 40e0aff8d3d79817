"""Frames as bits: packed masks, carving by each session's rig, and stencils on packed voxel grids.

A frame's masks are a bitmap a camera, a frame's voxels one bitmap in flat order (i * ny + j) * nz + k. Foreground pixels are
shuffled once, by frame; everything after that stays in the stage: the pixel of every cell under a rig is computed once a
rig and task and looked up for each of its frames, and neighbours are read by shifting the grid instead of by exploding
cells and joining them. A task holds some frames at a time, so neither the length of a session nor its share of the frames
matters. Images and grids are bounded by their sizes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import morph

#: Cells in memory at once in a task; a few arrays of them are held side by side.
AT_ONCE = 1 << 20
RIGS_KEPT = 8
#: Frames that a task packs or carves and hands on at once.
FRAMES_AT_ONCE = 512


def dims(bounds: tuple, size: float) -> tuple[int, int, int]:
    return tuple(max(1, math.ceil((hi - lo) / size)) for lo, hi in bounds)


def _bits(row: np.ndarray, at: np.ndarray, n: int, bits: int) -> list[bytes]:
    """n bitmaps of so many bits, those at places `at` of the bitmaps `row` set."""
    out = np.zeros((n, bits), dtype=np.uint8)
    out[row, at] = 1
    return [own.tobytes() for own in np.packbits(out, axis=1)]


def _bitmaps(bits: int, place: Callable = lambda values: (slice(None), np.asarray(values))) -> Callable[[pa.Array], pa.Array]:
    """Lists to bitmaps of so many bits: place gives which of their values count, and the positions of these."""

    def run(lists: pa.Array) -> pa.Array:
        out, step = [], max(1, AT_ONCE // bits)
        for lo in range(0, len(lists), step):
            part = lists.slice(lo, step)
            row = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets)))
            kept, at = place(part.flatten())
            out += _bits(row[kept], at, len(part), bits)
        return pa.array(out, pa.binary())

    return run


def _in_pieces(rows: DataFrame, key: list[str], made: str, fn: Callable, *columns: str) -> DataFrame:
    """(key, made): fn gives the columns of the schema `made` for arrays of the given ones, for some frames at a time, so
    that a task's memory doesn't follow how full its batches are."""
    kinds, names = dict(rows.dtypes), [*key, *[c.split()[0] for c in made.split(", ")]]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FRAMES_AT_ONCE):
                part = batch.slice(lo, FRAMES_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*[part[k] for k in key], *fn(*[part[c] for c in columns])], names)

    return rows.select(*key, *columns).mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in key], made]))


def _packed(positions: Column, bits: int) -> Column:
    return F.arrow_udf(_bitmaps(bits), "binary")(positions)


def pack_masks(mask: DataFrame, width: int, height: int, views: int = 2) -> DataFrame:
    """(session, frame_idx, m0, m1 ...): a bitmap of each camera's foreground pixels; none is an empty one.

    mask: pixels (session, camera, frame_idx, px, py), or a row for each frame with lists m0, m1 ... of its (px, py).
    """
    key, names = ["session", "frame_idx"], [f"m{k}" for k in range(views)]
    made = ", ".join(f"{m} binary" for m in names)
    if "px" in mask.columns:
        inside = mask.where(f"px >= 0 AND px < {width} AND py >= 0 AND py < {height}")
        at = (F.col("py") * width + F.col("px")).cast("int")
        frames = inside.groupBy(*key).agg(*[F.collect_set(F.when(F.col("camera") == k, at)).alias(m) for k, m in enumerate(names)])
        pack = _bitmaps(width * height)
    else:
        frames, pack = mask, _bitmaps(width * height, lambda pixels: _inside(pixels, width, height))
    return _in_pieces(frames, key, made, lambda *lists: map(pack, lists), *names)


def _inside(pixels: pa.StructArray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pixels (px, py) are in the image, and their positions there."""
    px, py = (np.asarray(pixels.field(v)) for v in ("px", "py"))
    kept = (px >= 0) & (px < width) & (py >= 0) & (py < height)
    return kept, py[kept] * width + px[kept]


def grow(packed: DataFrame, kernel: list[tuple[int, int]], width: int, height: int, views: int = 2) -> DataFrame:
    """Packed masks (session, frame_idx, m0, m1 ...) dilated by the offsets of a kernel."""

    def run(*bitmaps: pa.Array) -> list[pa.Array]:
        out, step = [], max(1, AT_ONCE // (width * height))
        for lists in bitmaps:
            done = []
            for lo in range(0, len(lists), step):
                part = lists.slice(lo, step)
                bits = np.frombuffer(b"".join(part.to_pylist()), dtype=np.uint8).reshape(len(part), -1)
                grown = morph(np.unpackbits(bits, axis=1, count=width * height).view(bool).reshape(-1, height, width), ("dilate",), kernel)
                done += [row.tobytes() for row in np.packbits(grown.reshape(len(part), -1), axis=1)]
            out.append(pa.array(done, pa.binary()))
        return out

    names = [f"m{k}" for k in range(views)]
    return _in_pieces(packed, ["session", "frame_idx"], ", ".join(f"{m} binary" for m in names), run, *names)


def pack_voxels(voxels: DataFrame, key: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(key, grid) of occupied cells (key, i, j, k)."""
    nx, ny, nz = shape
    flat = ((F.col("i") * ny + F.col("j")) * nz + F.col("k")).cast("int")
    return voxels.groupBy(*key).agg(F.collect_set(flat).alias("cells")).select(*key, _packed(F.col("cells"), nx * ny * nz).alias("grid"))


def cell_pixels(p: np.ndarray, bounds: tuple, size: float, width: int, height: int) -> np.ndarray:
    """The pixel (row by row) of each cell of a box under a 3x4 matrix, width * height where it is in no image."""
    x, y, z = np.meshgrid(*[(np.arange(n) + 0.5) * size + lo for n, (lo, _) in zip(dims(bounds, size), bounds)], indexing="ij", copy=False)
    u, v, w = (r[0] * x + r[1] * y + r[2] * z + r[3] for r in np.asarray(p, dtype=float).reshape(3, 4))
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = u / w, v / w
        seen = (w > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    px, py = (np.clip(np.rint(np.where(seen, t, 0)), 0, n - 1).astype(np.int64) for t, n in ((u, width), (v, height)))
    return np.where(seen, py * width + px, width * height).ravel()


def carve(frames: DataFrame, cameras: DataFrame | list, bounds: tuple, size: float, width: int, height: int) -> DataFrame:
    """(session, frame_idx, grid): of each frame the cells whose pixel is foreground in both views; frames without such cells go.

    Of a rig the cells behind each pixel of the first view are listed once, so a frame costs what its foreground covers.
    cameras: two 3x4 matrices for all sessions, or (session, camera, p) with each session's own; sessions without both
    cameras have no hull. Cells of any number may look at one pixel; a cell beyond an image isn't occupied.
    """
    if isinstance(cameras, DataFrame):
        both = cameras.groupBy("session").agg(*[F.max(F.when(F.col("camera") == k, F.col("p"))).alias(f"p{k}") for k in (0, 1)]).where("p0 IS NOT NULL AND p1 IS NOT NULL")
        frames = frames.join(both, "session").sortWithinPartitions("p0", "p1")  # frames of a rig follow each other
    else:
        frames = frames.withColumns({f"p{k}": F.array(*[F.lit(float(v)) for row in p for v in row]) for k, p in enumerate(cameras)})

    rigs: dict[bytes, tuple[np.ndarray, ...]] = {}  # each task fills its own copy
    pixels, total = width * height, math.prod(dims(bounds, size))
    step = max(1, AT_ONCE // max(pixels, total))

    def seen_by(rig: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cells by the first view's pixel, where each pixel's begin, and the cells' pixels in the second view."""
        if rig.tobytes() not in rigs:
            if len(rigs) == RIGS_KEPT:
                rigs.pop(next(iter(rigs)))
            first, second = (cell_pixels(p, bounds, size, width, height) for p in rig.reshape(2, -1))
            cells = np.argsort(first, kind="stable")
            rigs[rig.tobytes()] = cells, np.searchsorted(first[cells], np.arange(pixels + 1)), second
        return rigs[rig.tobytes()]

    def hulls(rig: np.ndarray, m0: pa.Array, m1: pa.Array) -> list[bytes | None]:
        cells, starts, second = seen_by(rig)
        lit = np.zeros((2, len(m0), pixels + 1), dtype=bool)
        for view, mask in zip(lit, (m0, m1)):
            bits = np.frombuffer(b"".join(mask.to_pylist()), dtype=np.uint8).reshape(len(mask), -1)
            view[:, :-1] = np.unpackbits(bits, axis=1, count=pixels)
        row, pixel = np.divmod(np.flatnonzero(lit[0]), pixels + 1)
        n = starts[pixel + 1] - starts[pixel]
        ends, hull = np.cumsum(n), np.zeros((len(m0), total), dtype=np.uint8)
        # pixels of so many cells at a time; a frame may go on in the next piece
        edges = [0, *np.searchsorted(ends, np.arange(AT_ONCE, n.sum(), AT_ONCE)).tolist(), len(n)]
        for lo, hi in zip(edges, edges[1:]):
            own, many = slice(lo, hi), n[lo:hi]
            left = cells[np.repeat(starts[pixel[own]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            frame = np.repeat(row[own], many)
            both = lit[1][frame, second[left]]
            hull[frame[both], left[both]] = 1
        return [own.tobytes() if some else None for own, some in zip(np.packbits(hull, axis=1), hull.any(1))]

    def run(m0: pa.Array, m1: pa.Array, p0: pa.Array, p1: pa.Array) -> list[pa.Array]:
        own = np.hstack([np.asarray(p.flatten(), dtype=float).reshape(len(p), -1) for p in (p0, p1)])
        out, changes = [], [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(own)]
        for first, end in zip(changes, changes[1:]):
            for lo in range(first, end, step):
                n = min(step, end - lo)
                out += hulls(own[first], m0.slice(lo, n), m1.slice(lo, n))
        return [pa.array(out, pa.binary())]

    carved = _in_pieces(frames, ["session", "frame_idx"], "grid binary", run, "m0", "m1", "p0", "p1")
    return carved.where("grid IS NOT NULL")


def _read(shape: tuple[int, int, int], fn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[pa.Array], pa.Array]:
    """fn of boolean grids (n, nx, ny, nz) gives (grid number in rising order, value); as lists, one for each grid."""
    cells = shape[0] * shape[1] * shape[2]

    def run(grids: pa.Array) -> pa.Array:
        found, sizes = [np.zeros(0, dtype=np.int64)], []
        step = max(1, AT_ONCE // cells)
        for lo in range(0, len(grids), step):
            part = grids.slice(lo, step)
            bits = np.unpackbits(np.frombuffer(b"".join(part.to_pylist()), dtype=np.uint8).reshape(len(part), -1), axis=1, count=cells)
            row, value = fn(bits.astype(bool).reshape(-1, *shape))
            found.append(value.astype(np.int64))
            sizes.append(np.bincount(row, minlength=len(part)))
        ends = np.concatenate([[0], *[np.cumsum(np.concatenate(sizes))] * bool(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))

    return run


def _flat(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, at = np.nonzero(mask.reshape(len(mask), -1))
    return row, at


def _cells(grids: DataFrame, key: list[str], shape: tuple[int, int, int], fn, *more: tuple[str, int]) -> DataFrame:
    """(key, more ..., i, j, k) of the values that fn lists for grids, which are flat numbers behind further numbers of the given ranges.

    A task hands on the lists of some grids at a time, whatever a batch holds, so its memory depends on neither.
    """
    nx, ny, nz = shape
    kinds, step = dict(grids.dtypes), max(1, AT_ONCE // (nx * ny * nz))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*[part[k] for k in key], fn(part["grid"])], [*key, "v"])

    listed = grids.select(*key, "grid").mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in key], "v array<bigint>"]))
    rows = listed.select(*key, F.explode("v").alias("v"))
    out, rest = [F.expr(f"(v div {ny * nz}) % {nx}").cast("int").alias("i"), F.expr(f"(v div {nz}) % {ny}").cast("int").alias("j"), F.expr(f"v % {nz}").cast("int").alias("k")], nx * ny * nz
    for name, n in more:
        out.append(F.expr(f"(v div {rest}) % {n}").cast("int").alias(name))
        rest *= n
    return rows.select(*key, *out)


def cells(grids: DataFrame, key: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(key, i, j, k) of all occupied cells. Only bytes that aren't 0 are unpacked."""

    def run(grids: pa.Array) -> pa.Array:
        per = (shape[0] * shape[1] * shape[2] + 7) // 8
        found, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        step = max(1, AT_ONCE // per)
        for lo in range(0, len(grids), step):
            part = grids.slice(lo, step)
            packed = np.frombuffer(b"".join(part.to_pylist()), dtype=np.uint8).reshape(len(part), per)
            row, byte = np.nonzero(packed)
            which, bit = np.nonzero(np.unpackbits(packed[row, byte][:, None], axis=1))
            found.append(byte[which] * 8 + bit)
            sizes.append(np.bincount(row[which], minlength=len(part)))
        ends = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int64()))

    return _cells(grids, key, shape, run)


def count(grids: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_occupied)."""

    def run(grids: pa.Array) -> pa.Array:
        bits = np.array([0, 1, 1, 2, 1, 2, 2, 3, 1, 2, 2, 3, 2, 3, 3, 4], dtype=np.int64)
        out = []
        for g in grids:
            own = np.frombuffer(g.as_buffer(), dtype=np.uint8)
            out.append(int(bits[own >> 4].sum() + bits[own & 15].sum()))
        return pa.array(out, pa.int64())

    return grids.select(*key, F.arrow_udf(run, "bigint")("grid").alias("n_occupied"))


def surface(grids: DataFrame, key: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """Cells not all of whose 26 neighbours are occupied; cells at the border of the grid always are on the surface."""

    def run(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.pad(grid, ((0, 0), (1, 1), (1, 1), (1, 1)))
        for axis in (1, 2, 3):
            n = inner.shape[axis]
            inner = inner.take(range(n - 2), axis) & inner.take(range(1, n - 1), axis) & inner.take(range(2, n), axis)
        return _flat(grid & ~inner)

    return _cells(grids, key, shape, _read(shape, run))


def _cut(grid: np.ndarray) -> np.ndarray:
    """(n, 3 * cells): of grids (n, nx, ny, nz) the grid edges of which one end is occupied, axis by axis, by their lower end."""
    cut = np.zeros((len(grid), 3, *grid.shape[1:]), dtype=bool)
    for axis in range(3):
        low, high = (tuple(end if a == axis + 1 else slice(None) for a in range(4)) for end in (slice(None, -1), slice(1, None)))
        cut[:, axis][low] = grid[low] ^ grid[high]
    return cut.reshape(len(grid), -1)


def _codes(grid: np.ndarray) -> np.ndarray:
    """(n, cells): corner codes of the cells between eight grid points, by their lowest corner; 0 where there is no such cell."""
    nx, ny, nz = grid.shape[1:]
    code = np.zeros(grid.shape, dtype=np.uint8)
    inner = code[:, : nx - 1, : ny - 1, : nz - 1]
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                inner |= grid[:, a : nx - 1 + a, b : ny - 1 + b, c : nz - 1 + c].view(np.uint8) << np.uint8(a | b << 1 | c << 2)
    return code.reshape(len(grid), -1)


def edges(grids: DataFrame, key: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(key, i, j, k, axis): grid edges of which one end is occupied, by their lower end."""
    return _cells(grids, key, shape, _read(shape, lambda grid: np.nonzero(_cut(grid))), ("axis", 3))


def corner_codes(grids: DataFrame, key: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(key, i, j, k, code) of the cells between eight grid points that are neither all occupied nor all empty; a corner's bit is 1 << (i | j << 1 | k << 2)."""
    total = shape[0] * shape[1] * shape[2]

    def run(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = _codes(grid)
        row, at = np.nonzero((code > 0) & (code < 255))
        return row, at + code[row, at].astype(np.int64) * total

    return _cells(grids, key, shape, _read(shape, run), ("code", 256))


def _by_name(shape: tuple[int, int, int]) -> np.ndarray:
    """All grid edges, axis * cells + flat number of the lower end, in the order of their names axis:i:j:k as texts."""
    total = shape[0] * shape[1] * shape[2]
    i, j, k = np.meshgrid(*[sorted(range(n), key=lambda v, end=end: f"{v}{end}") for n, end in zip(shape, "::\n")], indexing="ij")
    flat = ((i * shape[1] + j) * shape[2] + k).ravel()
    return np.concatenate([flat + axis * total for axis in range(3)])


def meshes(grids: DataFrame, key: list[str], shape: tuple[int, int, int], triangles: list, made: str, fn: Callable) -> DataFrame:
    """(key, made): fn of the meshes of some grids at a time; a grid's mesh stays in the row that the grid is in.

    fn gets the vertices of all these grids, as grid edges in the order of their names, where each grid's begin (and the
    last ones end), and the faces (m, 3) by their vertices' places, in rising order. triangles: (code, position, three edges)
    as of `voxels.cell_triangles`.
    """
    nx, ny, nz = shape
    total, step = nx * ny * nz, max(1, AT_ONCE // (nx * ny * nz))
    kinds, names = dict(grids.dtypes), [*key, *[c.split()[0] for c in made.split(", ")]]
    triangles = sorted(triangles, key=lambda t: t[:2])
    corners = np.array([[axis * total + (i * ny + j) * nz + k for axis, (i, j, k) in tri] for _, _, tri in triangles])
    first = np.searchsorted([code for code, *_ in triangles], np.arange(257))

    def run(batches):
        order = _by_name(shape)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                bits = np.frombuffer(b"".join(part["grid"].to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                grid = np.unpackbits(bits, axis=1, count=total).astype(bool).reshape(-1, *shape)
                row, place = np.nonzero(_cut(grid)[:, order])
                number = np.zeros((len(grid), 3 * total), dtype=np.int64)
                number[row, order[place]] = np.arange(len(row))
                code = _codes(grid)
                cell_row, at = np.nonzero((code > 0) & (code < 255))
                code = code[cell_row, at]
                n = first[code.astype(int) + 1] - first[code]
                which = np.repeat(np.arange(len(code)), n)
                tri = corners[np.arange(n.sum()) + np.repeat(first[code] - np.cumsum(n) + n, n)] + at[which, None]
                faces = number[cell_row[which, None], tri]
                faces = faces[np.lexsort(faces.T[::-1])]
                starts = np.searchsorted(row, np.arange(len(grid) + 1))
                yield pa.RecordBatch.from_arrays([*[part[k] for k in key], *fn(order[place], starts, faces)], names)

    return grids.select(*key, "grid").mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in key], made]))


def numbered(grids: DataFrame, key: list[str], shape: tuple[int, int, int], triangles: list) -> DataFrame:
    """(key, v, f): a grid's vertices as grid edges, numbered from 0 by their place, and its faces as three such numbers, in order."""

    def run(vertices: np.ndarray, starts: np.ndarray, faces: np.ndarray) -> list[pa.Array]:
        ends = np.searchsorted(faces[:, 0], starts)
        own = faces - np.repeat(starts[:-1], np.diff(ends))[:, None]
        three = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(faces) + 1, 3), pa.int32()), pa.array(own.ravel(), pa.int32()))
        return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(vertices, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), three)]

    return meshes(grids, key, shape, triangles, "v array<int>, f array<array<int>>", run)


def smoothed(grids: DataFrame, key: list[str], shape: tuple[int, int, int], triangles: list, origin: tuple, size: float, rounds: int = 1) -> DataFrame:
    """(key, v, x, y, z): a grid's vertices that have neighbours, as lists, each moved to the mean of its neighbours, round by round."""
    total = shape[0] * shape[1] * shape[2]

    def run(vertices: np.ndarray, starts: np.ndarray, faces: np.ndarray) -> list[pa.Array]:
        axis, low = np.divmod(vertices, total)
        at = [(c + np.where(axis == a, 0.5, 0.0)) * size + origin[a] for a, c in enumerate(np.unravel_index(low, shape))]
        pairs = np.concatenate([faces[:, p] * len(vertices) + faces[:, q] for p in range(3) for q in range(3) if p != q])
        v, w = np.divmod(np.unique(pairs), max(len(vertices), 1))
        n = np.bincount(v, minlength=len(vertices))
        for _ in range(rounds):
            at = [np.bincount(v, c[w], len(vertices)) / np.maximum(n, 1) for c in at]
        kept = np.flatnonzero(n)
        ends = pa.array(np.searchsorted(kept, starts), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(vertices[kept], pa.int32())), *[pa.ListArray.from_arrays(ends, pa.array(c[kept])) for c in at]]

    return meshes(grids, key, shape, triangles, "v array<int>, " + ", ".join(f"{c} array<double>" for c in "xyz"), run)
