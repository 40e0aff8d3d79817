"""Blobs by runs against a walk from pixel to pixel; images in tiles against whole ones."""

import collections

import numpy as np
import pytest

from stereolake.operators import masks

SCHEMA = "session bigint, camera int, frame_idx bigint, px int, py int"


def walk(left, start, steps):
    group, todo = {start}, [start]
    while todo:
        x, y = todo.pop()
        for a, b in steps:
            p = (x + a, y + b)
            if p in left and p not in group:
                group.add(p)
                todo.append(p)
    return group


AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
BESIDE = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def by_hand(pixels, min_area, fill):
    out, left = [], set(pixels)
    for p in sorted(pixels, key=lambda p: (p[1], p[0])):
        if p not in left:
            continue
        group = walk(left, p, AROUND)
        left -= group
        if len(group) < min_area:
            continue
        if fill:
            xs, ys = [q[0] for q in group], [q[1] for q in group]
            box = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - group
            group |= box - walk(box, (min(xs) - 1, min(ys) - 1), BESIDE)
        out.append(group)
    return {(x, y, n, len(g)) for n, g in enumerate(out) for x, y in g}


def frames(seed):
    rng = np.random.default_rng(seed)
    found = {}
    for f, share in enumerate((0.1, 0.35, 0.45, 0.6, 0.8, 1.0)):
        ys, xs = np.nonzero(rng.random((23, 31)) < share)
        found[f] = [(int(x) - 3, int(y) - 2) for x, y in zip(xs, ys)]
    found[9] = [(x, y) for x in range(20) for y in range(20) if x in (0, 19) or y in (0, 19) or 5 < x < 9 and 5 < y < 9]  # a ring around a square
    found[10] = [(i, i) for i in range(30)] + [(30 - i, i) for i in range(30)]
    return found


def rows_of(spark, found):
    rows = [(1, f % 2, f, x, y) for f, pixels in found.items() for x, y in pixels]
    return spark.createDataFrame(rows + rows[:5], SCHEMA)


@pytest.mark.parametrize(("min_area", "fill"), [(1, False), (4, False), (1, True), (6, True)])
def test_blobs_are_those_of_a_walk(spark, min_area, fill):
    found = frames(min_area)
    got = collections.defaultdict(list)
    for r in masks.label_blobs(rows_of(spark, found), min_area, fill).collect():
        got[r.frame_idx].append((r.px, r.py, r.blob, r.area))
    for f, pixels in found.items():
        want = by_hand(pixels, min_area, fill)
        assert set(got[f]) == want
        assert len(got[f]) == len(want)


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_tiles_give_the_blobs_of_the_whole(spark, tile):
    found = frames(tile)
    df = rows_of(spark, found)
    for min_area in (1, 5):
        whole = sorted(map(tuple, masks.label_blobs(df, min_area).select("frame_idx", "px", "py", "blob", "area").collect()))
        assert sorted(map(tuple, masks.label_blobs(df, min_area, tile=tile).select("frame_idx", "px", "py", "blob", "area").collect())) == whole
    with pytest.raises(ValueError):
        masks.label_blobs(df, fill=True, tile=tile)


def test_a_long_snake_is_one_blob():
    """A spiral of many runs: unions halve their paths, so the rounds stay few."""
    size = 401
    grid = np.zeros((size, size), dtype=bool)
    grid[::2] = True
    grid[1::4, -1] = grid[3::4, 0] = True
    y, x = np.nonzero(grid)
    label, _ = masks.label_runs(y, x, reach=0)
    assert set(label.tolist()) == {0}
    assert masks.label_runs(np.zeros(0, dtype=int), np.zeros(0, dtype=int))[0].size == 0
