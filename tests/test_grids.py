"""Packed masks and grids against loops over cells, and the whole run taken up again after it was cut short."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolake.functions import geometry as g
from stereolake.operators import grids, masks, reconstruct, voxels
from stereolake.plans import catalog
from stereolake.sources import files, tables

KEY = ["session", "frame_idx"]
SHAPE = (4, 5, 3)


def random_grids(n=7):
    rng = np.random.default_rng(6)
    return {(1, f): rng.random(SHAPE) < (0.2, 0.6, 0.95, 1.0)[f % 4] for f in range(n)}


def packed(spark, found):
    rows = [(s, f, int(i), int(j), int(k)) for (s, f), occupied in found.items() for i, j, k in zip(*np.nonzero(occupied))]
    return grids.pack_voxels(spark.createDataFrame(rows, "session bigint, frame_idx bigint, i int, j int, k int"), KEY, SHAPE)


def test_stencils_by_loops(spark, monkeypatch):
    monkeypatch.setattr(grids, "AT_ONCE", 2 * 60)
    found = random_grids()
    df = packed(spark, found)
    inside = lambda c: all(0 <= v < n for v, n in zip(c, SHAPE))
    every = list(itertools.product(*map(range, SHAPE)))
    around = list(itertools.product((-1, 0, 1), repeat=3))
    move = lambda c, d: tuple(a + b for a, b in zip(c, d))
    cells, surface, edges, codes = set(), set(), set(), set()
    for key, occupied in found.items():
        on = lambda c: inside(c) and bool(occupied[c])
        for c in every:
            if on(c):
                cells.add((*key, *c))
                if not all(on(move(c, d)) for d in around):
                    surface.add((*key, *c))
            for axis in range(3):
                other = move(c, [int(a == axis) for a in range(3)])
                if inside(other) and on(c) != on(other):
                    edges.add((*key, *c, axis))
            corners = list(itertools.product((0, 1), repeat=3))
            if all(inside(move(c, d)) for d in corners):
                code = sum(on(move(c, d)) << (d[0] | d[1] << 1 | d[2] << 2) for d in corners)
                if 0 < code < 255:
                    codes.add((*key, *c, code))
    got = lambda out: sorted(map(tuple, out.collect()))
    assert got(grids.cells(df, KEY, SHAPE)) == sorted(cells)
    assert got(grids.surface(df, KEY, SHAPE)) == sorted(surface)
    assert got(grids.edges(df, KEY, SHAPE)) == sorted(edges)
    assert got(grids.corner_codes(df, KEY, SHAPE)) == sorted(codes)
    assert dict(((r.session, r.frame_idx), r.n_occupied) for r in grids.count(df, KEY).collect()) == {k: int(v.sum()) for k, v in found.items()}
    assert grids.surface(df.limit(0), KEY, SHAPE).count() == 0


BOUNDS = ((-30, 30), (-20, 20), (60, 120))
RIGS = {1: ([50.0, 0, 20, 0, 0, 50, 10, 0, 0, 0, 1, 0], [50.0, 0, 20, -500, 0, 50, 10, 0, 0, 0, 1, 0]), 2: ([40.0, 3, 20, -991, 0, 45, 10, -500, 0, 0, 1, -50], [45.0, 0, 18, -300, 0, 40, 12, 80, 0, 0, 1, 0])}


def test_each_session_is_carved_by_its_rig(spark):
    rng = np.random.default_rng(1)
    lit = [(s, c, f, x, y) for s in (1, 2, 3) for c in (0, 1) for f in range(3) for x in range(-1, 41) for y in range(21) if rng.random() < 0.6]
    mask = spark.createDataFrame(lit, "session bigint, camera int, frame_idx bigint, px int, py int")
    cameras = spark.createDataFrame([(s, k, [float(v) for v in p]) for s, rig in RIGS.items() for k, p in enumerate(rig)], "session bigint, camera int, p array<double>")
    got = sorted(map(tuple, voxels.carve(mask, cameras, BOUNDS, 10.0, 40, 20).collect()))
    on, want = set(lit), []
    for s, rig in RIGS.items():
        for f, i, j, k in itertools.product(range(3), range(6), range(4), range(6)):
            center = [(v + 0.5) * 10 + lo for v, (lo, _) in zip((i, j, k), BOUNDS)]
            seen = True
            for c, p in enumerate(rig):
                u, v, w = (np.dot(row[:3], center) + row[3] for row in np.reshape(p, (3, 4)))
                seen = seen and w > 0 and 0 <= u / w < 40 and 0 <= v / w < 20 and (s, c, f, min(round(u / w), 39), min(round(v / w), 19)) in on
            if seen:
                want.append((s, f, i, j, k))
    assert got == sorted(want) and {r[0] for r in got} == {1, 2}  # session 3 has no rig


def test_pixels_of_cells_are_those_of_the_columns(spark):
    p = np.reshape(RIGS[2][0], (3, 4))
    u, v, _ = g.project(p.tolist(), F.col("x"), F.col("y"), F.col("z"))
    seen = voxels.grid(spark, BOUNDS, 5.0).select("i", "j", "k", u.alias("u"), v.alias("v")).withColumn("at", F.when(g.in_image(F.col("u"), F.col("v"), 40, 20), g.pixel(F.col("v"), 20) * 40 + g.pixel(F.col("u"), 40)).otherwise(800))
    assert [r["at"] for r in seen.orderBy("i", "j", "k").collect()] == grids.cell_pixels(p, BOUNDS, 5.0, 40, 20).tolist()


# ---------------------------------------------------------------- the whole run


def inputs(spark):
    points = [(s, f, n, 3.0 * f - 20 + 5 * k, float(k * 4 - 6), 80.0 + f) for s in (1, 2) for f in range(12) for k, n in enumerate("ab") if not (f in (4, 5) and n == "a")]
    kp, lit = [], set()
    for s, f, n, x, y, z in points:
        for c in (0, 1):
            p = np.reshape(RIGS[1][c], (3, 4))
            u, v, w = p @ [x, y, z, 1]
            kp.append((s, c, f, n, float(u / w), float(v / w), 0.9, f))
            lit |= {(s, c, f, int(u / w) + a, int(v / w) + b) for a in range(-3, 4) for b in range(-3, 4)}
    return (
        spark.createDataFrame(kp, "session bigint, camera int, frame_idx bigint, name string, px double, py double, confidence double, event_id bigint"),
        spark.createDataFrame(sorted(lit), "session bigint, camera int, frame_idx bigint, px int, py int"),
        spark.createDataFrame([(1, 12), (2, 12)], "session bigint, n_frames bigint"),
        spark.createDataFrame([(s, k, [float(v) for v in p]) for s in (1, 2) for k, p in enumerate(RIGS[1])], "session bigint, camera int, p array<double>"),
        spark.createDataFrame([("a", "b")], "a string, b string"),
    )


OPTIONS = reconstruct.Options(bounds=BOUNDS, voxel_size=5.0, width=40, height=20, stride=4)


def test_a_run_that_was_cut_short_is_taken_up(spark, monkeypatch):
    out = tables.fresh_path(spark, "run")
    given = inputs(spark)
    whole = files.write_clouds
    monkeypatch.setattr(files, "write_clouds", lambda rows, path: (whole(rows.limit(3), path), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        reconstruct.run(*given, out, OPTIONS)
    monkeypatch.setattr(files, "write_clouds", whole)
    first = {r.stage: r.path for r in reconstruct.Run(spark, out).manifest().collect()}
    assert set(first) == {"hulls", "points", "tracks", "stats", "archive", "metadata"}
    job = reconstruct.run(*given, out, OPTIONS)
    assert set(job.skipped) == set(first) and {k: job.paths[k] for k in first} == first
    assert set(job.paths) == {"hulls", "points", "tracks", *reconstruct.SINKS}
    hull = grids.cells(job.table("hulls"), KEY, grids.dims(BOUNDS, 5.0))
    assert job.table("clouds").count() == hull.count() > 3
    # nothing is done twice; other options redo what they touch and what reads it
    again = reconstruct.run(*given, out, OPTIONS)
    assert again.paths == job.paths and len(again.skipped) == len(job.paths)
    other = reconstruct.run(*given, out, reconstruct.Options(**{**OPTIONS.__dict__, "max_gap": 1}))
    assert set(other.skipped) == {"hulls", "points", "clouds", "volumes"}
    newer = reconstruct.run(*given, out, OPTIONS, inputs="second", sinks=("stats",))
    assert newer.skipped == []


def test_what_a_run_writes(spark):
    given = inputs(spark)
    job = reconstruct.run(*given, tables.fresh_path(spark, "run"), reconstruct.Options(**{**OPTIONS.__dict__, "start_frame": 2, "n_frames": 9, "mesh": False}))
    tracks = job.table("tracks").where("session = 1 AND name = 'a'").orderBy("frame_idx").collect()
    assert [r.frame_idx for r in tracks] == list(range(9))
    assert [r.frame_idx for r in tracks if r.reproj_err == 0.0 and r.confidence == pytest.approx(0.72)] == [2, 3]
    stats = {(r.session, r.name): r for r in spark.read.option("header", True).csv(job.paths["stats"]).collect()}
    assert stats["1", "a"].detection_rate == "1.0000" and stats["2", "b"].n_detected == "9"
    assert job.table("metadata").where("session = 1").first().n_frames == 9
    heads = spark.read.text(job.paths["skeletons"]).where("value LIKE 'element vertex%'").collect()
    assert sorted((r.session, r.frame_idx) for r in heads) == [(s, f) for s in (1, 2) for f in (0, 4, 8)]
    volumes = spark.read.text(job.paths["volumes"]).where("frame_idx = 4 AND session = 1 AND value NOT RLIKE '[a-z]'").count()
    assert volumes == grids.cells(job.table("hulls"), KEY, grids.dims(BOUNDS, 5.0)).where("frame_idx = 4 AND session = 1").count() > 0
    with pytest.raises(ValueError):
        reconstruct.run(*given, "/nowhere", OPTIONS, sinks=("video",))


def test_lists_of_cells_are_handed_on_some_grids_at_a_time(spark, monkeypatch):
    shape, seen = (8, 8, 8), spark.sparkContext.accumulator(0)
    full = spark.range(0, 5000, 1, 1).selectExpr("id AS frame_idx", f"unhex(repeat('FF', {8 * 8})) AS grid")
    monkeypatch.setattr(grids, "AT_ONCE", 100 * 512)
    plain = grids._flat

    def counted(mask):
        seen.add(1)
        assert len(mask) <= 100
        return plain(mask)

    out = grids._cells(full, ["frame_idx"], shape, grids._read(shape, counted))
    assert {r["count"] for r in out.groupBy("frame_idx").count().collect()} == {512}
    assert seen.value == 50
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_masks_are_packed_and_carved_some_frames_at_a_time(spark):
    """Batches of any fill are handed on in pieces, from the masks to the cells."""
    lit = spark.range(0, 1200, 1, 1).selectExpr("1L AS session", "id AS frame_idx", "explode(array(0, 1)) AS camera", "2 AS px", "2 AS py")
    packed = grids.pack_masks(lit, 4, 4)
    p = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 0, 1.0]]  # cells are seen at their rounded centres
    out = grids.carve(packed, [p, p], ((0, 4), (0, 4), (0, 1)), 1.0, 4, 4)
    assert out.count() == 1200 and out.select("grid").distinct().count() == 1
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") >= 2
    assert grids.cells(out, ["frame_idx"], (4, 4, 1)).count() % 1200 == 0


def test_files_of_a_run_begin_with_their_headers(spark):
    """A frame's file is whole: the header first, then as many lines as it counts."""
    job = reconstruct.run(*inputs(spark), tables.fresh_path(spark, "run"), OPTIONS, sinks=("skeletons", "volumes"))
    for sink in ("skeletons", "volumes"):
        found = spark.read.text(job.paths[sink], wholetext=True).collect()
        assert len(found) >= 2 and len({(r.session, r.frame_idx) for r in found}) == len(found)
        for r in found:
            head, body = r.value.split("end_header\n")
            assert head.startswith("ply\nformat ascii 1.0\nelement vertex ")
            assert len(body.splitlines()) == sum(int(n.split()[2]) for n in head.splitlines() if n.startswith("element "))


@pytest.mark.parametrize("rounds", [1, 2])
def test_smoothing_of_packed_grids_is_that_of_their_tables(spark, monkeypatch, rounds):
    """Indices of two digits, whose names sort otherwise than their numbers; a grid without surface, a thin one."""
    for shape in ((11, 3, 12), (1, 4, 4)):
        monkeypatch.setattr(grids, "AT_ONCE", 2 * shape[0] * shape[1] * shape[2])
        df, place = random_hulls(spark, shape), ((-3.0, 0.1, 7.0), 2.5)
        vertices = voxels.mesh_vertices(df, KEY, shape, *place).select(*KEY, F.concat_ws(":", "axis", "i", "j", "k").alias("v"), "x", "y", "z")
        want = voxels.laplacian(vertices, voxels.adjacency(voxels.mesh_faces(df, KEY, shape), KEY), KEY, rounds)
        found, want = ({tuple(r)[:3]: tuple(r)[3:] for r in out.select(*KEY, "v", "x", "y", "z").collect()} for out in (voxels.smooth_meshes(df, KEY, shape, *place, rounds), want))
        assert found.keys() == want.keys() and bool(found) == (shape[0] > 1) and all(found[v] == pytest.approx(want[v]) for v in want)


def random_hulls(spark, shape):
    rng = np.random.default_rng(4)
    rows = [(1, f, bytes(np.packbits(rng.random(shape).ravel() < (0.1, 0.5, 0.9, 1.1)[f % 4]))) for f in range(5)]
    return spark.createDataFrame(rows, "session bigint, frame_idx bigint, grid binary")


def test_meshes_stay_where_their_grids_are(spark):
    """Smoothing shuffles keypoints on their way to a frame, and nothing of a mesh."""
    assert shuffled(spark, lambda: catalog.QUERIES["smooth_mesh"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()) < 170_000


def shuffled(spark, action):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    action()
    return written() - before


def test_text_of_whole_meshes_is_that_of_their_tables(spark):
    shape, place = (11, 3, 12), ((-3.0, 0.1, 7.0), 2.5)
    df = random_hulls(spark, shape)
    vertices = voxels.mesh_vertices(df, KEY, shape, *place).select(*KEY, F.concat_ws(":", "axis", "i", "j", "k").alias("v"), "x", "y", "z")
    want = files.mesh_text(*files.numbered_mesh(vertices, voxels.mesh_faces(df, KEY, shape).select(*KEY, "a", "b", "c"), KEY), KEY)
    got = files.whole_meshes_text(voxels.meshes(df, KEY, shape, *place), KEY)
    assert got.dtypes == want.dtypes
    rows = list(map(tuple, got.collect()))
    assert rows == sorted(rows) == sorted(map(tuple, want.collect())) and len(rows) > 1000
    assert shuffled(spark, lambda: catalog.QUERIES["mesh_text"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()) < 170_000


def test_packed_masks_grow_as_their_pixels(spark, monkeypatch):
    """Pixels beyond the image don't grow into it; pixels and lists of them are packed alike."""
    monkeypatch.setattr(grids, "AT_ONCE", 3 * 20 * 11)
    rng = np.random.default_rng(9)
    lit = sorted({(1, int(c), int(f), int(x), int(y)) for c, f, x, y in rng.integers((0, 0, -2, -2), (2, 9, 22, 13), (120, 4))})
    mask = spark.createDataFrame(lit, "session bigint, camera int, frame_idx bigint, px int, py int")
    lists = mask.groupBy(*KEY).agg(*[F.collect_list(F.when(F.col("camera") == k, F.struct("px", "py"))).alias(f"m{k}") for k in (0, 1)])
    kernel = masks.ellipse(5)
    want = grids.pack_masks(masks.dilate(mask, kernel, 20, 11), 20, 11)
    got = [grids.grow(grids.pack_masks(m, 20, 11), kernel, 20, 11) for m in (mask, lists)]
    found = [sorted((r.session, r.frame_idx, bytes(r.m0), bytes(r.m1)) for r in df.collect()) for df in (want, *got)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 9


def test_carving_in_pieces(spark, monkeypatch):
    """Frames whose cells don't go into one piece, and rigs that take turns within a batch."""
    rng = np.random.default_rng(2)
    lit = [(s, c, f, x, y) for s in (1, 2) for c in (0, 1) for f in range(20) for x in range(40) for y in range(20) if rng.random() < 0.8]
    mask = spark.createDataFrame(lit, "session bigint, camera int, frame_idx bigint, px int, py int").coalesce(1)
    cameras = spark.createDataFrame([(s, k, [float(v) for v in p]) for s, rig in RIGS.items() for k, p in enumerate(rig)], "session bigint, camera int, p array<double>")
    whole = sorted(map(tuple, voxels.carve(mask, cameras, BOUNDS, 10.0, 40, 20).collect()))
    for at_once in (1, 50, 1000):
        monkeypatch.setattr(grids, "AT_ONCE", at_once)
        assert sorted(map(tuple, voxels.carve(mask, cameras, BOUNDS, 10.0, 40, 20).collect())) == whole
    assert {r[0] for r in whole} == {1, 2}


def test_hulls_and_volumes_of_a_run_are_not_shuffled_by_pixel_or_corner(spark):
    """Pixels that come by frame stay there, also where frames are numbered anew, and meshes where their hulls are."""
    kp, _, frames, cameras, edges = inputs(spark)
    p = spark.createDataFrame([(s, f, c, x, y) for s in range(1, 3) for f in range(40) for c in (0, 1) for x in range(30) for y in range(20)], "session bigint, frame_idx bigint, camera int, px int, py int")
    mask = p.repartition("session", "frame_idx").cache()
    mask.count()
    out, told = tables.fresh_path(spark, "run"), reconstruct.Options(**{**OPTIONS.__dict__, "grow": 1, "start_frame": 1})
    assert shuffled(spark, lambda: reconstruct.run(kp.limit(0), mask, frames, cameras, edges, out, told, sinks=())) < 40_000
    job = []
    assert shuffled(spark, lambda: job.append(reconstruct.run(kp.limit(0), mask, frames, cameras, edges, out, told, sinks=("volumes",)))) == 0
    assert spark.read.text(job[0].paths["volumes"]).where("value LIKE 'element vertex%'").count() == 20
    mask.unpersist()
