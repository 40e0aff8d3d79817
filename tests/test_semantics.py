"""Edge cases that the SQL comparison doesn't reach, on small inputs with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolake.functions import geometry as g
from stereolake.operators import alignment, calibration, masks, matching, refinement, trajectory, voxels
from stereolake.plans import catalog
from stereolake.plans import catalog
from stereolake.plans.fixtures import view
from stereolake.sources import files, landmarks
from stereolake.streaming import streams

KP3D = "session long, frame_idx long, name string, x double, y double, z double, confidence double, reproj_err double"
P0 = [[900.0, 0.0, 640.0, 0.0], [0.0, 900.0, 360.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
P1 = [[900.0, 0.0, 640.0, -90000.0], [0.0, 900.0, 360.0, 0.0], [0.0, 0.0, 1.0, 0.0]]


def track(spark, frames, values=None, name="nose"):
    return spark.createDataFrame([(1, f, name, float(v), 0.0, 500.0, 0.9, 1.0) for f, v in zip(frames, values or frames)], KP3D)


def frames(spark, n):
    return spark.createDataFrame([(1, n)], "session long, n_frames long")


@pytest.mark.parametrize("point", [(0, 0, 500), (30, -20, 400), (0, 0, 600)])
def test_triangulation_round_trip(spark, point):
    h = np.array([*point, 1.0])
    (a, b) = ((np.array(p) @ h) for p in (P0, P1))
    rows = spark.createDataFrame([(float(a[0] / a[2]), float(a[1] / a[2]), float(b[0] / b[2]), float(b[1] / b[2]))], "x0 double, y0 double, x1 double, y1 double")
    r = trajectory.triangulate(rows, P0, P1).head()
    assert np.allclose([r.x, r.y, r.z], point, atol=1e-6)


def test_triangulation_drops_what_is_not_finite(spark):
    rows = spark.createDataFrame([(float("nan"), 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (640.0, 360.0, 460.0, 360.0)], "x0 double, y0 double, x1 double, y1 double")
    assert trajectory.triangulate(rows, P0, P1).count() == 1


def test_error_that_is_no_number_is_kept(spark):
    rows = spark.createDataFrame([(float("nan"),), (19.0,), (21.0,)], "e double")
    assert rows.where(g.keep_error(F.col("e"), 20.0)).count() == 2


def test_last_duplicate_counts(spark):
    kp = spark.createDataFrame([(1, c, 0, "nose", x, 0.0, 0.9, i) for i, (c, x) in enumerate([(0, 1.0), (0, 2.0), (1, 3.0)])], "session long, camera int, frame_idx long, name string, px double, py double, confidence double, event_id long")
    assert trajectory.match_views(kp).head().x0 == 2.0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 30])
def test_smoothing_reflects_even_short_tracks(spark, n):
    rng = np.random.default_rng(n)
    seen = sorted(set(rng.integers(0, n, n).tolist()))
    values = rng.normal(size=len(seen)).tolist()
    got = {r.frame_idx: r.x for r in trajectory.smooth(track(spark, seen, values), frames(spark, n), 1.5).collect()}
    kernel = dict(g.gaussian_kernel(1.5))
    dense, known = np.zeros(n), np.zeros(n)
    dense[seen], known[seen] = values, 1
    for f in seen:
        at = [(f + k) % (2 * n) for k in kernel]
        at = [a if a < n else 2 * n - 1 - a for a in at]
        w = np.array(list(kernel.values()))
        assert got[f] == pytest.approx((w * dense[at]).sum() / (w * known[at]).sum())
    assert set(got) == set(seen)


def test_gaps_fill_up_to_the_limit_only(spark):
    short = trajectory.fill_gaps(track(spark, [0, 1, 5, 6]), 5)
    assert sorted(r.frame_idx for r in short.collect()) == list(range(7))
    assert short.where("frame_idx = 3").head().confidence == pytest.approx(0.72)
    assert trajectory.fill_gaps(track(spark, [0, 10]), 5).count() == 2


def test_rate_counts_empty_frames(spark):
    s = trajectory.stats(track(spark, [f for f in range(20) if f not in (5, 10)]), frames(spark, 20)).head()
    assert s.detection_rate == pytest.approx(18 / 20) and s.n_detected == 18


def test_pixels_round_half_to_even(spark):
    r = spark.range(1).select(g.pixel(F.lit(0.5), 10).alias("a"), g.pixel(F.lit(1.5), 10).alias("b"), g.pixel(F.lit(9.8), 10).alias("c")).head()
    assert (r.a, r.b, r.c) == (0, 2, 9)


def test_grid_and_surface(spark):
    assert voxels.dims(((-100, 100), (-100, 100), (0, 200)), 20) == (10, 10, 10)
    cube = voxels.grid(spark, ((0, 5), (0, 5), (0, 5)), 1).select(F.lit(1).alias("session"), "i", "j", "k")
    assert cube.count() == 125 and voxels.surface(cube, ["session"], (5, 5, 5)).count() == 98


def test_mesh_of_a_solid_is_closed(spark):
    rng = np.random.default_rng(3)
    cells = [(1, *map(int, c)) for c in {tuple(rng.integers(1, 7, 3)) for _ in range(60)}]
    hull = spark.createDataFrame(cells, "session long, i int, j int, k int")
    faces = voxels.mesh_faces(hull, ["session"], (8, 8, 8)).collect()
    edges = {}
    for f in faces:
        for p, q in ((f.a, f.b), (f.b, f.c), (f.c, f.a)):
            edges[p, q] = edges.get((p, q), 0) + 1
    assert edges and all(edges.get((q, p), 0) == n for (p, q), n in edges.items())
    named = {p for f in faces for p in (f.a, f.b, f.c)}
    verts = {":".join(map(str, (v.axis, v.i, v.j, v.k))) for v in voxels.mesh_vertices(hull, ["session"], (8, 8, 8), (0, 0, 0), 1.0).collect()}
    assert named == verts


def test_blobs_and_holes(spark):
    ring = [(1, 0, 0, x, y) for x in range(5) for y in range(5) if not (x == 2 and y == 2)]
    far = [(1, 0, 0, 20, 20), (1, 0, 0, 21, 21)]
    mask = spark.createDataFrame(ring + far, "session long, camera int, frame_idx long, px int, py int")
    assert sorted({r.area for r in masks.label_blobs(mask).collect()}) == [2, 24]
    filled = masks.label_blobs(mask, 5, fill=True)
    assert filled.count() == 25 and filled.where("px = 2 AND py = 2").count() == 1


def test_moving_disc_is_found(spark):
    rows = [(1, 0, f, x, y, 200.0 if f >= 10 and (x - f) ** 2 + (y - 12) ** 2 <= 16 else 50.0 + (x * 7 + y * 3 + f * 5) % 4) for f in range(20) for x in range(40) for y in range(24)]
    px = spark.createDataFrame(rows, "session long, camera int, frame_idx long, x int, y int, v double")
    got = masks.centroid_detector(px, 40, 24, ksize=3, min_area=10).where("name = 'centroid'").collect()
    assert got and all(abs(r.py - 12) <= 1 and abs(r.px - r.frame_idx) <= 4 for r in got)


def test_diverse_selection_is_the_greedy_one(spark):
    rng = np.random.default_rng(0)
    rows = [(1, int(f), float(q)) for f, q in zip(rng.permutation(400)[:60], rng.random(60))]
    got = sorted(r.frame_idx for r in matching.diverse_top_n(spark.createDataFrame(rows, "session long, frame_idx long, quality double"), 20).collect())
    kept = []
    for _, f, _ in sorted(rows, key=lambda r: (-r[2], r[1])):
        if len(kept) < 20 and all(abs(f - k) > 30 for k in kept):
            kept.append(f)
    assert got == sorted(kept)


def rig_matches(n, share, key, seed=0):
    rng = np.random.default_rng(seed)
    x, y, z = rng.uniform(-200, 200, n), rng.uniform(-120, 120, n), rng.uniform(400, 700, n)
    off = np.where((np.arange(n) < share * n)[:, None], 0.0, rng.uniform(-300, 300, (n, 2)))
    cols = (x / z * 900 + 640, y / z * 900 + 360, (x - 100) / z * 900 + 640 + off[:, 0], y / z * 900 + 360 + off[:, 1])
    return [(key, *map(float, r)) for r in zip(*cols)]


MATCHES = "session long, x0 double, y0 double, x1 double, y1 double"


def test_every_match_of_a_session_is_scored(spark):
    from stereolake.plans import catalog, fixtures

    sf = "/root/testdata/sf0.001"
    n = trajectory.match_views(fixtures.view(spark, sf, "kp2d")).count()
    assert catalog.QUERIES["estimate_fundamental"](spark, sf).agg(F.sum("n_matches")).head()[0] == n
    r = matching.estimate_fundamental(spark.createDataFrame(rig_matches(3000, 10 / 11, 1), MATCHES), ["session"]).head()
    assert r.n_matches == 3000 and r.n_inliers >= 2727


def test_half_wrong_matches_keep_their_estimate(spark):
    rows = [r for k in range(6) for r in rig_matches(200, 0.5, k, k)]
    got = matching.estimate_fundamental(spark.createDataFrame(rows, MATCHES), ["session"]).collect()
    assert len(got) == 6 and all(r.n_inliers >= 100 for r in got)
    assert matching.samples_needed(0.4, 0.9995) == 11595 and 1930 < matching.samples_needed(0.5, 0.9995) < 1950


def test_estimates_are_accepted_in_frame_order_and_placed_by_quality(spark):
    rows = [(1, f, 100 + f, 0.5, 0.2) for f in range(4)] + [(1, 4, 79, 0.9, 0.1), (1, 5, 300, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "session long, frame_idx long, n_inliers long, inlier_ratio double, mean_sampson double")
    got = {r.frame_idx: (r.accepted, r.place) for r in matching.ordered_estimates(df, most=3).collect()}
    assert got == {0: (True, 3), 1: (True, 2), 2: (True, 1), 3: (False, None), 4: (False, None), 5: (False, None)}


def test_rigid_fit_of_too_few_points_is_none(spark):
    schema = ", ".join(f"{c} double" for c in alignment.REC + alignment.ARENA)
    rows = spark.createDataFrame([(1, *map(float, range(6)))] * 2, f"session long, {schema}")
    assert alignment.rigid_fit(rows).count() == 0


def test_metric_scale_of_flat_points_is_one(spark):
    flat = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "session long, span_x double, span_y double, span_z double")
    assert calibration.metric_scale(flat, (1, 1, 1)).head().scale == 1.0


def test_distortion_scan_straightens_bent_lines(spark):
    rows = []
    for e in range(4):
        for n in range(15):
            u, v = -0.5 + n / 14, -0.3 + 0.2 * e
            s = 1 - 0.2 * (u * u + v * v)
            rows.append((1, 0, f"e{e}", 900 * u * s + 640, 900 * v * s + 360))
    edges = spark.createDataFrame(rows, "session long, camera int, label string, x double, y double")
    before = edges.groupBy("label").agg(alignment.line_rmse("x", "y").alias("e")).agg(F.avg(F.col("e") * F.col("e"))).head()[0]
    assert alignment.distortion_scan(edges, 900.0, 640.0, 360.0, rounds=2).head().cost < before / 10


def test_registered_scans_have_the_full_grid(spark, monkeypatch):
    from stereolake.plans import catalog

    sf, seen = "/root/testdata/sf0.001", {}
    assert {r.n for r in catalog.QUERIES["focal_scan"](spark, sf).groupBy("session").agg(F.count_distinct("f").alias("n")).collect()} == {300}
    monkeypatch.setattr(catalog.alignment, "distortion_scan", lambda edges, *a, **more: seen.update(more) or edges)
    catalog.QUERIES["distortion_scan"](spark, sf)
    assert seen.get("rounds", 4) == 4


def test_wide_tracks_with_individuals(spark, tmp_path):
    text = "scorer,a,a,a,a,a,a\nindividuals,m1,m1,m1,m2,m2,m2\nbodyparts,nose,nose,nose,nose,nose,nose\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.05\n1,x,2,0.9,3,4,0.8\n"
    (tmp_path / "t.csv").write_text(text)
    got = {(r.frame_idx, r.name): r.x for r in files.read_wide_tracks(spark, str(tmp_path)).collect()}
    assert got == {(0, "m1_nose"): 1.0, (1, "m2_nose"): 3.0}
    assert files.read_wide_tracks(spark, str(tmp_path), "m1").count() == 1


def test_calibration_archives(spark, tmp_path):
    np.savez(tmp_path / "c.npz", K0=np.eye(3), image_size=np.array([1280, 720]))
    got = {r.key: (r.shape, r.data) for r in files.read_calibrations(spark, str(tmp_path)).collect()}
    assert got["K0"] == ([3, 3], np.eye(3).ravel().tolist()) and got["image_size"][1] == [1280.0, 720.0]


def test_frames_are_numbered_by_name(spark, tmp_path):
    for n in ("b.png", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.frame_idx for r in files.read_frames(spark, str(tmp_path)).collect()}
    assert got == {"a.png": 0, "b.png": 1}


def test_background_stream_follows_a_running_model(spark):
    """Every flag of the stream against mean and variance kept by hand, pixel by pixel."""
    sf = "/root/testdata/sf0.001"
    got = {(r.session, r.camera, r.x, r.y, r.frame_idx): r.foreground for r in catalog.QUERIES["stream_background"](spark, sf).collect()}
    rows = sorted((r.session, r.camera, r.x, r.y, r.frame_idx, r.v) for r in view(spark, sf, "pixel_series").collect())
    want, key = {}, None
    for *pixel, frame, v in rows:
        if pixel != key:
            key, mean, var, n = pixel, 0.0, 0.0, 0
        want[(*pixel, frame)] = n > 0 and (v - mean) ** 2 > 40 * max(var, 4)
        n += 1
        a, step = max(0.05, 1 / n), v - mean
        mean, var = mean + a * step, (1 - a) * (var + a * step * step)
    assert got == want and any(want.values())


@pytest.mark.parametrize("size", [3, 7])
def test_closing_and_opening_by_an_ellipse(spark, size):
    rng = np.random.default_rng(size)
    w, h = 20, 14
    frames = rng.random((3, h, w)) < 0.6
    rows = [(1, 0, k, int(x), int(y)) for k in range(3) for y, x in np.argwhere(frames[k])] + [(1, 0, 0, -1, 3), (1, 0, 0, 25, 3)]
    mask = spark.createDataFrame(rows, "session long, camera int, frame_idx long, px int, py int")
    kernel = masks.ellipse(size)

    def step(m, grow):
        out = np.zeros_like(m)
        for y in range(h):
            for x in range(w):
                near = [m[y + b, x + a] for a, b in kernel if 0 <= y + b < h and 0 <= x + a < w]
                out[y, x] = any(near) if grow else all(near)
        return out

    for fn, order in ((masks.close, (True, False)), (masks.open_, (False, True))):
        got = {(r.frame_idx, r.px, r.py) for r in fn(mask, kernel, w, h).collect()}
        assert got == {(k, int(x), int(y)) for k in range(3) for y, x in np.argwhere(step(step(frames[k], order[0]), order[1]))}


def test_focal_scan_equals_singular_values_and_finds_the_focal_length(spark):
    """The scan's residuals against the definition by singular values, and the minimum within 3 % of a planted camera."""
    rng = np.random.default_rng(4)
    k = np.array([[900.0, 0, 640], [0, 900, 360], [0, 0, 1]])
    rows = []
    for i in range(40):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        t = rng.normal(size=3)
        e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ q
        f = np.linalg.inv(k).T @ e @ np.linalg.inv(k)
        rows.append((1, float(rng.random()), *(f / np.linalg.norm(f)).ravel().tolist()))
    names = ", ".join(f"f{i}{j} double" for i in range(3) for j in range(3))
    estimates = spark.createDataFrame(rows, f"session long, quality double, {names}")
    got = {r.f: r.cost for r in calibration.focal_scan(estimates, 1280, 720).collect()}
    assert len(got) == 300
    for f, cost in list(got.items())[::17]:
        own = np.array([[f, 0, 640], [0, f, 360], [0, 0, 1]])
        total = 0.0
        for _, quality, *m in rows:
            e = own.T @ np.array(m).reshape(3, 3) @ own
            s = np.linalg.svd(e / np.linalg.norm(e))[1]
            total += quality * np.sqrt(((2 * s**3 - (s**2).sum() * s) ** 2).sum())
        assert cost == pytest.approx(total / sum(r[1] for r in rows), abs=1e-6)
    assert abs(min(got, key=got.get) - 900) < 27
    assert calibration.focal_refine(estimates, 1280, 720).head().f == pytest.approx(900, abs=0.2)


def test_gates_and_advice(spark):
    estimates = spark.createDataFrame([(s, 0.5) for s in (1, 2) for _ in range(20 * s - 1)], "session long, quality double")
    result = spark.createDataFrame([(1, 900.0, 0.06, None, None), (2, 900.0, 0.04, 1.1, 0.5)], "session long, f double, residual double, scale double, rms double")
    got = {r.session: tuple(r)[1:] for r in calibration.gates(estimates, result, 1280, 720).collect()}
    assert got == {1: (False, True, False, False, None), 2: (True, True, True, True, True)}
    rows = [(1, 29, 0.05, 900.0, None), (2, 30, 0.06, 900.0, 1036.0), (3, 30, 0.05, 900.0, 1034.0)]
    said = {r.session: r.advice for r in calibration.advice(spark.createDataFrame(rows, "session long, n_good long, residual double, f_scan double, f_metric double")).collect()}
    assert said[1].startswith("more footage") and said[2] == "check radial distortion; check arena bounds and coverage" and said[3] == "solid"


@pytest.mark.parametrize("rounds", [1, 2])
def test_smoothing_moves_vertices_to_the_mean_of_their_neighbours(spark, rounds):
    faces = [(1, "a", "b", "c"), (1, "b", "c", "d"), (2, "a", "b", "c")]
    at = {(1, "a"): (0.0, 0.0, 0.0), (1, "b"): (3.0, 0.0, 1.0), (1, "c"): (0.0, 6.0, 2.0), (1, "d"): (9.0, 3.0, 0.0), (2, "a"): (1.0, 1.0, 1.0), (2, "b"): (5.0, 1.0, 1.0), (2, "c"): (1.0, 7.0, 4.0)}
    near = {}
    for session, *corners in faces:
        for v in corners:
            near.setdefault((session, v), set()).update((session, w) for w in corners if w != v)
    vertices = spark.createDataFrame([(*v, *xyz) for v, xyz in at.items()], "session long, v string, x double, y double, z double")
    neighbours = voxels.adjacency(spark.createDataFrame(faces, "session long, a string, b string, c string"), ["session"])
    found = {(r.session, r.v): (r.x, r.y, r.z) for r in voxels.laplacian(vertices, neighbours, ["session"], rounds).collect()}
    for _ in range(rounds):
        at = {v: np.mean([at[w] for w in sorted(near[v])], axis=0) for v in at}
    assert found.keys() == at.keys()
    assert all(np.allclose(found[v], at[v]) for v in at)


def test_mesh_text_counts_its_own_lines(spark):
    vertices = spark.createDataFrame([(1, c, float(k), 0.0, 0.0) for k, c in enumerate(("p", "q", "r", "s"))], "session long, v string, x double, y double, z double")
    faces = spark.createDataFrame([(1, "p", "q", "r"), (1, "s", "r", "q"), (1, "p", "q", "beyond")], "session long, a string, b string, c string")
    lines = [r.value for r in files.mesh_text(*files.numbered_mesh(vertices, faces, ["session"]), ["session"]).orderBy("part", "seq").collect()]
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 4"] and "element face 2" in lines
    assert lines[lines.index("end_header") + 1 :] == ["0.0000 0.0000 0.0000", "1.0000 0.0000 0.0000", "2.0000 0.0000 0.0000", "3.0000 0.0000 0.0000", "3 0 1 2", "3 3 2 1"]


def test_viewer_json_with_voxels_of_other_frames(spark):
    cells = spark.createDataFrame([(1, 0, 1.26, 2.0, 3.0), (1, 9, 5.0, 5.0, 5.0)], "session long, frame_idx long, x double, y double, z double")
    got = {r.frame_idx: json.loads(r.value) for r in files.viewer_json(track(spark, [0, 1]), cells).collect()}
    assert got[0]["voxels"] == [[1.3, 2.0, 3.0]] and "nose" in got[0]["kp"] and got[1]["voxels"] == [] and got[9]["kp"] == {}


def test_missing_frame_rate_falls_back(spark):
    rows = spark.createDataFrame([(30, 0.0), (30, None), (30, float("nan")), (30, 60.0)], "frame_idx long, fps double")
    got = [r.s for r in streams.with_event_time(rows, "fps").selectExpr("date_format(event_time, 's.SSS') AS s").collect()]
    assert got == ["1.000", "1.000", "1.000", "0.500"]


def test_remap_beyond_the_image_is_black(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0, 0, 8.0)], "session long, camera int, frame_idx long, x int, y int, v double")
    maps = spark.createDataFrame([(0, 0, 0, 0.0, 0.0), (0, 1, 0, 50.0, 0.0)], "camera int, ox int, oy int, sx double, sy double")
    assert {r.ox: r.v for r in masks.remap(pixels, maps).collect()} == {0: 8.0, 1: 0.0}


def test_body_landmarks_and_edges_agree(spark):
    names = landmarks.landmarks(spark)
    pairs = landmarks.edges(spark)
    assert names.count() == 33 and pairs.count() == 20
    assert pairs.join(names.withColumnRenamed("name", "a"), "a").join(names.select(F.col("name").alias("b")), "b").count() == 20
    assert landmarks.edges(spark, []).count() == 0


@pytest.mark.parametrize("x", [-0.1, 0.0, 19.9, 20.0])
def test_voxel_index_inverts_the_centre(spark, x):
    i = spark.range(1).select(g.voxel_index(F.lit(x), 20.0, -40.0).alias("i")).head().i
    centre = (i + 0.5) * 20 - 40
    assert abs(centre - x) <= 10 and i == int((x + 40) // 20)


NINE = ", ".join(f"f{i}{j} double" for i in range(3) for j in range(3))


def test_refinement_without_matches_or_matrices(spark):
    estimates = spark.createDataFrame([(1, 1, *[0.0] * 9, 0.5), (2, 1, *[float(v) for v in range(9)], 0.5)], f"session long, event_id long, {NINE}, quality double")
    focal = spark.createDataFrame([(1, 700.0), (2, 800.0)], "session long, f double")
    none = spark.createDataFrame([], "session long, event_id long, x0 double, y0 double, x1 double, y1 double")
    pose = {r.session: r for r in refinement.extrinsics(estimates, none, focal, 1280, 720).collect()}
    assert all(list(p.r) == [1, 0, 0, 0, 1, 0, 0, 0, 1] and list(p.t) == [1, 0, 0] and not p.found for p in pose.values()) and len(pose) == 2
    assert {(r.session, r.f_metric, r.scale) for r in refinement.metric_refine(estimates, none, focal, (1, 1, 1), 1280, 720).collect()} == {(1, 700.0, 1.0), (2, 800.0, 1.0)}
    assert {(r.session, r.f, r.cost) for r in refinement.bundle_scan(estimates, none, focal, 1280, 720).collect()} == {(1, 700.0, 1e6), (2, 800.0, 1e6)}
    assert {r.session: r.residual for r in calibration.mean_essential_residual(estimates, focal, 1280, 720).collect()}[1] == 1.0


def test_focal_estimation_without_an_arena(spark):
    estimates = matching.with_quality(view(spark, "/root/testdata/sf0.001", "rig_f_est")).where("session < 3")
    got = refinement.run_focal_estimation(estimates, None, 1280, 720).collect()
    assert got and all(r.f == r.f_scan and r.f_metric is None and r.scale is None and abs(r.f - 900) < 27 and 0 <= r.residual < 0.05 for r in got)


def test_silhouettes_are_cleaned_foreground(spark):
    """A square of 5 x 5 that lights up with a hole in it, beside a lone pixel: the square comes out filled and grown by one."""
    lit = {(x, y) for x in range(5, 10) for y in range(5, 10)} - {(7, 7)} | {(1, 1)}
    rows = [(1, 0, f, x, y, 250.0 if f == 30 and (x, y) in lit else 50.0 + (f + x) % 3) for f in range(31) for x in range(14) for y in range(14)]
    pixels = spark.createDataFrame(rows, "session long, camera int, frame_idx long, x int, y int, v double")
    got = {(r.px, r.py) for r in masks.silhouettes(pixels, 14, 14, ksize=3, min_area=9, grow=1).where("frame_idx = 30").collect()}
    assert {(x, y) for x in range(5, 10) for y in range(5, 10)} <= got and (1, 1) not in got and all(3 <= x <= 11 and 3 <= y <= 11 for x, y in got)


def test_remap_mixes_four_pixels(spark):
    pixels = spark.createDataFrame([(1, 0, 5, x, y, v) for x, y, v in ((0, 0, 0.0), (1, 0, 8.0), (0, 1, 16.0), (1, 1, 24.0))], "session long, camera int, frame_idx long, x int, y int, v double")
    maps = spark.createDataFrame([(0, 3, 2, 0.25, 0.5), (1, 0, 0, 0.0, 0.0)], "camera int, ox int, oy int, sx double, sy double")
    assert [(r.frame_idx, r.ox, r.oy, r.v) for r in masks.remap(pixels, maps).collect()] == [(5, 3, 2, 10.0)]


def test_ties_by_rounding_error_are_ties(spark, tmp_path):
    """Events 3 and 45533 have the same quality but for the last digit of a sum; 25, 49, 60 and 196 have a mean of just 1.5."""
    rows = spark.createDataFrame([(3, 1), (45533, 1), (25, 2), (49, 2), (60, 2), (196, 2)], "event_id long, user_id long").selectExpr("event_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "user_id", "'click' AS event_type")
    rows.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    place = {r.frame_idx: r.place for r in catalog.QUERIES["estimate_quality"](spark, str(tmp_path)).where("session = 1").collect()}
    assert place == {90: 1, 45533 * 30: 2}
    said = {r.session: r.advice for r in catalog.QUERIES["calibration_advice"](spark, str(tmp_path)).collect()}
    assert "distortion" not in said[2]
