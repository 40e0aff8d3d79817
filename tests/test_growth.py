"""What must not depend on how large Spark takes its inputs to be."""

import numpy as np
import pytest

from stereolake.operators import alignment, calibration, matching, refinement
from stereolake.plans import catalog
from stereolake.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["essential_motion", "smooth_mesh", "mesh_text"])
def test_sides_that_grow_are_never_broadcast(spark, name):
    """Small files of events or packed grids become large lists; only the table of a cell's triangles may be sent to all."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Initial Plan")[0]
    assert first.count("BroadcastHashJoin") == (0 if name == "essential_motion" else first.count("BroadcastHashJoin [code#"))


def test_a_focal_scan_sums_sessions_before_it_shuffles(spark):
    """Estimates in turn from ten sessions: the scan's arrays go through the shuffle once a session and task, not once an estimate."""
    grow = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    names = [f"f{i}{j}" for i in range(3) for j in range(3)]
    rows = spark.range(0, 20000, 1, 8).selectExpr("id % 1000 AS session", "1.0D AS quality", *[f"cast((id * {n + 3}) % 101 AS double) AS {c}" for n, c in enumerate(names)])
    before = grow()
    got = calibration.focal_scan(rows, 1280, 720)
    assert got.count() == 300_000
    assert grow() - before < 8_000_000


def test_a_session_of_an_archive_is_in_few_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).selectExpr("id % 10 AS session", "id div 10 AS frame_idx", "1.0D AS x", "2.0D AS y", "3.0D AS z")
    files.write_clouds(rows, str(tmp_path / "clouds"))
    assert spark.read.parquet(str(tmp_path / "clouds")).count() == 4000
    assert len(list((tmp_path / "clouds").glob("session=*/*.parquet"))) <= 10 + 4


def test_reprojection_decomposes_estimates_not_points(monkeypatch):
    """What is tried at a focal length is solved for all matches in arrays, with the results of one decomposition for each match."""
    svd, asked = np.linalg.svd, []
    monkeypatch.setattr(np.linalg, "svd", lambda a, *more, **named: asked.append(a.shape) or svd(a, *more, **named))
    rng = np.random.default_rng(5)
    turn, shift = np.array([[0.96, 0, 0.28], [0, 1, 0], [-0.28, 0, 0.96]]), np.array([1.0, 0.2, 0.3])
    k = np.array([[900.0, 0, 640], [0, 900, 360], [0, 0, 1]])
    e = np.array([[0, -shift[2], shift[1]], [shift[2], 0, -shift[0]], [-shift[1], shift[0], 0]]) @ turn
    x = np.column_stack([rng.uniform(-2, 2, (30, 2)), rng.uniform(4, 7, 30)])
    a, b = x @ k.T, (x @ turn.T + shift) @ k.T
    points = np.hstack([a[:, :2] / a[:, 2:], b[:, :2] / b[:, 2:]]) + rng.normal(0, 0.5, (30, 4))
    m = np.linalg.inv(k).T @ e @ np.linalg.inv(k)
    sizes, f = np.array([12, 0, 4, 14]), np.array([[850.0, 900.0]] * 4)
    got = refinement._reprojection(np.array([m] * 4), points, sizes, f, 640.0, 360.0)
    assert {shape[1:] for shape in asked} == {(3, 3)} and len(asked) == 2
    assert np.isnan(got[1:3]).all()
    for at, part in ((0, points[:12]), (3, points[16:])):
        for n, focal in enumerate(f[at]):
            own = np.diag([focal, focal, 1.0]) + [[0, 0, 640], [0, 0, 360], [0, 0, 0]]
            p0, p1 = own @ np.eye(3, 4), own @ _motion(own.T @ m @ own, np.linalg.inv(own), part)
            errors = []
            for p in part:
                h = svd(np.array([p[0] * p0[2] - p0[0], p[1] * p0[2] - p0[1], p[2] * p1[2] - p1[0], p[3] * p1[2] - p1[1]]))[2][-1]
                errors += [((v[:2] / v[2] - q) ** 2).sum() for v, q in ((p0 @ h, p[:2]), (p1 @ h, p[2:]))]
            assert got[at, n] == pytest.approx(sum(errors) / len(errors), rel=1e-9)


def _motion(e, inverse, points):
    """Of the four motions the one with most points in front, by the depths of two rays."""
    r, t = calibration.options_of(e[None])
    one = np.ones((len(points), 1))
    a, b = np.hstack([points[:, :2], one]) @ inverse.T, np.hstack([points[:, 2:], one]) @ inverse.T
    front = []
    for turn, shift in zip(r[0], t[0]):
        depths = [np.linalg.lstsq(np.column_stack([turn @ p, -q]), -shift, rcond=None)[0] for p, q in zip(a, b)]
        front.append(sum((d > 0).all() for d in depths))
    best = int(np.argmax(front))
    return np.column_stack([r[0][best], t[0][best]])


def test_a_distortion_scan_shuffles_points_once(spark):
    """Rounds shuffle sums, a row for an edge: four times the rounds don't shuffle the points again."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    edges = spark.range(0, 120000, 1, 4).selectExpr("id % 3 AS session", "0 AS camera", "concat('e', id % 4) AS label", "cast(id * 37 % 1001 AS double) AS x", "cast(id * 53 % 701 AS double) AS y")
    used = []
    for rounds in (1, 3):
        before = written()
        assert alignment.distortion_scan(edges, 900.0, 640.0, 360.0, rounds=rounds).count() == 3
        used.append(written() - before)
    assert used[1] - used[0] < 1_000_000


def test_folders_are_written_by_the_tasks_themselves(spark, tmp_path):
    """A file for each key and part, whole and in order, and nothing of Spark's file writers around it."""
    lines = spark.range(0, 30000, 1, 4).selectExpr("if(id % 7 = 0, NULL, id % 7) AS session", "id % 2 AS kind", "id AS seq", "if(id = 8, NULL, cast(id AS string)) AS value")
    files.write_lines(lines, ["session"], ["seq"], str(tmp_path / "lines"), apart=["kind"])
    got = {}
    for f in (tmp_path / "lines").rglob("*"):
        if f.is_file():
            seqs = [int(x or 8) for x in f.read_text().splitlines()]
            got[f.parent.name, seqs[0] % 2] = seqs
    names = {k: "__HIVE_DEFAULT_PARTITION__" if k == 0 else str(k) for k in range(7)}
    assert got == {(f"session={names[k]}", kind): [n for n in range(kind, 30000, 2) if n % 7 == k] for k in range(7) for kind in (0, 1)}
    assert len([f for f in (tmp_path / "lines").rglob("*") if f.is_file()]) == 14
    files.write_tables(lines, ["session", "kind"], ["seq"], "file://" + str(tmp_path / "tables"))
    back = spark.read.parquet(str(tmp_path / "tables"))
    assert sorted(map(tuple, back.select("seq", "value").collect())) == sorted(map(tuple, lines.select("seq", "value").collect()))
    assert back.where("session IS NULL").count() == 4286
    assert not list(tmp_path.rglob("*.crc")) and not list(tmp_path.rglob("_*"))


def test_masks_are_shuffled_as_keypoints(spark):
    """Keypoints go through the shuffle, not the 25 pixels that each becomes."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    for name in ("silhouette_moments", "surface_voxels"):
        before = written()
        catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        assert written() - before < 170_000, name


def test_a_union_is_dealt_anew_before_it_is_written(spark):
    """Parts of a union that are dealt by the key already are read in ranges of partitions of their own; one more shuffle puts a key together."""
    parts = [spark.range(n).selectExpr("id % 50 AS session", "id AS seq").groupBy("session").agg({"seq": "sum"}) for n in (100, 5000)]
    plan = files._together(parts[0].union(parts[1]), ["session"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(xxhash64(session" in plan.split("Union")[0]


def test_a_sample_of_eight_needs_no_large_decomposition(monkeypatch):
    """Eight equations leave one direction open, which is the last singular vector; only 3x3 matrices are decomposed."""
    svd, asked = np.linalg.svd, []
    rng = np.random.default_rng(3)
    a, b = rng.random((40, 8, 2)) * 900, rng.random((40, 8, 2)) * 900
    monkeypatch.setattr(np.linalg, "svd", lambda m, *more, **named: asked.append(m.shape) or svd(m, *more, **named))
    got = matching._eight_points(a, b)
    assert asked == [(40, 3, 3)]
    one = np.ones((40, 8, 1))
    met = np.einsum("nmi,nij,nmj->nm", np.concatenate([b, one], 2), got, np.concatenate([a, one], 2))
    assert (svd(got)[1][:, 2] < 1e-12).all() and np.linalg.norm(got, axis=(1, 2)) == pytest.approx(np.ones(40))
    monkeypatch.undo()
    more = matching._eight_points(np.concatenate([a, a], 1), np.concatenate([b, b], 1))  # the same equations twice, by the least singular value
    assert np.abs(np.einsum("nij,nij->n", got, more)) == pytest.approx(np.ones(40), abs=1e-6) and np.isfinite(met).all()


def _pairs_of_views(n, points, rng, noise=0.5):
    """Estimates (n, 3, 3) in pixels and their matches, so many each."""
    k, found, seen = np.array([[900.0, 0, 640], [0, 900, 360], [0, 0, 1]]), [], []
    for count in points:
        a, shift = rng.uniform(0.1, 0.5), np.array([1.0, *rng.uniform(0.1, 0.5, 2)])
        turn = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
        e = np.array([[0, -shift[2], shift[1]], [shift[2], 0, -shift[0]], [-shift[1], shift[0], 0]]) @ turn
        x = np.column_stack([rng.uniform(-2, 2, (count, 2)), rng.uniform(4, 7, count)])
        p, q = x @ k.T, (x @ turn.T + shift) @ k.T
        seen.append(np.hstack([p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]]) + rng.normal(0, noise, (count, 4)))
        found.append(np.linalg.inv(k).T @ e @ np.linalg.inv(k))
    return np.array(found), np.concatenate(seen)


def test_focal_lengths_share_a_decomposition(monkeypatch):
    """However many are tried, an estimate is decomposed once; estimates of any size give the same in blocks of any size."""
    sizes = np.array([12, 8, 0, 30, 12, 5, 4, 12])
    m, points = _pairs_of_views(len(sizes), sizes, np.random.default_rng(8))
    f = 900 * np.exp(np.outer(np.ones(len(sizes)), np.linspace(-0.1, 0.1, 21)))
    svd, asked = np.linalg.svd, []
    monkeypatch.setattr(np.linalg, "svd", lambda a, *more, **named: asked.append(len(a)) or svd(a, *more, **named))
    got = refinement._reprojection(m, points, sizes, f, 640.0, 360.0)
    assert sum(asked) == 7  # those with matches
    assert np.isfinite(got[[0, 1, 3, 4, 5, 7]]).all() and np.isnan(got[[2, 6]]).all()
    for block in (1, 13, 40):
        monkeypatch.setattr(refinement, "POINTS_AT_ONCE", block)
        assert np.allclose(refinement._reprojection(m, points, sizes, f, 640.0, 360.0), got, rtol=1e-9, atol=0, equal_nan=True)


@pytest.mark.parametrize("rank", [2, 3])
def test_motions_in_parts_are_those_of_a_decomposition(rank):
    """Of matrices of rank 2 in closed form, of others by one decomposition for each focal length: the same four motions."""
    rng = np.random.default_rng(11)
    m, _ = _pairs_of_views(6, [1] * 6, rng)
    if rank == 3:
        m = m * rng.uniform(0.8, 1.2, m.shape)
    f = 900 * np.exp(np.outer(np.ones(6), np.linspace(-0.5, 0.5, 5)))
    b, t, v, sound = refinement._motion_parts(m, f, 640.0, 360.0)
    assert sound.all()
    for at in range(5):
        r, d = calibration.options_of(calibration.essentials(m, f[:, at], 640.0, 360.0))
        for n in range(6):
            both = [np.outer(t[n, at], v[n, at]) + sign * b[n, at] for sign in (1, -1)]
            assert all(np.allclose(q.T @ q, np.eye(3)) and np.linalg.det(q) > 0 for q in both)
            assert all(min(np.abs(q - own).max() for q in both) < 1e-8 for own in r[n]) and np.abs(np.abs(t[n, at] @ d[n].T) - 1).max() < 1e-8


def test_focal_lengths_are_estimated_with_one_shuffle_of_matches(spark):
    """Also where sessions are too many for Spark's size check: matches are gathered once and lie in one table."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        assert catalog.QUERIES["run_focal_estimation"](spark, SF).count() == 15
        assert written() - before < 1_700_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
