"""Image folders as data sources, detectors opened and closed once a task, joint distortion fits."""

import os

import pytest

from stereolake.operators import alignment
from stereolake.plans.fixtures import view
from stereolake.sources import frames


class Counting:
    """Writes a line for each of its own openings and closings."""

    log = os.environ.get("DETECTOR_LOG", "/dev/null")

    def __init__(self):
        self._say("open")

    def _say(self, what):
        with open(self.log, "a") as out:
            out.write(f"{what}\n")

    def detect(self, content, frame_idx):
        if content == b"bad":
            raise ValueError("no image")
        return [("size", len(content), frame_idx, 1.0)] * (len(content) > 1)

    def close(self):
        self._say("close")


def folder(tmp_path, names):
    for session, camera, name, content in names:
        path = tmp_path / "in" / session / str(camera)
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(content)
    return str(tmp_path / "in")


NAMES = [("s1", 0, f"{n:03d}.png", b"x" * n) for n in range(10)] + [("s1", 1, "b.JPG", b"12"), ("s1", 1, "a.tif", b"123"), ("s1", 1, "c.txt", b"no"), ("s2", 0, "0.bmp", b"")]


def test_frames_are_numbered_and_cut_into_blocks(spark, tmp_path):
    df = frames.read(spark, folder(tmp_path, NAMES), block=4)
    got = sorted((r.session, r.camera, r.frame_idx, os.path.basename(r.path), bytes(r.content)) for r in df.collect())
    assert got == sorted([("s1", 0, n, f"{n:03d}.png", b"x" * n) for n in range(10)] + [("s1", 1, 0, "a.tif", b"123"), ("s1", 1, 1, "b.JPG", b"12"), ("s2", 0, 0, "0.bmp", b"")])
    assert df.rdd.getNumPartitions() == 3 + 1 + 1
    (tmp_path / "none").mkdir()
    assert frames.read(spark, str(tmp_path / "none")).count() == 0


def test_many_sessions_share_partitions_and_are_listed_by_tasks(spark, tmp_path):
    path = folder(tmp_path, [(f"s{n:02d}", n % 2, f"{k}.png", b"x" * (n + k)) for n in range(23) for k in range(1, 4)])
    df = spark.read.format("frames").option("partitions", "5").load(path)
    assert df.rdd.getNumPartitions() == 5
    assert sorted((r.session, r.camera, r.frame_idx, len(r.content)) for r in df.collect()) == [(f"s{n:02d}", n % 2, k - 1, n + k) for n in range(23) for k in range(1, 4)]
    listed = frames.FrameReader({"path": path, "partitions": "5"}).partitions()
    assert sum(len(p.sessions) for p in listed) == 23 and not any("png" in s for p in listed for s in p.sessions)


def test_detectors_open_and_close_once_a_task(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    # tasks import this module anew, so the path goes with the code that they load
    (tmp_path / "own_detector.py").write_text(f"from tests.test_frames import Counting as _C\n\n\nclass Counting(_C):\n    log = {str(log)!r}\n")
    spark.sparkContext.addPyFile(str(tmp_path / "own_detector.py"))
    got = sorted(tuple(r)[:4] + (r.px,) for r in frames.read(spark, folder(tmp_path, NAMES), "own_detector:Counting", block=4).collect())
    assert got == sorted([("s1", 0, n, "size", float(n)) for n in range(2, 10)] + [("s1", 1, 0, "size", 3.0), ("s1", 1, 1, "size", 2.0)])
    assert sorted(log.read_text().split()) == ["close"] * 5 + ["open"] * 5
    log.unlink()
    with pytest.raises(Exception, match="no image"):
        frames.read(spark, folder(tmp_path, [("s3", 0, "0.png", b"bad")]), "own_detector:Counting", block=100).collect()
    said = log.read_text().split()
    assert said.count("open") == said.count("close")


def test_brightest_pixel():
    found = frames.Brightest().detect
    assert found(b"P5 4 3 255 " + bytes([0, 0, 0, 0, 0, 9, 200, 0, 200, 0, 0, 1]), 0) == [("brightest", 2, 1, 200 / 255)]
    assert found(b"P5 3 1 255 " + b"\n\x20\x01", 0) == [("brightest", 1, 0, 32 / 255)]
    assert found(b"P5 1 1 255 \x00", 0) == found(b"", 0) == found(b"JFIF", 0) == []


def bent(k, session, camera, n_edges):
    rows = []
    for e in range(n_edges):
        for n in range(21):
            u, v = -0.6 + 1.2 * n / 20, -0.35 + 0.2 * e + 0.1 * e * (n / 20)
            r = u * u + v * v
            d = 1 + k[0] * r + k[1] * r**2 + k[2] * r**3
            rows.append((session, camera, f"e{e}", 900 * u * d + 640, 900 * v * d + 360))
    return rows


def test_coefficients_that_interact_are_found_together(spark):
    planted = {(1, 0): (-0.3, 0.12, -0.04), (1, 1): (0.1, -0.05, 0.02), (2, 0): (0.0, 0.0, 0.0)}
    rows = [r for (s, c), k in planted.items() for r in bent(k, s, c, 4)] + bent((-0.1, 0, 0), 2, 1, 2)
    edges = spark.createDataFrame(rows, "session long, camera int, label string, x double, y double")
    got = {(r.session, r.camera): r for r in alignment.fit_distortion(edges, 900.0, 640.0, 360.0).collect()}
    for key, k in planted.items():
        r = got[key]
        assert r.converged and r.n_edges == 4 and r.rmse < 1e-3
        assert (r.k1, r.k2, r.k3) == pytest.approx(k, abs=2e-3)
    few = got[2, 1]
    assert (few.n_edges, few.k1, few.rmse, few.converged) == (2, None, None, False)


def test_cameras_whose_search_once_stuck(spark):
    edges = view(spark, "/root/testdata/sf0.01", "bent_edges").where("session IN (6, 35, 36, 51)")
    got = {r.session: r for r in alignment.fit_distortion(edges, 900.0, 640.0, 360.0).collect()}
    for session, k in {6: (-0.23, 0.05, 0.0), 35: (-0.25, 0.07, 0.01), 36: (-0.23, 0.05, 0.0), 51: (-0.23, 0.05, 0.01)}.items():
        r = got[session]
        assert r.converged and r.rmse < 1e-3 and (r.k1, r.k2, r.k3) == pytest.approx(k, abs=2e-3)
