"""Files that tasks wrote are read back by tasks: the driver neither lists nor holds them."""

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from stereolake.plans import catalog
from stereolake.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 5, 1 << 22])
def test_lines_are_those_of_the_text_source(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK", block)
    texts = [b"a,1\nb,2\n", b"a\r\nb\r\n\r\nc", b"a\rb\r", b"", b"\n", "é, x\n\nlast".encode(), b"one\r\n"]
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.txt").write_bytes(text)
    paths = spark.createDataFrame([(n, f"file://{tmp_path}/{n}.txt" if n % 2 else f"{tmp_path}/{n}.txt") for n in range(len(texts))], "id int, file string")
    got = sorted((r.id, r.value) for r in files.read_lines(paths).collect())
    name = F.regexp_extract(F.col("_metadata.file_path"), "([0-9]+).txt$", 1).cast("int")
    assert got == sorted((r.id, r.value) for r in spark.read.text(str(tmp_path)).select(name.alias("id"), "value").collect())
    assert [(r.id, r.value) for r in files.read_texts(paths).orderBy("id").collect()] == [(n, t.decode()) for n, t in enumerate(texts)]


def test_writers_tell_their_files(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 3).selectExpr("if(id % 5 = 0, NULL, id % 5) AS session", "cast(id div 5 AS int) AS frame_idx", "cast(id AS double) AS x", "2.0D AS y", "3.0D AS z")
    for path in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        written = files.write_clouds(rows, path)
        assert all(r.file.startswith(path) for r in written.collect())
        back = files.read_tables(written, "frame_idx bigint, x float").select("session", "frame_idx", "x")
        assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.selectExpr("session", "cast(frame_idx AS bigint) AS frame_idx", "cast(x AS float) AS x").collect()))
    assert files.read_tables(written.limit(0), "x float").count() == 0


@pytest.mark.parametrize("name", ["read_wide_tracks", "voxel_archive"])
def test_the_driver_lists_no_folder_of_a_session(spark, monkeypatch, name):
    """Only tables in the shared folder are read by path, none of a folder for each session."""
    seen = []
    for kind in ("text", "parquet"):
        monkeypatch.setattr(DataFrameReader, kind, lambda self, *paths, plain=getattr(DataFrameReader, kind), **more: seen.extend(map(str, paths)) or plain(self, *paths, **more))
    assert catalog.QUERIES[name](spark, SF).count() > 0
    assert seen and not [p for p in seen if "/wide-tracks-" in p or "/clouds-" in p]


def test_a_run_keeps_the_files_of_its_stages(spark, monkeypatch):
    seen = []
    for kind in ("text", "parquet", "json"):
        monkeypatch.setattr(DataFrameReader, kind, lambda self, *paths, plain=getattr(DataFrameReader, kind), **more: seen.extend(map(str, paths)) or plain(self, *paths, **more))
    assert catalog.QUERIES["reconstruct"](spark, SF).count() > 0
    folders = {p.rsplit("/", 1)[1].split("-")[0] for p in seen if "/run-" in p and not p.endswith("-files")}
    assert folders <= {"manifest", "hulls", "points", "tracks", "metadata", "header"}
