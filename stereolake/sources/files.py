"""Readers and writers of trackers', calibrations' and viewers' files, all sessions at once."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from io import BytesIO
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import trajectory
from . import tables

HEADERS = ("scorer", "individuals", "bodyparts", "coords")


def read_wide_tracks(spark: SparkSession, paths: str | list[str] | DataFrame, individual: str | None = None, min_likelihood: float = 0.1) -> DataFrame:
    """(file, frame_idx, name, x, y, confidence) of wide tracker files: three or four header rows, then a row a frame.

    Header rows are known by their first cell, so splits of files don't matter. Cells that aren't numbers drop the
    landmark of that row only; of equal names in a frame the last column wins. Names are individual_bodypart where there
    are individuals. Rows whose label is no number are dropped. paths may be a table of them, in a column `file`, which the
    driver doesn't list or hold.
    """
    text = read_lines(paths.select("file")) if isinstance(paths, DataFrame) else spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = text.select("file", F.split("value", ",", -1).alias("cells")).where("size(cells) > 1")
    lines = tables.cut(lines, "lines")  # heads and rows; many small files cost more to open than to read
    first = F.trim(F.col("cells")[0])
    heads = lines.where(first.isin(*HEADERS)).select("file", first.alias("kind"), F.posexplode("cells").alias("col", "cell")).where("col > 0")
    heads = heads.groupBy("file", "col").agg(*[F.max(F.when(F.col("kind") == k, F.trim("cell"))).alias(k) for k in HEADERS])
    names = heads.where(F.lower("coords") == "x").select("file", F.col("col").alias("at"), F.concat_ws("_", "individuals", "bodyparts").alias("name"), "individuals")
    if individual is not None:
        names = names.where(F.col("individuals").isNull() | (F.col("individuals") == individual))
    rows = lines.where(~first.isin(*HEADERS)).withColumn("frame_idx", F.expr("try_cast(cells[0] AS DOUBLE)").cast("bigint")).where("frame_idx IS NOT NULL")
    cell = lambda n: F.expr(f"try_cast(get(cells, at + {n}) AS DOUBLE)")
    met = rows.join(names, "file").select("file", "frame_idx", "name", "at", cell(0).alias("x"), cell(1).alias("y"), cell(2).alias("confidence"))
    good = met.where("x IS NOT NULL AND y IS NOT NULL AND confidence IS NOT NULL").where(F.col("confidence") >= min_likelihood)
    last = good.groupBy("file", "frame_idx", "name").agg(F.max_by(F.struct("x", "y", "confidence"), "at").alias("k"))
    return last.select("file", "frame_idx", "name", "k.*")


def read_long_tracks(spark: SparkSession, paths: str | list[str], individual: str | None = None, min_likelihood: float = 0.1) -> DataFrame:
    """(file, frame_idx, name, x, y, confidence) of long tracker files (frame_idx, track, node, x, y[, score]); a missing score is 1."""
    raw = spark.read.csv(paths, header=True).withColumn("file", F.col("_metadata.file_path"))
    score = F.expr("coalesce(try_cast(score AS DOUBLE), 1.0D)") if "score" in raw.columns else F.lit(1.0)
    rows = raw.select("file", F.expr("try_cast(frame_idx AS BIGINT)").alias("frame_idx"), F.col("node").alias("name"), F.col("track"), F.expr("try_cast(x AS DOUBLE)").alias("x"), F.expr("try_cast(y AS DOUBLE)").alias("y"), score.alias("confidence"), F.monotonically_increasing_id().alias("pos"))
    if individual is not None:
        rows = rows.where(F.col("track").isNull() | (F.col("track") == "") | (F.col("track") == individual))
    good = rows.where("frame_idx IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").where(F.col("confidence") >= min_likelihood)
    return good.groupBy("file", "frame_idx", "name").agg(F.max_by(F.struct("x", "y", "confidence"), "pos").alias("k")).select("file", "frame_idx", "name", "k.*")


def read_corners(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Corner correspondences; a row that doesn't parse is an error, pixels that aren't numbers are null."""
    numbers = ["rec_x", "rec_y", "rec_z", "arena_x", "arena_y", "arena_z"]
    pixels = ["px0_x", "px0_y", "px1_x", "px1_y"]
    schema = ", ".join([*[f"{n} double" for n in numbers], "label string", *[f"{n} double" for n in pixels]])
    rows = spark.read.csv(paths, schema=schema, header=True, mode="FAILFAST", nanValue="NaN")
    return rows.select(*numbers, F.trim("label").alias("label"), *[F.when(~F.isnan(p), F.col(p)).alias(p) for p in pixels])


def read_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, edge_id, camera, label, pos, x, y): polylines between separator rows; the last one needs none after it."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("line", "row")).where("line > 0 AND trim(row) <> ''")
    by_line = Window.partitionBy("file").orderBy("line")
    marked = text.withColumn("separator", F.trim("row").startswith("---").cast("int")).withColumn("edge_id", F.sum("separator").over(by_line)).where("separator = 0")
    cells = F.split("row", ",")
    pos = F.row_number().over(Window.partitionBy("file", "edge_id").orderBy("line"))
    return marked.select("file", "edge_id", F.trim(cells[0]).cast("int").alias("camera"), F.trim(cells[1]).alias("label"), pos.alias("pos"), cells[2].cast("double").alias("x"), cells[3].cast("double").alias("y"))


def read_calibrations(spark: SparkSession, paths: str) -> DataFrame:
    """(path, key, shape, data) of every named array of calibration archives."""

    def load(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with np.load(BytesIO(content), allow_pickle=False) as z:
                    rows += [(path, k, list(z[k].shape), np.asarray(z[k], dtype=float).ravel().tolist()) for k in z.files if z[k].dtype.kind in "fiub"]
            yield pd.DataFrame(rows, columns=["path", "key", "shape", "data"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(load, "path string, key string, shape array<int>, data array<double>")


def write_calibrations(calib: DataFrame, path: str) -> DataFrame:
    """Writes (session, fields) as archives <path>/session-<session>.npz and returns the sessions; run by an action.

    fields: an array of (key, shape, data) with the numbers of each named array row by row. Paths may be of any file system
    that pyarrow opens.
    """

    def run(batches):
        store, root = store_of(path)
        for batch in batches:
            for session, fields in zip(batch["session"], batch["fields"]):
                content = BytesIO()
                np.savez(content, **{f["key"]: np.array(f["data"], dtype=float).reshape([int(n) for n in f["shape"]]) for f in fields})
                store.create_dir(root, recursive=True)
                with store.open_output_stream(f"{root}/session-{session}.npz") as out:
                    out.write(content.getvalue())
            yield batch[["session"]]

    return calib.select("session", "fields").mapInPandas(run, "session bigint")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, of any kind that pyarrow opens, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_frames(spark: SparkSession, paths: str, glob: str = "*.{png,jpg,jpeg,bmp,tif,tiff}") -> DataFrame:
    """(dir, frame_idx, path, content): image files numbered from 0 in the order of their names within a directory."""
    from pyspark.sql import Window

    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return rows.select(folder.alias("dir"), (F.row_number().over(Window.partitionBy(folder).orderBy("path")) - 1).alias("frame_idx"), "path", "content")


def detect(frames: DataFrame, detector) -> DataFrame:
    """Keypoints of frames by a user's detector: a context manager made once a task whose detect_batch takes a DataFrame
    of frames and returns one of (session, camera, frame_idx, name, px, py, confidence)."""

    def run(batches):
        with detector() as d:
            for pdf in batches:
                yield d.detect_batch(pdf)

    return frames.mapInPandas(run, "session bigint, camera int, frame_idx bigint, name string, px double, py double, confidence double")


def fixed(column: str, digits: int) -> F.Column:
    return F.format_string(f"%.{digits}f", F.col(column))


def stats_csv(stats: DataFrame) -> DataFrame:
    """Statistics with four decimals, as text columns."""
    return stats.select("session", "name", fixed("detection_rate", 4).alias("detection_rate"), F.col("n_detected").cast("string").alias("n_detected"), fixed("mean_repr_err", 4).alias("mean_repr_err"), fixed("max_repr_err", 4).alias("max_repr_err"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def viewer_frames(kp3d: DataFrame) -> DataFrame:
    """(session, frame_idx, kp): landmarks of a frame as a map from name to x, y, z and confidence, rounded for the viewer."""
    value = F.array(F.round("x", 2), F.round("y", 2), F.round("z", 2), F.round("confidence", 3))
    entries = F.array_sort(F.collect_list(F.struct("name", value.alias("value"))))
    return kp3d.groupBy("session", "frame_idx").agg(F.map_from_entries(entries).alias("kp"))


def viewer_json(kp3d: DataFrame, voxels: DataFrame | None = None) -> DataFrame:
    """(session, frame_idx, value): a frame's landmarks, and with voxels (session, frame_idx, x, y, z) its cells to one decimal, as JSON."""
    frames = viewer_frames(kp3d)
    if voxels is None:
        return frames.select("session", "frame_idx", F.to_json(F.struct("kp")).alias("value"))
    cell = F.array(*[F.round(v, 1) for v in "xyz"])
    cells = voxels.groupBy("session", "frame_idx").agg(F.array_sort(F.collect_list(cell)).alias("voxels"))
    both = frames.join(cells, ["session", "frame_idx"], "full")
    empty = [F.coalesce("kp", F.create_map().cast("map<string,array<double>>")).alias("kp"), F.coalesce("voxels", F.array().cast("array<array<double>>")).alias("voxels")]
    return both.select("session", "frame_idx", F.to_json(F.struct(*empty)).alias("value"))


def viewer_header(kp3d: DataFrame, edges: DataFrame, fps: float = 30.0) -> DataFrame:
    """(session, fps, names, edges, x_min .. z_max): sorted names, edges (a, b) as pairs of their positions, bounds of the points."""
    indexed = trajectory.names_indexed(kp3d)
    names = indexed.groupBy("session").agg(F.array_sort(F.collect_list("name")).alias("names"))
    pairs = trajectory.edge_index(edges, indexed).groupBy("session").agg(F.array_sort(F.collect_list(F.array("ia", "ib"))).alias("edges"))
    out = names.join(pairs, "session", "left").join(trajectory.world_bounds(kp3d), "session")
    return out.withColumns({"fps": F.lit(float(fps)), "edges": F.coalesce("edges", F.array().cast("array<array<int>>"))})


def point_cloud_lines(points: DataFrame, key: list[str], color: tuple[int, int, int] | None = None) -> DataFrame:
    """(key, seq, value): lines of a text point cloud for each group of (key, pos, x, y, z); groups without points have none."""
    properties = ["property float x", "property float y", "property float z"] + [f"property uchar {c}" for c in ("red", "green", "blue")] * bool(color)
    counts = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    head = F.array(*[F.lit(x) for x in ("ply", "format ascii 1.0")], F.concat(F.lit("element vertex "), F.col("n").cast("string")), *[F.lit(x) for x in (*properties, "end_header")])
    heads = counts.select(*key, F.posexplode(head).alias("at", "value")).select(*key, (F.col("at") - 100).cast("bigint").alias("seq"), "value")
    tail = F.lit("" if color is None else " %d %d %d" % color)
    body = points.select(*key, F.col("pos").cast("bigint").alias("seq"), F.concat(F.format_string("%.4f %.4f %.4f", "x", "y", "z"), tail).alias("value"))
    return heads.unionByName(body)


def mesh_lines(vertices: DataFrame, faces: DataFrame, key: list[str]) -> DataFrame:
    """(key, part, seq, value): vertex and face lines of text meshes; vertices (key, vid, x, y, z), faces (key, fid, a, b, c)."""
    v = vertices.select(*key, F.lit(1).alias("part"), F.col("vid").cast("bigint").alias("seq"), F.format_string("%.4f %.4f %.4f", "x", "y", "z").alias("value"))
    f = faces.select(*key, F.lit(2).alias("part"), F.col("fid").cast("bigint").alias("seq"), F.format_string("3 %d %d %d", "a", "b", "c").alias("value"))
    return v.unionByName(f)


def numbered_mesh(vertices: DataFrame, faces: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices (key, v, x, y, z) and faces (key, a, b, c) of named corners with whole numbers from 0 within each mesh, as mesh_lines wants them.

    Faces with a corner that is no vertex, at the edge of the grid, go. Corners are looked up in merge joins: how many there
    are doesn't show in the size of the packed grids that they come from, so a broadcast could fill the driver.
    """
    window = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    ids = vertices.withColumn("vid", window("v"))
    for corner in "abc":
        faces = faces.join(ids.select(*key, F.col("v").alias(corner), F.col("vid").alias(f"_{corner}")).hint("merge"), [*key, corner])
    numbered = faces.select(*key, *[F.col(f"_{corner}").alias(corner) for corner in "abc"])
    return ids, numbered.withColumn("fid", window("a", "b", "c"))


def mesh_text(vertices: DataFrame, faces: DataFrame, key: list[str]) -> DataFrame:
    """mesh_lines with each mesh's header before them, as part 0."""
    sizes = vertices.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(faces.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).hint("merge"), key, "left")
    count = lambda word, n: F.concat(F.lit(f"element {word} "), F.coalesce(n, F.lit(0)).cast("string"))
    head = [F.lit("ply"), F.lit("format ascii 1.0"), count("vertex", F.col("n")), *[F.lit(f"property float {v}") for v in "xyz"], count("face", F.col("m")), F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    heads = sizes.select(*key, F.lit(0).alias("part"), F.posexplode(F.array(*head)).alias("seq", "value")).withColumn("seq", F.col("seq").cast("bigint"))
    return heads.unionByName(mesh_lines(vertices, faces, key))


def whole_meshes_text(meshes: DataFrame, key: list[str]) -> DataFrame:
    """mesh_text of meshes (key, vertices, faces) that are a row each; lines come out in order, where the row is."""
    count = lambda word, of: F.concat(F.lit(f"element {word} "), F.size(of).cast("string"))
    head = [F.lit("ply"), F.lit("format ascii 1.0"), count("vertex", "vertices"), *[F.lit(f"property float {v}") for v in "xyz"], count("face", "faces"), F.lit("property list uchar int vertex_indices"), F.lit("end_header")]
    line = lambda part: lambda value, seq: F.struct(F.lit(part).alias("part"), seq.cast("bigint").alias("seq"), value.alias("value"))
    vertices = F.transform("vertices", lambda p: F.format_string("%.4f %.4f %.4f", p["x"], p["y"], p["z"]))
    faces = F.transform("faces", lambda f: F.format_string("3 %d %d %d", f[0], f[1], f[2]))
    lines = [F.transform(values, line(part)) for part, values in enumerate((F.array(*head), vertices, faces))]
    return meshes.select(*key, F.inline(F.concat(*lines)))


class _Lines:
    """A text file of the rows' only column."""

    end = ".txt"

    def __init__(self, out: pa.NativeFile, schema: pa.Schema):
        self.out = out

    def write(self, rows: pa.RecordBatch) -> None:
        lines = pc.fill_null(rows[0], "")
        self.out.write(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer())
        self.out.write(b"\n")

    def close(self) -> None:
        self.out.close()


class _Table:
    """A Parquet file."""

    end = ".parquet"

    def __init__(self, out: pa.NativeFile, schema: pa.Schema):
        self.out, self.table = out, pq.ParquetWriter(out, schema)

    def write(self, rows: pa.RecordBatch) -> None:
        self.table.write_batch(rows)

    def close(self) -> None:
        self.table.close()
        self.out.close()


def _changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Positions of the rows that differ from the one before in one of the columns."""
    new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for c in columns:
        a, b = batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)
        new |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | np.asarray(pc.xor(a.is_null(), b.is_null()))
    return np.flatnonzero(new) + 1


def write_folders(rows: DataFrame, key: list[str], form: Callable, path: str, apart: list[str] | None = None, prefix: str = "part", ranges: bool = False) -> DataFrame:
    """Rows, in order of the key within each task, as files <path>/<key>=<value>/... of the columns that aren't in the key.

    Returns the files, (key, file), a table that `read_lines`, `read_texts` and `read_tables` take: where folders are many,
    listing them takes the driver more time and memory than all else.

    Tasks open files one after the other themselves: there is no job of Spark's writers, which for a folder of each key
    costs more than what is written into it. A file gets its name when it is whole, so what a failed or a
    slower attempt leaves is hidden or the same file. apart: columns, in order after the key, of which each value begins a
    new file. Paths may be of any file system that pyarrow opens.
    """
    apart = apart or []
    rest = [c for c in rows.columns if c not in (*key, *apart)]
    null = "__HIVE_DEFAULT_PARTITION__"

    def run(batches):
        store, root = store_of(path)
        stem = f"{prefix}-{TaskContext.get().partitionId():05d}" if ranges else prefix
        attempt = uuid.uuid4().hex
        last, file, names, done = None, None, None, []

        def closed():
            if file is not None:
                file.close()
                store.move(*names)
                done.append([*last[: len(key)], head + names[1]])

        def told():
            columns = zip(*done) if done else [[]] * len(made.names)
            own = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, made.types)], made.names)
            done.clear()
            return own

        for batch in batches:
            own, edges = batch.select(rest), [0, *_changes(batch, [*key, *apart]).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                at = [batch[c][lo].as_py() for c in (*key, *apart)]
                if at != last:
                    closed()
                    folder = "/".join([root, *[f"{k}={null if v is None else quote(str(v), safe=' ')}" for k, v in zip(key, at)]])
                    if last is None or at[: len(key)] != last[: len(key)]:
                        store.create_dir(folder, recursive=True)
                    name = "-".join([stem, *map(str, at[len(key) :])]) + form.end
                    names, last = (f"{folder}/.{name}.{attempt}", f"{folder}/{name}"), at
                    file = form(store.open_output_stream(names[0]), own.schema)
                file.write(own.slice(lo, hi - lo))
            yield told()
        closed()
        yield told()

    store, root = store_of(path)
    store.create_dir(root, recursive=True)
    head = path[: len(path) - len(root)] if path.endswith(root) else ""  # of a path with a scheme
    kinds = rows.select(*key).schema
    made = to_arrow_schema(kinds).append(pa.field("file", pa.string()))
    return tables.cut(rows.mapInArrow(run, kinds.add("file", "string")), "files")


#: Files that a task opens one after the other.
FILES_AT_ONCE = 256
#: Bytes of a text file that are split into lines at once.
BLOCK = 1 << 22


def _from_files(files: DataFrame, made: str, read: Callable) -> DataFrame:
    """(columns of files, made): what read(open file) gives, batch by batch, for each path in the column `file`, opened by
    tasks of FILES_AT_ONCE files or so."""
    spread = files.repartition(max(1, math.ceil(files.count() / FILES_AT_ONCE)))
    columns, names = files.columns, [*files.columns, *[c.split()[0] for c in made.split(", ")]]

    def run(batches):
        for batch in batches:
            for n, path in enumerate(batch["file"].to_pylist()):
                store, own = store_of(path)
                with store.open_input_file(own) as file:
                    for part in read(file):
                        same = pa.array(np.full(len(part[0]), n))
                        yield pa.RecordBatch.from_arrays([*[batch[c].take(same) for c in columns], *part], names)

    def together(batches):
        """Few rows of many files in one batch."""
        held, size = [], 0
        for batch in run(batches):
            held, size = [*held, batch], size + batch.nbytes
            if size > 1 << 22 or len(held) == FILES_AT_ONCE:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    kinds = ", ".join(f"{c} {t}" for c, t in files.dtypes)
    return spread.mapInArrow(together, f"{kinds}, {made}")


def read_lines(files: DataFrame) -> DataFrame:
    """(columns of files, value): the lines of text files (file, ...), ended by \\n, \\r or both; files are read in blocks."""

    def read(file):
        rest = b""
        while True:
            block = file.read(BLOCK)
            if not block:
                break
            text = (rest + block).replace(b"\r\n", b"\n")
            keep = text[-1:] == b"\r"  # perhaps half an end
            *lines, rest = (text[:-1] if keep else text).replace(b"\r", b"\n").split(b"\n")
            rest += b"\r" * keep
            yield [pa.array([line.decode(errors="replace") for line in lines], pa.string())]
        if rest:
            yield [pa.array([rest.removesuffix(b"\r").decode(errors="replace")], pa.string())]

    return _from_files(files, "value string", read)


def read_texts(files: DataFrame) -> DataFrame:
    """(columns of files, value): text files (file, ...) as one value each."""
    return _from_files(files, "value string", lambda file: [[pa.array([file.read().decode(errors="replace")], pa.string())]])


def read_tables(files: DataFrame, made: str) -> DataFrame:
    """(columns of files, made): the given columns of Parquet files (file, ...)."""
    kinds = to_arrow_schema(StructType.fromDDL(made))

    def read(file):
        for batch in pq.ParquetFile(file).iter_batches(columns=kinds.names):
            yield [batch[c].cast(t) for c, t in zip(kinds.names, kinds.types)]

    return _from_files(files, made, read)


def _together(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a key in one task. By a hash of the key: where rows are a union whose parts are each dealt by the key
    itself, Spark leaves such a shuffle out, and then reads the parts in ranges of partitions that needn't agree."""
    return rows.repartition(F.xxhash64(*key))


def write_lines(lines: DataFrame, key: list[str], order: list[str] | None, path: str, apart: list[str] | None = None) -> DataFrame:
    """A folder of text for each key, lines in order; the rows of a key (and of each value of `apart`) are one file's.

    Without an order the lines of a file already follow each other, in one task.
    """
    whole = [*key, *(apart or [])]
    rows = lines if order is None else _together(lines, whole).sortWithinPartitions(*whole, *order)
    return write_folders(rows.select(*whole, "value"), key, _Lines, path, apart)


def write_tables(rows: DataFrame, key: list[str], order: list[str], path: str, prefix: str = "part") -> DataFrame:
    """A folder for each key with its rows in order, as one Parquet file."""
    return write_folders(_together(rows, key).sortWithinPartitions(*key, *order), key, _Table, path, prefix=prefix)


def write_archive(dense: DataFrame, path: str) -> DataFrame:
    """Dense trajectories as single-precision Parquet, a folder for each session; what is missing is not a number, with confidence 0."""
    number = lambda c, missing: F.coalesce(c, F.lit(missing)).cast("float").alias(c)
    rows = dense.select("session", "name", "frame_idx", *[number(v, float("nan")) for v in "xyz"], number("confidence", 0.0), number("reproj_err", 0.0))
    return write_tables(rows, ["session"], ["name", "frame_idx"], path)


def write_clouds(voxels: DataFrame, path: str) -> DataFrame:
    """Voxel clouds (session, frame_idx, x, y, z) of an archive in single precision, a folder for each session, frames in order.

    Tasks take ranges of sessions and frames, so a session is in one file or, if it is long, in a few.
    """
    rows = voxels.select("session", "frame_idx", *[F.col(v).cast("float").alias(v) for v in "xyz"])
    return write_folders(rows.repartitionByRange("session", "frame_idx").sortWithinPartitions("session", "frame_idx"), ["session"], _Table, path, ranges=True)


def archive_metadata(kp3d: DataFrame, frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """(session, fps, n_frames, names): what an archive says of itself; names are sorted."""
    return frames.join(trajectory.vocabulary(kp3d), "session", "left").select("session", F.lit(float(fps)).alias("fps"), "n_frames", F.coalesce("names", F.lit("")).alias("names"))


def corner_csv(points: DataFrame) -> DataFrame:
    """Corner correspondences as text, four decimals for places and three for pixels, NaN for missing pixels."""
    pixel = lambda c: F.when(F.col(c).isNull(), "NaN").otherwise(fixed(c, 3)).alias(c)
    return points.select(*[fixed(c, 4).alias(c) for c in ("rec_x", "rec_y", "rec_z", "arena_x", "arena_y", "arena_z")], "label", *[pixel(c) for c in ("px0_x", "px0_y", "px1_x", "px1_y")])


def edge_lines(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, edge_id, pos, value): rows of edge files, each edge followed by a separator row."""
    rows = edges.select(*key, "edge_id", "pos", F.concat_ws(",", F.col("camera").cast("string"), "label", fixed("x", 3), fixed("y", 3)).alias("value"))
    ends = edges.groupBy(*key, "edge_id").agg((F.max("pos") + 1).alias("pos")).withColumn("value", F.lit("---"))
    return rows.unionByName(ends.select(*key, "edge_id", "pos", "value"))
