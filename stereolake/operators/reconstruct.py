"""The whole run as one job: keypoints and masks of many sessions to hulls, tracks, statistics, archives, meshes and viewer.

Two tables are shared by all that follows and written once: each frame's packed hull, and the tracks (matched, triangulated,
filtered, smoothed, filled). Every sink reads these. What is finished stands in a manifest beside the outputs: a row for
each stage with the folder it wrote and a fingerprint of the options and of the stages it read. A stage writes into a folder
of its own and its row is added afterwards, so a run that was cut short leaves folders that nothing names; started again, it
skips the stages whose rows match and does the others. Changed options change the fingerprints of what they touch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import grids, masks, trajectory, voxels

FRAME = ["session", "frame_idx"]
SINKS = ("stats", "archive", "metadata", "clouds", "skeletons", "volumes", "viewer", "header")
_MANIFEST = "stage string, fingerprint string, path string, finished timestamp"


@dataclass(frozen=True)
class Options:
    """What a run is told; lengths are in millimetres, frames count from `start_frame` and come out from 0."""

    bounds: tuple = ((-200, 200), (-200, 200), (0, 400))
    voxel_size: float = 8.0
    width: int = 1280
    height: int = 720
    mask_scale: float = 1.0  # keypoint pixels to a mask pixel
    grow: int = 0  # masks are dilated by so many pixels
    start_frame: int = 0
    n_frames: int = 0  # 0: all
    min_confidence: float = 0.4
    max_reprojection_px: float = 20.0
    smooth_sigma: float = 1.5
    max_gap: int = 10
    stride: int = 5  # every so many frames get a skeleton and a volume file
    mesh: bool = True  # volume files are meshes, else point clouds
    voxel_downsample: int = 8
    fps: float = 30.0
    viewer_block: int = 1000  # frames of a session in a viewer file


@dataclass
class Run:
    """A folder of outputs and its manifest; `paths` names what each finished stage wrote."""

    spark: SparkSession
    out: str
    paths: dict[str, str] = field(default_factory=dict)
    prints: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.out}/manifest")

    def finished(self) -> dict[tuple[str, str], str]:
        """Folder by (stage, fingerprint): a row for each stage that was ever finished here."""
        try:
            return {(r.stage, r.fingerprint): r.path for r in self.manifest().collect()}
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}

    def stage(self, name: str, told: object, reads: tuple[str, ...], write: Callable[[str], DataFrame | None]) -> str:
        """Runs write(folder) unless the stage is finished with the same options on the same stages; returns its folder.

        The table of files that write may return is kept beside the folder.
        """
        own = hashlib.sha256(repr((name, told, [self.prints[r] for r in reads])).encode()).hexdigest()[:16]
        self.prints[name] = own
        path = self.finished().get((name, own))
        if path:
            self.skipped.append(name)
        else:
            path = f"{self.out}/{name}-{uuid.uuid4().hex}"
            written = write(path)
            if written is not None:
                written.write.parquet(f"{path}-files")
            row = self.spark.range(1).select(F.lit(name).alias("stage"), F.lit(own).alias("fingerprint"), F.lit(path).alias("path"), F.current_timestamp().alias("finished"))
            row.coalesce(1).write.mode("append").parquet(f"{self.out}/manifest")
        self.paths[name] = path
        return path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    def files(self, name: str) -> DataFrame:
        """(key, file) of a stage that wrote a folder for each session or frame, for the readers of `files`."""
        return self.spark.read.parquet(f"{self.paths[name]}-files")


def _chosen(rows: DataFrame, o: Options) -> DataFrame:
    """Frames of the chosen range."""
    end = F.col("frame_idx") < o.start_frame + o.n_frames if o.n_frames else F.lit(True)
    return rows.where((F.col("frame_idx") >= o.start_frame) & end)


def _ranged(rows: DataFrame, o: Options) -> DataFrame:
    """Frames of the chosen range, numbered from 0."""
    return _chosen(rows, o).withColumn("frame_idx", F.col("frame_idx") - o.start_frame)


def _scaled(cameras: DataFrame, scale: float) -> DataFrame:
    """The cameras of images `scale` times smaller: the first two rows of each matrix divided."""
    return cameras.withColumn("p", F.transform("p", lambda v, i: F.when(i < 8, v / scale).otherwise(v)))


def run(kp2d: DataFrame, mask: DataFrame, frames: DataFrame, cameras: DataFrame, edges: DataFrame, out: str, options: Options = Options(), inputs: str = "", sinks: tuple[str, ...] = SINKS) -> Run:
    """Reconstructs all sessions into the folder `out`; see the module for what a second call does.

    kp2d (session, camera, frame_idx, name, px, py, confidence, event_id), mask (session, camera, frame_idx, px, py) of
    foreground pixels or the lists that `grids.pack_masks` takes, frames (session, n_frames), cameras (session, camera, p), edges (a, b). inputs: a name of the input
    tables' version; results of another version are not taken up. Frames without a keypoint or a hull are kept where a sink
    counts frames; sessions without cameras give nothing.
    """
    unknown = set(sinks) - set(SINKS)
    if unknown:
        raise ValueError(f"no such sinks: {sorted(unknown)}")
    o, shape = options, grids.dims(options.bounds, options.voxel_size)
    job = Run(kp2d.sparkSession, out.rstrip("/"))
    told = asdict(o)
    of = lambda *names: (inputs, [told[n] for n in ("start_frame", "n_frames", *names)])
    n = F.col("n_frames") - o.start_frame
    frames = frames.withColumn("n_frames", F.greatest(F.least(n, F.lit(o.n_frames)) if o.n_frames else n, F.lit(0)))

    def hulls(path: str) -> None:
        # frames are numbered anew behind the carving, so pixels that come by frame aren't dealt again
        packed = grids.pack_masks(_chosen(mask, o), o.width, o.height)
        if o.grow:
            packed = grids.grow(packed, masks.ellipse(2 * o.grow + 1), o.width, o.height)
        _ranged(grids.carve(packed, _scaled(cameras, o.mask_scale), o.bounds, o.voxel_size, o.width, o.height), o).write.parquet(path)

    def points(path: str) -> None:
        trajectory.triangulate_keypoints(_ranged(kp2d, o), min_confidence=o.min_confidence, max_reprojection_px=o.max_reprojection_px, cameras=cameras).write.parquet(path)

    def tracks(path: str) -> None:
        smoothed = trajectory.smooth(job.table("points"), frames, o.smooth_sigma)
        (trajectory.fill_gaps(smoothed, o.max_gap) if o.max_gap else smoothed).write.parquet(path)

    job.stage("hulls", of("bounds", "voxel_size", "width", "height", "mask_scale", "grow"), (), hulls)
    job.stage("points", of("min_confidence", "max_reprojection_px"), (), points)
    job.stage("tracks", of("smooth_sigma", "max_gap"), ("points",), tracks)
    found, hull = job.table("tracks"), job.table("hulls")
    due = F.col("frame_idx") % o.stride == 0
    cells = lambda df: grids.cells(df, FRAME, shape)
    origin = tuple(float(lo) for lo, _ in o.bounds)

    def skeletons(path: str) -> DataFrame:
        shown = found.where(due).withColumn("pos", F.shiftrightunsigned(F.xxhash64("name"), 1))  # behind the header
        return files.write_lines(files.point_cloud_lines(shown, FRAME, (0, 200, 255)), FRAME, ["seq", "value"], path)

    def volumes(path: str) -> DataFrame:
        chosen = hull.where(due)
        if not o.mesh:
            flat = (F.col("i") * shape[1] + F.col("j")) * shape[2] + F.col("k")
            return files.write_lines(files.point_cloud_lines(voxels.centers(cells(chosen), o.bounds, o.voxel_size).withColumn("pos", flat), FRAME), FRAME, ["seq"], path)
        return files.write_lines(files.whole_meshes_text(voxels.meshes(chosen, FRAME, shape, origin, o.voxel_size), FRAME), FRAME, None, path)

    def viewer(path: str) -> DataFrame:
        thinned = voxels.centers(voxels.thin(cells(hull), FRAME, o.voxel_downsample), o.bounds, o.voxel_size)
        shown = files.viewer_json(found, thinned.select(*FRAME, "x", "y", "z"))
        lines = shown.select("session", F.floor(F.col("frame_idx") / o.viewer_block).alias("block"), "frame_idx", F.to_json(F.struct("frame_idx", "value")).alias("value"))
        return files.write_lines(lines, ["session"], ["frame_idx"], path, apart=["block"])

    make = {
        "stats": (of(), ("tracks",), lambda path: files.write_csv(files.stats_csv(trajectory.stats(found, frames)), path)),
        "archive": (of(), ("tracks",), lambda path: files.write_archive(trajectory.dense(found, frames), path)),
        "metadata": (of("fps", "voxel_size"), ("tracks",), lambda path: files.archive_metadata(found, frames, o.fps).withColumn("voxel_size", F.lit(float(o.voxel_size))).write.parquet(path)),
        "clouds": (of(), ("hulls",), lambda path: files.write_clouds(voxels.centers(cells(hull), o.bounds, o.voxel_size), path)),
        "skeletons": (of("stride"), ("tracks",), skeletons),
        "volumes": (of("stride", "mesh"), ("hulls",), volumes),
        "viewer": (of("voxel_downsample", "viewer_block"), ("hulls", "tracks"), viewer),
        "header": (of("fps"), ("tracks",), lambda path: files.viewer_header(found, edges, o.fps).write.parquet(path)),
    }
    for name in sinks:
        job.stage(name, *make[name])
    return job
