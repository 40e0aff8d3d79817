"""Frames of many cameras as Spark data sources, raw or through a user's detector.

`frames` lists the images of every folder <path>/<session>/<camera>, sorted by name and numbered from 0, and reads them in
partitions of some consecutive frames. Where there are more sessions than `partitions` (2 000), a partition is a run of
sessions that its task lists itself, so the driver holds the sessions' names but no image's. `detections` does the same and hands each image to a detector: an object with
detect(content, frame_idx) that gives (name, px, py, confidence) for what it sees, made once a task from the option
`detector` ("module:name" of what makes it) and closed, where it has a close(), when the task ends, also by an error.
Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What counts as an image.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
_GREY_MAP = re.compile(rb"P5\s+([0-9]+)\s+([0-9]+)\s+([0-9]+)\s")


@dataclass
class FrameBlock(InputPartition):
    """Consecutive frames of a camera."""

    session: str
    camera: int
    first: int
    paths: list[str]


@dataclass
class SessionRun(InputPartition):
    """Sessions with all their cameras and frames."""

    sessions: list[str]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.block, self.most = options["path"], int(options.get("block", 64)), int(options.get("partitions", 2000))
        self.extensions = tuple(options.get("extensions", ",".join(EXTENSIONS)).lower().split(","))

    def partitions(self) -> list[InputPartition]:
        store, root = self._open()
        sessions = sorted(self._folders(store, root))
        if len(sessions) > self.most:
            ends = [len(sessions) * n // self.most for n in range(self.most + 1)]
            return [SessionRun(sessions[lo:hi]) for lo, hi in zip(ends, ends[1:])]
        return [b for session in sessions for b in self._blocks(store, root, session)] or [FrameBlock("", 0, 0, [])]

    def _open(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return store, root.rstrip("/")

    def _folders(self, store: fs.FileSystem, path: str) -> list[str]:
        return [info.base_name for info in store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory]

    def _blocks(self, store: fs.FileSystem, root: str, session: str) -> Iterator[FrameBlock]:
        for camera in sorted(c for c in self._folders(store, f"{root}/{session}") if c.isdigit()):
            infos = store.get_file_info(fs.FileSelector(f"{root}/{session}/{camera}"))
            paths = sorted(info.path for info in infos if info.type == fs.FileType.File and info.base_name.lower().endswith(self.extensions))
            for at in range(0, len(paths), self.block):
                yield FrameBlock(session, int(camera), at, paths[at : at + self.block])

    def contents(self, partition: FrameBlock | SessionRun) -> Iterator[tuple[str, int, int, str, bytes]]:
        store, root = self._open()
        whole = isinstance(partition, SessionRun)
        for block in (b for session in partition.sessions for b in self._blocks(store, root, session)) if whole else [partition]:
            for n, path in enumerate(block.paths):
                with store.open_input_stream(path) as stream:
                    yield block.session, block.camera, block.first + n, path, stream.read()

    def read(self, partition: FrameBlock | SessionRun) -> Iterator[tuple]:
        return self.contents(partition)


class DetectionReader(FrameReader):
    def __init__(self, options: dict):
        super().__init__(options)
        module, _, name = options["detector"].partition(":")
        self.module, self.name = module, name

    def read(self, partition: FrameBlock | SessionRun) -> Iterator[tuple]:
        detector = getattr(importlib.import_module(self.module), self.name)()
        try:
            for session, camera, frame, _, content in self.contents(partition):
                for name, px, py, confidence in detector.detect(content, frame):
                    yield session, camera, frame, str(name), float(px), float(py), float(confidence)
        finally:
            getattr(detector, "close", lambda: None)()


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "session string, camera int, frame_idx bigint, path string, content binary"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


class DetectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "detections"

    def schema(self) -> str:
        return "session string, camera int, frame_idx bigint, name string, px double, py double, confidence double"

    def reader(self, schema) -> DetectionReader:
        return DetectionReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session, for spark.read.format and for SQL."""
    for source in (FrameSource, DetectionSource):
        spark.dataSource.register(source)


def read(spark: SparkSession, path: str, detector: str | None = None, block: int = 64) -> DataFrame:
    register(spark)
    reader = spark.read.format("detections" if detector else "frames").option("block", str(block))
    return (reader.option("detector", detector) if detector else reader).load(path)


class Brightest:
    """A detector of grey maps (binary PGM of 8 bits): the brightest pixel, the first in row order; nothing in a black image."""

    def detect(self, content: bytes, frame_idx: int) -> list[tuple[str, int, int, float]]:
        head = _GREY_MAP.match(content)
        pixels = content[head.end() :] if head else b""
        best = max(pixels, default=0)
        if not best:
            return []
        width, _, top = map(int, head.groups())
        at = pixels.find(best)
        return [("brightest", at % width, at // width, best / top)]


def write_images(images: DataFrame, path: str) -> DataFrame:
    """Writes (session, camera, frame_idx, content) as files <path>/<session>/<camera>/<frame>.tif and returns their paths; run by an action."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        made = ""
        for batch in batches:
            for session, camera, frame, content in zip(batch["session"], batch["camera"], batch["frame_idx"], batch["content"]):
                folder = f"{root}/{session}/{camera}"
                if folder != made:
                    store.create_dir(folder, recursive=True)
                    made = folder
                with store.open_output_stream(f"{folder}/{frame:09d}.tif") as out:
                    out.write(content)
            yield batch[["session", "camera", "frame_idx"]]

    return images.select("session", "camera", "frame_idx", "content").mapInPandas(run, "session bigint, camera int, frame_idx bigint")
