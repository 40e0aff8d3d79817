"""Structured Streaming counterparts of the frame loop.

Matching, triangulation and gap filling equal their batch operators once all input has come; the background model is a
decaying mean and variance of each pixel instead of the batch operator's window of frames. Windows, tracks and filled points
come out when the watermark has passed them, so a stream's last ones need a row of later event time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import geometry as g
from ..operators import trajectory
from ..sources import files


def with_event_time(rows: DataFrame, fps: float | str = 30.0, t0: str = "2024-01-01 00:00:00", fallback: float = 30.0) -> DataFrame:
    """Adds event_time: a fixed start plus frame / fps. fps may be a column; where it is null, not a number or not above 0, the fallback holds."""
    own = F.col(fps) if isinstance(fps, str) else F.lit(float(fps))
    rate = F.when((own > 0) & ~F.isnan(own), own).otherwise(F.lit(float(fallback)))
    micros = F.unix_micros(F.to_timestamp(F.lit(t0))) + (F.col("frame_idx") / rate * 1_000_000).cast("bigint")
    return rows.withColumn("event_time", F.timestamp_micros(micros))


def match_views(kp2d: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Stream-stream join of the two cameras' keypoints of one frame; both sides forget what is older than the delay."""
    sides = []
    for k in (0, 1):
        own = kp2d.where(F.col("camera") == k).withWatermark("event_time", delay)
        sides.append(own.select(*[F.col(c).alias(f"{c}_{k}") for c in ("session", "frame_idx", "name", "event_time")], F.col("px").alias(f"x{k}"), F.col("py").alias(f"y{k}"), F.col("confidence").alias(f"c{k}")))
    same = [F.col(f"{c}_0") == F.col(f"{c}_1") for c in ("session", "frame_idx", "name", "event_time")]
    joined = sides[0].join(sides[1], same[0] & same[1] & same[2] & same[3])
    return joined.select(F.col("session_0").alias("session"), F.col("frame_idx_0").alias("frame_idx"), F.col("name_0").alias("name"), F.col("event_time_0").alias("event_time"), "x0", "y0", "x1", "y1", F.least("c0", "c1").alias("confidence"))


def triangulate(matches: DataFrame, p0, p1, min_confidence: float = 0.3, max_px: float = 20.0) -> DataFrame:
    """Stateless: confident matches, triangulated, close in both views."""
    points = trajectory.triangulate(matches.where(F.col("confidence") >= min_confidence), p0, p1)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    err = (g.reprojection_error(p0, x, y, z, F.col("x0"), F.col("y0")) + g.reprojection_error(p1, x, y, z, F.col("x1"), F.col("y1"))) / 2
    return points.withColumn("reproj_err", err).where(g.keep_error(F.col("reproj_err"), max_px))


def rates(kp3d: DataFrame, width: str = "1 second", slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """Points and mean error by landmark in tumbling (or sliding) windows of event time."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    grouped = kp3d.withWatermark("event_time", delay).groupBy(window, "session", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("reproj_err").alias("mean_err"))
    return grouped.select(F.col("window.start").alias("start"), "session", "name", "n", "mean_err")


def tracks(kp3d: DataFrame, max_gap: int = 10, fps: float = 30.0, delay: str = "10 seconds") -> DataFrame:
    """Runs of detections of a landmark that no gap of more than max_gap frames interrupts."""
    window = F.session_window("event_time", f"{math.ceil((max_gap + 1.5) / fps * 1000)} milliseconds")  # half a frame beyond the gap
    return kp3d.withWatermark("event_time", delay).groupBy(window, "session", "name").agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last")).select("session", "name", "first", "last", "n")


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store, which spills to disk; set for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_POINT = ("frame_idx", "x", "y", "z", "confidence", "reproj_err")
_OUT = Row("session", "name", *_POINT)


class GapFiller(StatefulProcessor):
    """Puts a landmark's points in frame order and fills short gaps; state ends with the last gap that it could still fill.

    State: the points that the watermark hasn't passed, as arrays, and the last point that it has. A timer at the earliest
    waiting point hands on all points that the watermark has passed, with interpolated ones between; a timer max_gap + 1
    frames after the last point drops it, as no later point can be near enough. Late points up to the watermark's delay are
    put in place; Spark drops later ones. Of points of one frame the last one counts for filling, all are handed on.
    """

    def __init__(self, max_gap: int, fps: float):
        self.max_gap, self.frame_ms = max_gap, 1000.0 / fps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{c} array<{'bigint' if c == 'frame_idx' else 'double'}>" for c in _POINT)
        self.state = handle.getValueState("track", f"due array<bigint>, {arrays}, last array<double>, last_ms bigint")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        """The last point that an earlier run handed on."""
        waiting, last, _ = self._load()
        if last is None or initialState["frame_idx"] > last[0]:
            self._keep(waiting, [float(initialState[c]) for c in _POINT], initialState["due"])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        waiting, last, last_ms = self._load()
        self._keep([*waiting, *[tuple(r[c] for c in ("due", *_POINT)) for r in rows]], last, last_ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, last, last_ms = self._load()
        ready = sorted((p for p in waiting if p[0] <= now), key=lambda p: p[1])
        if ready:
            for point in [*self._filled(last, ready), *[p[1:] for p in ready]]:
                yield _OUT(*key, *point)
            if last is None or ready[-1][1] > last[0]:
                last, last_ms = [None if v is None else float(v) for v in ready[-1][1:]], ready[-1][0]
        waiting = [p for p in waiting if p[0] > now]
        if last is not None and self._end(last_ms) <= now and (not waiting or min(p[1] for p in waiting) > last[0] + self.max_gap + 1):
            last, last_ms = None, None
        self._keep(waiting, last, last_ms)

    def _filled(self, last: list[float] | None, ready: list[tuple]) -> Iterator[tuple]:
        """Interpolated points in the gaps of the last point and those that follow."""
        points = {p[1]: p[1:] for p in ready if last is None or p[1] > last[0]}  # of points of one frame the last one
        points = [*([] if last is None else [last]), *points.values()]
        for before, after in zip(points, points[1:]):
            start = int(before[0])
            gap = int(after[0]) - start - 1
            if 0 < gap <= self.max_gap:
                sure = min((v for v in (before[4], after[4]) if v is not None), key=lambda v: (v != v, v), default=None)  # as least() does
                lower = None if sure is None else 0.8 * sure
                for k in range(1, gap + 1):
                    t = k / (gap + 1)
                    yield start + k, *[None if a is None or b is None else a + t * (b - a) for a, b in zip(before[1:4], after[1:4])], lower, 0.0

    def _end(self, last_ms: int) -> int:
        return last_ms + math.ceil((self.max_gap + 1.5) * self.frame_ms)  # half a frame beyond the gap

    def _load(self) -> tuple[list[tuple], list[float] | None, int | None]:
        """Waiting points (due and the point's columns), and the last one that was handed on."""
        kept = self.state.get() if self.state.exists() else None
        return ([], None, None) if kept is None else (list(zip(*kept[:7])), kept[7], kept[8])

    def _keep(self, waiting: list[tuple], last: list[float] | None, last_ms: int | None) -> None:
        if not waiting and last is None:
            self.state.clear()
            return
        self.state.update((*(map(list, zip(*waiting)) if waiting else [[] for _ in range(7)]), last, last_ms))
        self.handle.registerTimer(min(p[0] for p in waiting) if waiting else self._end(last_ms))


def fill_gaps(kp3d: DataFrame, max_gap: int = 10, fps: float = 30.0, delay: str = "10 seconds", initial: DataFrame | None = None) -> DataFrame:
    """Points in frame order with short gaps filled, each as soon as the watermark has passed it; see GapFiller.

    initial: (session, name, event_time and the point's columns) of the last points of an earlier run. A stream's last
    points come out once a row of later event time has moved the watermark.
    """
    keep_state_in_rocksdb(kp3d.sparkSession)
    columns = ["session", "name", "event_time", F.unix_millis("event_time").alias("due"), *_POINT]
    tracks = kp3d.select(*columns).withWatermark("event_time", delay).groupBy("session", "name")
    return tracks.transformWithState(
        GapFiller(max_gap, fps), "session bigint, name string, frame_idx bigint, x double, y double, z double, confidence double, reproj_err double",
        "append", "EventTime", initialState=initial.select(*columns).groupBy("session", "name") if initial is not None else None,
    )


class BlockModel(StatefulProcessor):
    """Running mean and variance of a block of pixels, one array each; a block that isn't seen for ttl_ms is forgotten.

    Values of a batch are taken in rounds: the first value of every pixel, then the second, so a round is one step on
    arrays. A value at or before its pixel's last frame is judged and leaves the model as it is.
    """

    def __init__(self, side: int, threshold: float, floor: float, rate: float, ttl_ms: int | None):
        self.side, self.threshold, self.floor, self.rate, self.ttl_ms = side, threshold, floor, rate, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "mean array<double>, var array<double>, n array<bigint>, frame array<bigint>", self.ttl_ms)

    def _load(self) -> list[np.ndarray]:
        kept = self.state.get() if self.state.exists() else None
        if kept is None:
            size = self.side * self.side
            return [np.zeros(size), np.zeros(size), np.zeros(size, dtype=np.int64), np.full(size, np.iinfo(np.int64).min)]
        return [np.array(kept[0], dtype=float), np.array(kept[1], dtype=float), np.array(kept[2], dtype=np.int64), np.array(kept[3], dtype=np.int64)]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        """Models of an earlier run: a row for each pixel with mean, var, n and frame_idx."""
        model = self._load()
        at = self._place(initialState, key)
        for array, column in zip(model, ("mean", "var", "n", "frame_idx")):
            array[at] = initialState[column].to_numpy()
        self.state.update(tuple(a.tolist() for a in model))

    def _place(self, rows: pd.DataFrame, key: tuple) -> np.ndarray:
        return ((rows["y"] - key[3] * self.side) * self.side + rows["x"] - key[2] * self.side).to_numpy()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        mean, var, n, frame = self._load()
        pixel, at, v = self._place(rows, key), rows["frame_idx"].to_numpy(), rows["v"].to_numpy(float)
        order = np.lexsort([at, pixel])
        place = np.arange(len(order)) - np.searchsorted(pixel[order], pixel[order])
        flags = np.zeros(len(rows), dtype=bool)
        for k in range(int(place.max()) + 1):
            own = order[place == k]
            p, off = pixel[own], v[own] - mean[pixel[own]]
            flags[own] = (n[p] > 0) & (off * off > self.threshold * np.maximum(var[p], self.floor))
            new = at[own] > frame[p]
            p, off = p[new], off[new]
            n[p] += 1
            a = np.maximum(self.rate, 1 / n[p])
            mean[p] += a * off
            var[p] = (1 - a) * (var[p] + a * off * off)
            frame[p] = at[own][new]
        self.state.update((mean.tolist(), var.tolist(), n.tolist(), frame.tolist()))
        yield pd.DataFrame({"session": key[0], "camera": key[1], "x": rows["x"], "y": rows["y"], "frame_idx": rows["frame_idx"], "foreground": flags})


def background(pixels: DataFrame, threshold: float = 40.0, floor: float = 4.0, rate: float = 0.05, side: int = 16, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Foreground of pixel series by a running mean and variance, kept for blocks of side x side pixels; see BlockModel.

    initial: (session, camera, x, y, mean, var, n, frame_idx) of an earlier run's pixels. Time to live is counted in
    processing time, so a stream with ttl_ms runs until it is stopped; without, it also ends with the input that is there.
    """
    keep_state_in_rocksdb(pixels.sparkSession)

    def blocks(rows: DataFrame):
        own = {b: F.floor(F.col(v) / side).cast("int") for b, v in (("block_x", "x"), ("block_y", "y"))}
        return rows.withColumns(own).groupBy("session", "camera", *own)

    return blocks(pixels.select("session", "camera", "x", "y", "frame_idx", "v")).transformWithStateInPandas(
        BlockModel(side, threshold, floor, rate, ttl_ms), "session bigint, camera int, x int, y int, frame_idx bigint, foreground boolean",
        "append", "ProcessingTime" if ttl_ms else "None", initialState=blocks(initial) if initial is not None else None,
    )


def archive(rows: DataFrame, path: str, checkpoint: str):
    """Starts appending rows to Parquet, a folder for each session and in it a file for each batch; ends when the input that is there has been read.

    A batch that is taken again after a failure writes the same files again. Archives that Spark's own sink began, with a
    log of files beside them, have to be begun anew.
    """
    write = lambda batch, number: files.write_tables(batch, ["session"], [], path, prefix=f"batch-{number:09d}")
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
