"""Stateful streams: late rows, expiring state, initial state, blocks of pixels, against plain Python and the batch operators."""

import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolake.operators import trajectory
from stereolake.sources import tables
from stereolake.streaming import streams

POINTS = "session bigint, name string, frame_idx bigint, x double, y double, z double, confidence double, reproj_err double"


def in_batches(spark, batches, schema, event_time=True):
    """A stream that reads one of the lists of rows at a time."""
    path = tables.fresh_path(spark, "batches")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        (streams.with_event_time(df) if event_time else df).write.mode("append").parquet(path)
        time.sleep(1.1 if k < len(batches) - 1 else 0)  # files are read in the order of their seconds
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(out):
    spark = out.sparkSession
    path, mark = tables.fresh_path(spark, "sink"), tables.fresh_path(spark, "progress")
    run = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start()
    try:
        run.awaitTermination(120)
        return spark.read.schema(out.schema).parquet(path).collect(), run.recentProgress
    finally:
        run.stop()


def point(frame, name="a", session=1):
    return (session, name, frame, float(frame * 2), float(-frame), 1.0, 1 - frame % 4 / 10, 0.5)


END = (-1, "end", 100_000, 0.0, 0.0, 0.0, 1.0, 0.0)


def test_gaps_are_filled_though_rows_come_late(spark):
    """Batches in any order within the delay give what the batch operator gives; what is later than the watermark is dropped."""
    frames = [0, 1, 4, 5, 9, 20, 21, 40, 41, 43, 44, 50]
    order = [[4, 0, 9], [5, 1, 21], [20, 41, 43], [40, 50, 44]]
    assert sorted(sum(order, [])) == frames
    batches = [[point(f) for f in own] + [point(f + 3, "b") for f in own] for own in order] + [[(-1, "end", 100_000 + k, 0.0, 0.0, 0.0, 1.0, 0.0), *[point(2)] * (k == 2)] for k in range(3)]
    rows, progress = drained(streams.fill_gaps(in_batches(spark, batches, POINTS), max_gap=10, delay="2 seconds"))
    got = collections.Counter(tuple(r) for r in rows if r.session == 1)
    points = spark.createDataFrame([r for own in batches[:4] for r in own], POINTS)
    want = collections.Counter(tuple(r) for r in trajectory.fill_gaps(points, 10).select("session", "name", "frame_idx", "x", "y", "z", "confidence", "reproj_err").collect())
    rounded = lambda c: collections.Counter({tuple(round(v, 9) if isinstance(v, float) else v for v in k): n for k, n in c.items()})
    assert rounded(got) == rounded(want)
    assert len(got) > len(frames) * 2
    # the state of landmarks that nothing can follow is gone: what is left is that of the last rows
    assert progress[-1].stateOperators[0].numRowsTotal <= 4


def test_gap_state_expires_and_starts_from_an_earlier_run(spark):
    earlier = streams.with_event_time(spark.createDataFrame([point(0), point(0, "b")], POINTS))
    batches = [[point(4), point(30, "b")], [point(60), END], [(-1, "end", 100_001, 0.0, 0.0, 0.0, 1.0, 0.0)]]
    rows, _ = drained(streams.fill_gaps(in_batches(spark, batches, POINTS), max_gap=10, delay="0 seconds", initial=earlier))
    got = sorted((r.name, r.frame_idx) for r in rows if r.session == 1)
    assert got == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 60), ("b", 30)]


def test_gaps_are_filled_like_the_batch_operator_where_values_are_missing(spark):
    nan = float("nan")
    rows = [(1, "a", 0, 1.0, None, nan, None, 0.5), (1, "a", 3, 4.0, 2.0, 1.0, 0.5, 0.5), (1, "a", 5, 6.0, 2.0, 1.0, nan, None), (1, "a", 7, 6.0, 2.0, 1.0, None, 0.0)]
    got, _ = drained(streams.fill_gaps(in_batches(spark, [rows, [END], [(-1, "end", 100_001, 0.0, 0.0, 0.0, 1.0, 0.0)]], POINTS), delay="0 seconds"))
    want = trajectory.fill_gaps(spark.createDataFrame(rows, POINTS)).select(got[0].__fields__).collect()
    assert sorted(str(tuple(r)) for r in got if r.session == 1) == sorted(str(tuple(r)) for r in want) and len(want) == 8


def model_by_hand(rows, model=None, threshold=40.0, floor=4.0, rate=0.05):
    out, models = {}, dict(model or {})
    for session, camera, x, y, frame, v in rows:
        mean, var, n, last = models.get((session, camera, x, y), (0.0, 0.0, 0, -1))
        out[session, camera, x, y, frame] = n > 0 and (v - mean) ** 2 > threshold * max(var, floor)
        if frame > last:
            n += 1
            a = max(rate, 1 / n)
            off = v - mean
            models[session, camera, x, y] = (mean + a * off, (1 - a) * (var + a * off * off), n, frame)
    return out, models


PIXELS = "session bigint, camera int, x int, y int, frame_idx bigint, v double"


@pytest.mark.parametrize("side", [1, 3, 16])
def test_blocks_of_pixels_follow_each_pixels_model(spark, side):
    rng = np.random.default_rng(4)
    rows = [(s, c, x, y, f, float(50 + rng.integers(0, 5) + 120 * (rng.random() < 0.05))) for f in range(12) for s in (1, 2) for c in (0, 1) for x in range(-2, 5) for y in range(4) if rng.random() < 0.7]
    before = [r for r in rows if r[4] < 3]
    _, models = model_by_hand(before)
    initial = spark.createDataFrame([(*k, float(m), float(v), n, f) for k, (m, v, n, f) in models.items()], "session bigint, camera int, x int, y int, mean double, var double, n bigint, frame_idx bigint")
    later = [r for r in rows if r[4] >= 3]
    stream = in_batches(spark, [[r for r in later if r[4] < 7], [r for r in later if r[4] >= 7]], PIXELS, event_time=False)
    got, _ = drained(streams.background(stream, side=side, initial=initial))
    want, _ = model_by_hand(later, models)
    assert {(r.session, r.camera, r.x, r.y, r.frame_idx): r.foreground for r in got} == want and len(got) == len(later)
    assert 0 < sum(want.values()) < len(want)


def test_blocks_are_forgotten_after_their_time_to_live(spark):
    path = tables.fresh_path(spark, "batches")
    put = lambda frame, v: spark.createDataFrame([(1, 0, 0, 0, frame, v)], PIXELS).coalesce(1).write.mode("append").parquet(path)
    put(0, 50.0)
    stream = spark.readStream.schema(PIXELS).parquet(path)

    def seen(sink, frame):
        for _ in range(60):
            found = [r.foreground for r in spark.read.schema("frame_idx bigint, foreground boolean").parquet(sink).where(F.col("frame_idx") == frame).collect()]
            if found:
                return found[0]
            time.sleep(0.5)
        raise AssertionError("the stream wrote nothing")

    flags = {}
    for ttl in (600_000, 3_000):
        sink, mark = tables.fresh_path(spark, "sink"), tables.fresh_path(spark, "progress")
        spark.createDataFrame([], "frame_idx bigint, foreground boolean").write.parquet(sink)
        run = streams.background(stream, ttl_ms=ttl).select("frame_idx", "foreground").writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(sink)).option("checkpointLocation", mark).trigger(processingTime="1 second").start()
        try:
            seen(sink, 0)
            time.sleep(5)
            put(ttl, 250.0)
            flags[ttl] = seen(sink, ttl)
        finally:
            run.stop()
    assert flags == {600_000: True, 3_000: False}


def test_sliding_windows(spark):
    rows = [point(f) for f in range(0, 90)] + [END]
    out, _ = drained(streams.rates(in_batches(spark, [rows, [(-1, "end", 100_001, 0.0, 0.0, 0.0, 1.0, 0.0)]], POINTS), "2 seconds", "1 second", delay="0 seconds"))
    got = {r.start.second: r.n for r in out if r.session == 1}
    assert got == {59: 30, 0: 60, 1: 60, 2: 30}


def test_stream_archive_by_session(spark):
    path, mark = tables.fresh_path(spark, "archive"), tables.fresh_path(spark, "progress")
    rows = [point(f, session=s) for f in range(5) for s in (1, 2)]
    stream = in_batches(spark, [rows[:4], rows[4:]], POINTS)
    for _ in range(2):  # started again, it goes on where it was and writes nothing twice
        streams.archive(stream, path, mark).awaitTermination(120)
    found = spark.read.parquet(path)
    assert collections.Counter((r.session, r.frame_idx) for r in found.select("session", "frame_idx").collect()) == collections.Counter((r[0], r[2]) for r in rows)
    assert found.where(F.col("session") == 1).count() == 5
