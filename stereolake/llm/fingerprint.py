"""Document fingerprints: an improbable-feature digest of byte windows in chained Bloom filters.

Every 64-byte window of a text has an entropy; windows whose entropy few windows of the corpus have are improbable. A
window is selected when it is the rarest of many of the runs of 64 consecutive windows it lies in. The selected windows
go, in order, into a chain of Bloom filters of 2048 bits with at most 160 windows each. Two fingerprints are alike as far
as their filters share more bits than filters so full share by chance.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, map_slices, materialize, release, slices, small_batches, text_bytes

WINDOW, RUN, POPULAR, PER_FILTER, BITS, HASHES, LEVELS = 64, 64, 16, 160, 2048, 5, 512
GAP = WINDOW + RUN
CHUNK, TASK_BYTES, MOST_TASKS = 1 << 18, 32 << 20, 100_000
_NEVER = np.int64(1) << 60


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with the texts apart by gaps, so that no window or run touches two; starts and window counts.

    A text shorter than a window counts as one window, filled up with bytes 0; an empty one has none.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    room = np.maximum(lengths, WINDOW) + GAP
    starts = GAP + np.concatenate(([0], np.cumsum(room)[:-1]))
    data = np.zeros(int(room.sum()) + 2 * GAP, dtype=np.uint8)
    for s, t in zip(starts.tolist(), texts):
        data[s : s + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return data, starts, np.where(lengths > 0, np.maximum(lengths - WINDOW + 1, 1), 0)


def window_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of the window that starts at each place, in LEVELS steps.

    Moving a window by one byte changes two counts. How often a byte occurs in the window before it and in the one after
    it comes from WINDOW - 1 shifted comparisons of the whole buffer, so the entropies are one running sum.
    """
    n = len(data)
    ahead, behind = np.ones(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    block = 1 << 16
    for lo in range(0, n, block):
        hi = min(n, lo + block + WINDOW)
        part = data[lo:hi]
        core = min(block, n - lo)
        for j in range(1, WINDOW):
            m = min(core, len(part) - j)
            if m <= 0:
                break
            same = part[:m] == part[j : j + m]
            ahead[lo : lo + m] += same
            behind[lo + j : lo + j + m] += same
        m = min(core, len(part) - WINDOW)
        if m > 0:
            behind[lo + WINDOW : lo + WINDOW + m] += part[:m] == part[WINDOW : WINDOW + m]
    # c * log2(c) in exact integer steps, so that equal windows have equal levels wherever they stand
    c = np.arange(WINDOW + 2, dtype=np.float64)
    cost = np.rint(c * np.log2(np.maximum(c, 1)) * 4096).astype(np.int64)
    # window at i -> i + 1: data[i] leaves (it occurs ahead[i] times), data[i + WINDOW] comes (behind counts the byte itself that left)
    count = n - WINDOW + 1
    leaving = ahead[: count - 1].astype(np.int64)
    coming = behind[WINDOW : WINDOW + count - 1].astype(np.int64)
    same = data[: count - 1] == data[WINDOW : WINDOW + count - 1]
    coming = coming - same
    step = cost[leaving - 1] - cost[leaving] + cost[coming + 1] - cost[coming]
    step[same] = 0
    first = np.bincount(data[:WINDOW], minlength=256)
    sums = int(cost[first].sum()) + np.concatenate(([0], np.cumsum(step)))
    top = int(cost[WINDOW])
    return ((top - sums) * (LEVELS - 1) // top).astype(np.int64)


def _chunks(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, around: int):
    """(first, offset, levels, inside) of stretches of the buffer, with `around` windows more on either side, so that what
    a long text needs doesn't grow with it; windows that belong to the stretch begin at offset."""
    last = len(data) - WINDOW + 1
    for lo in range(0, last, CHUNK):
        first, hi = max(0, lo - around), min(last, lo + CHUNK + around)
        at = np.arange(first, hi)
        owner = np.searchsorted(starts, at, side="right") - 1
        inside = (owner >= 0) & (at < starts[owner] + counts[owner])
        yield first, lo - first, window_levels(data[first : hi + WINDOW - 1]), inside


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    data, starts, counts = _laid_out(texts)
    total = np.zeros(LEVELS, dtype=np.int64)
    for _, _, levels, inside in _chunks(data, starts, counts, 0):
        total += np.bincount(levels[inside], minlength=LEVELS)
    return total


def selected(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where the windows start that are the rarest of at least POPULAR runs; the leftmost is the rarest among equals."""
    found = []
    for first, offset, levels, inside in _chunks(data, starts, counts, RUN):
        n = len(levels)
        best = np.where(inside, ranks[levels] << 32 | np.arange(n), _NEVER)
        width = 1
        while width < RUN:
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        best = best[best < _NEVER]
        popular = np.flatnonzero(np.bincount(best & 0xFFFFFFFF, minlength=n) >= POPULAR)
        found.append(first + popular[(popular >= offset) & (popular < offset + CHUNK)])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


_HASHER: list[ByteHasher] = []


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text: rows of BITS / 8 bytes. ranks: by level, small for rare levels."""
    if not _HASHER:
        _HASHER.append(ByteHasher(29))
    data, starts, counts = _laid_out(texts)
    chosen = selected(data, starts, counts, ranks)
    owner = np.searchsorted(starts, chosen, side="right") - 1
    place = np.arange(len(chosen)) - np.searchsorted(owner, owner, side="left")
    per_text = np.bincount(owner, minlength=len(texts))
    filters = -(-per_text // PER_FILTER)
    base = np.concatenate(([0], np.cumsum(filters)))
    h = _HASHER[0].spans(_HASHER[0].sums(data), chosen, chosen + WINDOW)
    flags = np.zeros(int(base[-1]) * BITS, dtype=bool)
    slot = (base[owner] + place // PER_FILTER) * BITS
    for i in range(HASHES):
        flags[slot + ((h >> np.uint64(12 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(flags).reshape(-1, BITS // 8)
    return [packed[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, by the bits they share beyond chance."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for i, row in enumerate(a):
        shared = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        chance, most = na[i] * nb / BITS, np.minimum(na[i], nb)
        # a third of the way from chance to full agreement still counts as nothing
        floor = chance + 0.3 * (most - chance)
        best[i] = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max()
    return float((best * na).sum() / na.sum())


def to_text(chain: np.ndarray) -> str:
    return ":".join(base64.b64encode(row.tobytes()).decode() for row in chain)


def from_text(text: str) -> np.ndarray:
    rows = [np.frombuffer(base64.b64decode(r), dtype=np.uint8) for r in text.split(":") if r]
    return np.stack(rows) if rows else np.zeros((0, BITS // 8), dtype=np.uint8)


def window_counts(docs: DataFrame, text_col: str) -> dict[int, int]:
    """How many windows of all the texts have each entropy level. Each task counts its own; LEVELS rows at most reach the driver."""

    def run(batches):
        total = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch):
                total += level_counts(text_bytes(part, "text"))
        release()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["level", "windows"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "level bigint, windows bigint").groupBy("level").agg(F.sum("windows").alias("windows"))
    return {r["level"]: r["windows"] for r in counts.collect()}


def level_ranks(found: dict[int, int]) -> list[int]:
    """Rank of each entropy level by how few windows have it (ties: the lower level first)."""
    order = sorted(range(LEVELS), key=lambda i: (found.get(i, 0), i))
    ranks = [0] * LEVELS
    for rank, level in enumerate(order):
        ranks[level] = rank
    return ranks


def _parts(batch: pa.RecordBatch):
    yield from slices(batch, "text")


def fingerprint(docs: DataFrame, id_col: str, text_col: str, ranks: list[int]) -> DataFrame:
    """(id, fingerprint): base64 filters joined by ':'; null and empty texts have ''. Equal texts, equal fingerprints."""
    small_batches(docs.sparkSession)
    table = np.array(ranks, dtype=np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        chains = digests(text_bytes(batch, "text"), table)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(c) for c in chains], pa.string())], ["id", "fingerprint"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(source, run, "text", f"id {dict(source.dtypes)['id']}, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str, n_bytes: int = 0) -> DataFrame:
    """(id, text, next_text): next_text belongs to the next row in descending order of id, after the last the first.

    Rows are range partitioned by id and sorted within partitions, so the next row stands right before; there is a
    partition for each 32 MB of n_bytes, and as many as Spark shuffles to at least. Only the first row of each partition
    needs the last one of the partition before: these rows go along once more, as context, found from the least and
    greatest id of each partition. Null ids come last; rows with equal ids are ordered by a hash of their text, and equal
    rows are interchangeable. Ids are numbers or strings.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES)), MOST_TASKS)
    ids = source.select("id", F.xxhash64("text").alias("h")).repartitionByRange(parts, F.col("id").asc_nulls_first(), F.col("h"))
    ids = ids.withColumn("part", F.spark_partition_id())
    edges = ids.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "h")).alias("least"), F.max(F.struct(F.col("id").isNotNull().alias("k"), "id", "h")).alias("most"))
    edges = materialize(edges, "fingerprint-edges")  # a row for each partition
    bounds = [(r["part"], r["least"]["k"], r["least"]["id"], r["least"]["h"], r["most"]["id"], r["most"]["h"]) for r in edges.orderBy("part").collect()]
    if not bounds:
        return source.select("id", "text", F.lit(None).cast("string").alias("next_text"))
    schema = f"part int, id {dict(source.dtypes)['id']}, h bigint"
    later = spark.sparkContext.broadcast([(b[1], b[2], b[3]) for b in bounds[1:]])  # where each later partition starts

    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([bisect_right(later.value, (i is not None, i, h)) for i, h in zip(ids.to_pylist(), hashes.to_pylist())], pa.int32())

    keyed = source.withColumn("h", F.xxhash64("text"))
    placed = keyed.withColumn("part", F.arrow_udf(place, "int")("id", "h")).withColumn("context", F.lit(False))
    lasts = [(n, bounds[n - 1][4], bounds[n - 1][5]) for n in range(len(bounds))]  # of the part before; of the last part for part 0
    wanted = spark.createDataFrame(lasts, schema).withColumnsRenamed({"id": "w_id", "h": "w_h"})
    before = keyed.join(F.broadcast(wanted), keyed["id"].eqNullSafe(wanted["w_id"]) & (keyed["h"] == wanted["w_h"]))
    before = before.dropDuplicates(["part"]).select("id", "text", "h", "part", F.lit(True).alias("context"))
    rows = placed.unionByName(before).repartition(parts, "part").sortWithinPartitions("part", F.col("context").desc(), F.col("id").asc_nulls_first(), "h")
    kind = dict(source.dtypes)["id"]

    def run(batches):
        last_part, last_text = None, None
        for batch in batches:
            for part in _parts(batch):
                part_no, context = part.column("part").to_pylist(), part.column("context").to_pylist()
                texts = part.column("text").to_pylist()
                keep, following = [], []
                for i, t in enumerate(texts):
                    if not context[i]:
                        keep.append(i)
                        following.append(last_text if last_part == part_no[i] else None)
                    last_part, last_text = part_no[i], t
                out = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([out.column("id"), out.column("text"), pa.array(following, pa.string())], ["id", "text", "next_text"])

    return rows.mapInArrow(run, f"id {kind}, text string, next_text string")


def edited_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last third of the text's code points replaced by the first as many (or all) of the next row's
    text, in descending order of ids. Null texts count as empty; the likeness of two empty texts is 1, of an empty and
    another one 0. A single row is its own next. Empty tables give no rows; other columns are not carried. Very long texts
    are read whole, in stretches.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = window_counts(docs, text_col)
    table = np.array(level_ranks(windows), dtype=np.int64)
    pairs = with_next(docs, id_col, text_col, sum(windows.values()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        following = [t or "" for t in batch.column("next_text").to_pylist()]
        edited = []
        for t, f in zip(texts, following):
            k = len(t) // 3
            edited.append(t[: len(t) - k] + f[:k])
        raw = [t.encode() for t in texts]
        changed = [t.encode() for t in edited]
        after = [t.encode() for t in following]
        # the next row's text is mostly the row before in this very slice
        own = digests(raw, table)
        fresh = [i for i in range(len(raw)) if i == 0 or after[i] != raw[i - 1]]
        extra = dict(zip(fresh, digests([after[i] for i in fresh], table)))
        nexts = [extra[i] if i in extra else own[i - 1] for i in range(len(raw))]
        new = digests(changed, table)
        columns = [
            batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
            pa.array([to_text(c) for c in own], pa.string()), pa.array([to_text(c) for c in new], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, nexts)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = f"id {dict(pairs.dtypes)['id']}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_slices(pairs, run, "text", schema)
