"""What the operators of this subpackage share: a shared-folder cut of the lineage, Arrow slices, byte hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: The words of the contracts are maximal runs of anything but these bytes.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests), a temporary one that is set for the session."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, named: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """rows joined with named, which has one row for each key: a key with many rows is spread over salts by column `by`.

    named goes only to the salts that a key's rows have, so a key with one row costs one row.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    spread = salted.select(key, "salt").distinct().join(named, key)
    return salted.join(spread, [key, "salt"]).drop("salt")


def small_batches(spark: SparkSession, rows: int = 500, size: int = 2 << 20) -> None:
    """Arrow batches of at most so many rows and bytes, as rows hold whole texts; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        set_to = spark.conf.get(key).lower().removesuffix("b")
        if not set_to.isdigit() or not 0 < int(set_to) <= most:
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts have about limit bytes together (or a single longer row)."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + limit, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give freed memory of this Python worker back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, schema: str, limit: int = 1 << 19, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow that hands fn slices of bounded bytes, so that a worker's memory doesn't grow with the batch.

    done is called at the end of each partition, to drop what fn keeps.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                if out is not None:
                    yield out
        if done:
            done()
        release()

    return df.mapInArrow(run, schema)


def by_text(spark: SparkSession, fn: Callable[[pa.RecordBatch], pa.Array], kind: str, *columns: Column, done: Callable[[], None] | None = None) -> Column:
    """A column fn(batch) of the given columns, the first of which is a text: only these go to Python, rows stay where they are.

    fn gets slices of bounded bytes with columns "c0", "c1" and so on.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.Array] | Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            arrays = arrays if isinstance(arrays, tuple) else (arrays,)
            batch = pa.RecordBatch.from_arrays(list(arrays), [f"c{i}" for i in range(len(arrays))])
            found = [fn(part) for part in slices(batch, "c0")]
            yield pa.concat_arrays(found) if found else pa.nulls(0, to_arrow_type(spark_type))
        if done:
            done()
        release()

    spark_type = DataType.fromDDL(kind)
    if len(columns) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(batches)

        return F.arrow_udf(one, kind)(*columns)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(many, kind)(*columns)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    col = batch.column(column)
    return [b if b is not None else b"" for b in pc.cast(col, pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that any bits of a polynomial hash may be used."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class ByteHasher:
    """Hashes of arbitrary spans of a byte buffer from one running sum: sum of table[byte] * step^position, shifted back to position 0.

    Powers of the step are tables of PIECE places, and a power for each piece of the buffer, so nothing kept grows with it.
    """

    PIECE = 1 << 14

    def __init__(self, seed: int = 17):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))
        inverse = pow(_STEP, -1, 1 << 64)
        self.forward, self.back = _powers(_STEP, self.PIECE), _powers(inverse, self.PIECE)
        self.leap, self.leap_back = pow(_STEP, self.PIECE, 1 << 64), pow(inverse, self.PIECE, 1 << 64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        power = 1
        with np.errstate(over="ignore"):
            for lo in range(0, len(data), self.PIECE):
                part = data[lo : lo + self.PIECE]
                terms = self.table[part] * self.forward[: len(part)]
                np.cumsum(terms * np.uint64(power), out=out[lo + 1 : lo + 1 + len(part)])
                out[lo + 1 : lo + 1 + len(part)] += out[lo]
                power = power * self.leap & _MASK
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        far = _powers(self.leap_back, len(sums) // self.PIECE + 1)
        with np.errstate(over="ignore"):
            back = self.back[start & (self.PIECE - 1)] * far[start // self.PIECE]
            return mix((sums[stop] - sums[start]) * back + (stop - start).astype(np.uint64))


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes."""
    edge = np.diff(np.concatenate(([0], (~IS_SPACE[data]).astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_count(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
