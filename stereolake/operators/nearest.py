"""The two nearest vectors of another set, exactly, by blocks around pivots and the triangle inequality.

Targets of a key are placed with their nearest of some sampled targets, the pivots; a block is a pivot's targets with the
least and greatest distance to it. A query first meets the block of its own nearest pivot, which gives a second-nearest
distance that the true one can't exceed; then it meets just those blocks that can hold something as near: |q - p| differs
from |t - p| by no more than |q - t|. Whatever the key's size, tasks hold chunks of at most `block` vectors: chunks of
queries meet pivots, chunks of queries meet chunks of blocks. Equal vectors are asked for once, and of equal targets the
two with the least ids stand for all, so copies make no pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables

CELLS = 1 << 22


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances (n, m) of float64 vectors by one matrix product; good to about a part in 10^7 of the vectors' length."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """What the matrix product may be wrong by."""
    return 1e-6 * (1 + max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) * a.shape[1] ** 0.5)


def _vectors(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in rows[column]]) if len(rows) else np.zeros((0, 1))


def _slices(n: int, width: int) -> list[slice]:
    step = max(1, CELLS // max(width, 1))
    return [slice(lo, lo + step) for lo in range(0, n, step)]


def two_least(queries: np.ndarray, targets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, distance) of up to two targets for each query, by distance, then id; candidates are measured exactly."""
    found = []
    slack = _slack(queries, targets)
    for own in _slices(len(queries), len(targets)):
        near = distances(queries[own], targets)
        last = np.partition(near, 1, axis=1)[:, 1] if near.shape[1] > 1 else near[:, 0]
        q, t = np.nonzero(near <= last[:, None] + 2 * slack)
        off = queries[own][q] - targets[t]
        dist = np.sqrt((off * off).sum(1))
        order = np.lexsort([ids[t], dist, q])
        q, t, dist = q[order], t[order], dist[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < 2
        found.append((q[keep] + own.start, t[keep], dist[keep]))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _chunk(by: Column, n: Column, size: int) -> Column:
    """A chunk number, so that about `size` of n rows are in each."""
    return F.pmod(F.xxhash64(by), F.greatest(F.ceil(n / size), F.lit(1))).cast("int")


def _each_chunk(n: Column, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.greatest(F.ceil(n / size), F.lit(1)) - 1).cast("int")))


def _fields(df: DataFrame, *columns: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def _apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be cogrouped with what it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _beside_pivots(rows: DataFrame, pivots: DataFrame, key: list[str], fn, schema: str, block: int) -> DataFrame:
    """fn(chunk of rows, all pivots of its key); rows have id and d, pivots come with what fn needs."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    chunked = rows.join(sizes, key).withColumn("_chunk", _chunk(F.col("id"), F.col("_n"), block)).drop("_n")
    copies = pivots.join(sizes, key).withColumn("_chunk", _each_chunk(F.col("_n"), block)).drop("_n")
    return chunked.groupBy(*key, "_chunk").cogroup(_apart(copies).groupBy(*key, "_chunk")).applyInPandas(fn, schema)


def place(targets: DataFrame, pivots: DataFrame, key: list[str], block: int) -> DataFrame:
    """Adds to targets (key, id, d) the pivot that is nearest and its distance."""

    def nearest(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        around = around.sort_values("pivot")
        a, b = _vectors(rows, "d"), _vectors(around, "p")
        at, r = np.zeros(len(a), dtype=int), np.zeros(len(a))
        for own in _slices(len(a), len(b)):
            at[own] = distances(a[own], b).argmin(1)
            r[own] = np.sqrt(((a[own] - b[at[own]]) ** 2).sum(1))
        return rows[[*key, "id", "d"]].assign(pivot=around["pivot"].to_numpy()[at], r=r)

    return _beside_pivots(targets, pivots, key, nearest, f"{_fields(targets, *key, 'id', 'd')}, {_fields(pivots, 'pivot')}, r double", block)


def own_block(queries: DataFrame, blocks: DataFrame, key: list[str], block: int) -> DataFrame:
    """(key, id, d, pivot) of the queries: their nearest pivot's block that has two targets or more, or else any."""

    def choose(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        around = around.sort_values("pivot")
        if (around["n"] > 1).any():
            around = around[around["n"] > 1]
        a, b = _vectors(rows, "d"), _vectors(around, "p")
        at = np.concatenate([distances(a[own], b).argmin(1) for own in _slices(len(a), len(b))])
        return rows[[*key, "id", "d"]].assign(pivot=around["pivot"].to_numpy()[at])

    return _beside_pivots(queries, blocks, key, choose, f"{_fields(queries, *key, 'id', 'd')}, {_fields(blocks, 'pivot')}", block)


def other_blocks(queries: DataFrame, blocks: DataFrame, key: list[str], block: int) -> DataFrame:
    """(key, id, d, pivot) for every further block that can hold a target as near as `bound`; queries have done, the block they met."""

    def reach(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        a, b = _vectors(rows, "d"), _vectors(around, "p")
        low, high, pivot = (around[c].to_numpy() for c in ("low", "high", "pivot"))
        bound, done, slack = rows["bound"].to_numpy(float), rows["done"].to_numpy(), _slack(a, b)
        at, to = [], []
        for own in _slices(len(a), len(b)):
            far = distances(a[own], b)
            least = np.maximum(far - high, low - far) - 2 * slack
            i, j = np.nonzero((least <= bound[own][:, None]) & (pivot[None] != done[own][:, None]))
            at.append(i + own.start)
            to.append(j)
        at, to = np.concatenate(at), np.concatenate(to)
        return rows.iloc[at][[*key, "id", "d"]].assign(pivot=pivot[to])

    return _beside_pivots(queries, blocks, key, reach, f"{_fields(queries, *key, 'id', 'd')}, {_fields(blocks, 'pivot')}", block)


def meet(queries: DataFrame, targets: DataFrame, key: list[str], block: int) -> DataFrame:
    """(key, id, target, dist): for each query and block the two nearest of the block's targets; both sides go in chunks."""
    by = [*key, "pivot"]
    sizes = targets.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(queries.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), by)
    n, m = F.col("_n"), F.col("_m")
    asked = queries.join(sizes, by).withColumn("_own", _chunk(F.col("id"), m, block)).withColumn("_other", _each_chunk(n, block))
    given = targets.select(*by, F.col("id").alias("target"), F.col("d").alias("t")).join(sizes, by).withColumn("_other", _chunk(F.col("target"), n, block)).withColumn("_own", _each_chunk(m, block))

    def nearest(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or others.empty:
            return pd.DataFrame({c: [] for c in [*key, "id", "target", "dist"]})
        ids = others["target"].to_numpy()
        q, t, dist = two_least(_vectors(rows, "d"), _vectors(others, "t"), ids)
        return rows.iloc[q][[*key, "id"]].assign(target=ids[t], dist=dist)

    group = [*by, "_own", "_other"]
    return asked.drop("_n", "_m").groupBy(*group).cogroup(_apart(given.drop("_n", "_m")).groupBy(*group)).applyInPandas(nearest, f"{_fields(queries, *key, 'id')}, {_fields(given, 'target')}, dist double")


def _two(found: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key, "id").orderBy("dist", "target")
    return found.withColumn("place", F.row_number().over(order)).where("place <= 2")


def two_nearest(queries: DataFrame, targets: DataFrame, key: list[str], block: int = 2048, seed: int = 5) -> DataFrame:
    """(key, id, target, dist, place): the two nearest targets of every query of the same key, ties by the target's id.

    Both sides are (key, id, d) with ids that are unique in a key and d an array of numbers of one length; null vectors are
    left out. Vectors that are equal must have been brought down to one query, and to two targets, by the caller.
    """
    queries, targets = queries.where("d IS NOT NULL"), targets.where("d IS NOT NULL")
    sizes = targets.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > block)
    # keys of one block: everything meets at once
    small = sizes.where(F.col("n") <= block).select(*key)
    whole = lambda rows: rows.join(small, key, "left_semi").withColumn("pivot", F.lit(0).cast(dict(targets.dtypes)["id"]))
    found = meet(whole(queries), whole(targets), key, block)
    if not large.limit(1).count():
        return _two(found, key)

    targets, queries = (tables.cut(df.join(large.select(*key), key, "left_semi")) for df in (targets, queries))
    # a pivot for each block's worth of targets, at most about the root of their number; the one of least hash is always there
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / (1 << 30)
    wanted = F.least(F.ceil(F.col("n") / block), F.ceil(F.sqrt("n"))) * 2
    first = targets.groupBy(*key).agg(F.min_by(F.struct("id", "d"), F.struct(draw.alias("h"), F.col("id"))).alias("first")).select(*key, "first.*")
    drawn = targets.join(large, key).where(draw < wanted / F.col("n")).select(*key, "id", "d")
    pivots = tables.cut(drawn.unionByName(first).dropDuplicates([*key, "id"]).select(*key, F.col("id").alias("pivot"), F.col("d").alias("p")))
    placed = tables.cut(place(targets, pivots, key, block))
    radii = placed.groupBy(*key, "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    blocks = tables.cut(pivots.join(radii, [*key, "pivot"]))
    began = tables.cut(own_block(queries, blocks, key, block))
    near = tables.cut(meet(began, placed, key, block))
    # with fewer than two targets met nothing can be left out
    bound = _two(near, key).groupBy(*key, "id").agg(F.when(F.count(F.lit(1)) == 2, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    more = other_blocks(began.withColumnRenamed("pivot", "done").join(bound, [*key, "id"]), blocks, key, block)
    return _two(found.unionByName(near).unionByName(meet(tables.cut(more), placed, key, block)), key)
