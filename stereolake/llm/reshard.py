"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities, rewrite only the files that change.

A layout is a written table: files under folders of their shard. Each file is a block, and its size is the sum of its rows'
sizes. The flow runs over a small network, source to old shards to new shards to sink: an arc from an old shard to the new
one of the same number costs nothing, any other costs its price for each byte (1 unless told otherwise). Successive
shortest augmenting paths solve it on the driver, whose work follows from the number of shards alone. Each old shard's
blocks are then laid along its arcs: a block inside the arc to its own shard stays as the file it is, one inside another
arc is written anew under its new shard, and only the blocks that an arc's end cuts are dealt row by row, largest rows
first to the arc with most room left, so shards come near their capacities by about the size of a small row.

Defined cases: shards without rows have no files; null sizes and sizes below 0 count as 0; an empty table stays empty; rows
that are equal keep places of their own; all columns, of any name, stay as they are (in the struct `doc`).
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, shared_folder


@dataclass
class Layout:
    """A table in files by shard: for each folder that holds some of them, their names (None: all that it holds)."""

    spark: SparkSession
    schema: StructType
    folders: tuple[tuple[str, tuple[str, ...] | None], ...]

    def rows(self) -> DataFrame:
        """doc, size, row, old, shard and file of all rows."""
        out = self.spark.createDataFrame([], self.schema).withColumn("file", F.lit("").cast("string"))
        for path, names in self.folders:
            read = self.spark.read.schema(self.schema).option("basePath", path).parquet(*([path] if names is None else names))
            out = out.unionByName(read.withColumn("file", F.col("_metadata.file_path")))
        return out

    def only(self, names: list[str]) -> Layout:
        """The part of the layout that lies in the named files."""
        found = []
        for path, _ in self.folders:
            own = tuple(n for n in names if f"/{path.rsplit('/', 1)[-1]}/" in n)
            if own:
                found.append((path, own))
        return Layout(self.spark, self.schema, tuple(found))


def _write(rows: DataFrame, name: str) -> tuple[str, StructType]:
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy("shard").parquet(path)
    return path, StructType([*[f for f in rows.schema if f.name != "shard"], rows.schema["shard"]])


def write_layout(rows: DataFrame, shard: Column, size: Column) -> Layout:
    """rows as a layout by the given shard number; tasks write what they read, nothing is shuffled."""
    own = rows.select(F.struct("*").alias("doc"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row"), shard.cast("int").alias("shard"))
    path, schema = _write(own.withColumn("old", F.col("shard")), "layout")
    return Layout(rows.sparkSession, schema, ((path, None),))


def shard_sizes(layout: Layout) -> dict[int, int]:
    """Bytes of each shard: one number a shard reaches the driver."""
    return {r.shard: r.size for r in layout.rows().groupBy("shard").agg(F.sum("size").alias("size")).collect()}


def even_capacities(layout: Layout, shards: int) -> dict[int, int]:
    """Capacities of shards 0 to shards - 1 that share all bytes, at most one byte apart."""
    total = sum(shard_sizes(layout).values())
    return {i: total // shards + (i < total % shards) for i in range(shards)}


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], price: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Bytes to go from each old to each new shard at the least total cost; price holds (old, new) arcs, the rest cost 0 or 1.

    Shortest augmenting paths with potentials over the residual network, so every price of 0 or more is allowed. Raises
    ValueError where the capacities don't hold all supply.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the capacities don't hold all bytes")
    price = price or {}
    cost = {(i, j): price.get((i, j), int(i != j)) for i in supply for j in capacity}
    flow = dict.fromkeys(cost, 0)
    left, room = dict(supply), dict(capacity)
    potential = {("old", i): 0 for i in supply} | {("new", j): 0 for j in capacity}
    while any(left.values()):
        reach = {("old", i): 0 for i, n in left.items() if n}
        heap, came = [(0, node) for node in reach], {}
        heapq.heapify(heap)
        while heap:
            far, node = heapq.heappop(heap)
            if far > reach[node]:
                continue
            side, k = node
            steps = [(("new", j), cost[k, j]) for j in capacity] if side == "old" else [(("old", i), -cost[i, k]) for i in supply if flow[i, k]]
            for to, c in steps:
                new = far + c + potential[node] - potential[to]
                if new < reach.get(to, new + 1):
                    reach[to], came[to] = new, node
                    heapq.heappush(heap, (new, to))
        goal = min((n for n in reach if n[0] == "new" and room[n[1]]), key=lambda n: (reach[n] + potential[n], n[1]))
        for node in potential:
            potential[node] += min(reach.get(node, reach[goal]), reach[goal])
        path = [goal]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        arcs = list(zip(path, path[1:]))
        sent = min([left[path[0][1]], room[goal[1]], *[flow[b[1], a[1]] for a, b in arcs if a[0] == "new"]])
        for a, b in arcs:
            if a[0] == "old":
                flow[a[1], b[1]] += sent
            else:
                flow[b[1], a[1]] -= sent
        left[path[0][1]] -= sent
        room[goal[1]] -= sent
    return {arc: n for arc, n in flow.items() if n}


def _arcs(spark: SparkSession, flow: dict[tuple[int, int], int], empty: dict[int, int]) -> DataFrame:
    """(shard, to, low, high): each old shard's line of bytes cut by its arcs, its own shard first; empty: where shards without bytes go."""
    lines: dict[int, int] = {}
    rows = []
    for (i, j), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        rows.append((i, j, lines.get(i, 0), lines.get(i, 0) + n))
        lines[i] = rows[-1][3]
    rows += [(i, j, 0, 1) for i, j in empty.items()]
    return spark.createDataFrame(rows, "shard int, to int, low long, high long")


def plan_blocks(layout: Layout, flow: dict[tuple[int, int], int], empty: dict[int, int]) -> DataFrame:
    """(file, shard, moves) with moves an array of (to, bytes): one for a block that goes as a whole, more for one that is cut."""
    blocks = layout.rows().groupBy("shard", "file").agg(F.sum("size").alias("size"))
    line = Window.partitionBy("shard").orderBy("file")  # a row for each file
    blocks = blocks.withColumn("stop", F.sum("size").over(line)).withColumn("start", F.col("stop") - F.col("size"))
    arcs = _arcs(layout.spark, flow, empty)
    # arcs are some for each shard; a file without bytes goes with the byte before it
    met = blocks.join(F.broadcast(arcs), "shard").where((F.col("low") < F.greatest("stop", F.lit(1))) & (F.col("high") > F.least("start", F.col("stop") - 1)))
    move = F.struct(F.col("low"), F.col("to"), (F.least("stop", "high") - F.greatest("start", "low")).alias("bytes"))
    return met.groupBy("file", "shard").agg(F.array_sort(F.collect_list(move)).alias("moves"))


def _deal(cut: DataFrame) -> DataFrame:
    """(row, to) of the rows of blocks that an arc's end cuts: the largest rows first, each to the arc with most room left."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row"], ascending=[False, True])
        heap = [(-m["bytes"], k, m["to"]) for k, m in enumerate(rows["moves"].iloc[0])]
        heapq.heapify(heap)
        to = []
        for size in rows["size"].tolist():
            room, k, shard = heap[0]
            heapq.heapreplace(heap, (room + size, k, shard))
            to.append(shard)
        return pd.DataFrame({"row": rows["row"], "to": to})

    return cut.groupBy("file").applyInPandas(deal, "row long, to int")


def reshard(layout: Layout, capacity: dict[int, int], price: dict[tuple[int, int], int] | None = None) -> Layout:
    """The layout brought to the capacities: files inside their own shard's arc are kept, the others written anew.

    What reaches the driver is a row for each shard and the names of files, as a table's manifest would hold them.
    """
    if not capacity:
        raise ValueError("no shard to put rows in")
    sizes = shard_sizes(layout)
    flow = min_cost_flow(sizes, capacity, price)
    empty = {i: i if i in capacity else min(capacity) for i, n in sizes.items() if not n}
    plan = materialize(plan_blocks(layout, flow, empty), "block-plan")
    whole = plan.where("size(moves) = 1").select("file", "shard", F.col("moves")[0]["to"].alias("to"))
    stay = [r.file for r in whole.where("`to` = shard").toLocalIterator()]
    moved: dict[int, list[str]] = {}
    for r in whole.where("`to` <> shard").toLocalIterator():
        moved.setdefault(r.to, []).append(r.file)
    cut_files = [r.file for r in plan.where("size(moves) > 1").select("file").toLocalIterator()]

    parts = [layout.only(names).rows().withColumn("shard", F.lit(to).cast("int")) for to, names in sorted(moved.items())]
    if cut_files:
        cut = layout.only(cut_files).rows()
        to = _deal(cut.select("file", "row", "size").join(plan.select("file", "moves"), "file"))
        parts.append(cut.join(to, "row").withColumn("shard", F.col("to")).drop("to"))
    kept = layout.only(stay).folders
    if not parts:
        return Layout(layout.spark, layout.schema, kept)
    path, schema = _write(reduce(DataFrame.unionByName, parts).drop("file"), "resharded")
    return Layout(layout.spark, schema, (*kept, (path, None)))
