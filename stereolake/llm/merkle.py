"""Merkle dataset manifest: leaves and the outer nodes they need are cogrouped by superblock.

Each source's leaves, ascending by id, form a tree in which every RUN consecutive nodes become one; the sources' tops form
another such tree, whose top is the root. A superblock is RUN^LEVELS consecutive nodes of one tree. Going up, superblocks are
reduced to one digest each, level by level of superblocks until one is left, so no task holds more than a superblock. Going
down, a superblock's nodes are cogrouped with the proof that its own digest got one level higher, and one function reduces
the block again, joins each node's siblings inside the block with the outer ones, and at the leaves folds the proof.

Defined cases: a null field is written `-`, as is a column that is absent; null ids come first; rows that are equal in all
fields are leaves of their own next to each other; an empty table gives no rows. Texts of any length are hashed by the JVM
and don't travel: what is shuffled are ids and digests. Further columns of any name are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RUN, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOW = (1 << 33) - 1


def digest(*parts: str) -> str:
    """H of the contract: hex SHA-256 of the parts one after the other, digests as their hex text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """One field of a leaf: `-` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, group: str | None, *order: Column, name: str, ranked: bool = False) -> DataFrame:
    """rows with `at`, their place from 0 within their group by the order, and `n`, the rows of the group.

    Rows are dealt by ranges and sorted; a row's number is its place in its range plus what the ranges before hold of its
    group, so a group of any size is spread over all tasks. ranked adds `group_at` and `n_groups`: the group's place among
    all groups, null first. rows must come from a written table, as Spark reads them twice.
    """
    key = [F.asc_nulls_first(group)] if group else []
    dealt = rows.withColumn("_twin", F.monotonically_increasing_id()).repartitionByRange(*key, *order, "_twin").sortWithinPartitions(*key, *order, "_twin").drop("_twin")
    dealt = materialize(dealt.withColumn("_mid", F.monotonically_increasing_id()), name)
    part, place = F.shiftrightunsigned("_mid", 33), F.col("_mid").bitwiseAND(F.lit(_LOW))
    own = F.col(group) if group else F.lit(0)
    # a row for each range and group; the window runs over these, not over the rows
    ranges = dealt.groupBy(part.alias("_part"), own.alias("_group")).agg(F.count("*").alias("_count"), F.min(place).alias("_first"))
    window = Window.partitionBy("_group")
    ranges = ranges.withColumn("_before", F.sum("_count").over(window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.sum("_count").over(window))
    more = []
    if ranked:
        ranges = materialize(ranges, f"{name}-ranges")
        groups = numbered(ranges.select("_group").distinct(), None, F.asc_nulls_first("_group"), name=f"{name}-groups")
        groups = groups.select(F.col("_group").alias("_own"), F.col("at").alias("group_at"), F.col("n").alias("n_groups"))
        ranges, more = ranges.join(groups, ranges["_group"].eqNullSafe(groups["_own"])), ["group_at", "n_groups"]
    placed = dealt.withColumn("_part", part)
    same = placed["_part"] == ranges["_part"]
    if group:
        same &= placed[group].eqNullSafe(ranges["_group"])
    return placed.join(ranges, same).select(*[placed[c] for c in rows.columns], (F.coalesce("_before", F.lit(0)) + place - F.col("_first")).alias("at"), "n", *more)


def reduced(nodes: list[str], whole: bool, run: int, levels: int, paths: bool = True) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of a superblock's nodes and, for each node, its siblings before and after it level by level.

    whole: the block is all of its tree, and reducing ends when one node is left; else it goes on for all levels.
    """
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes] if paths else []
    level, width = nodes, 1
    for _ in range(levels):
        if whole and len(level) == 1:
            break
        runs = [level[i : i + run] for i in range(0, len(level), run)]
        for i, own in enumerate(steps):
            members, place = runs[i // (width * run)], i // width % run
            own.append(("".join(members[:place]), "".join(members[place + 1 :])))
        level, width = [digest(*r) for r in runs], width * run
    return level[0], steps


def _blocked(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / width).cast("long"))


def _up(nodes: DataFrame, run: int, levels: int) -> DataFrame:
    """(tree, at, n, digest) of the superblocks of (tree, at, n, digest)."""
    width = run**levels

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n = int(rows["n"].iloc[0])
        found, _ = reduced(rows["digest"].tolist(), n <= width, run, levels, paths=False)
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "n": [-(-n // width)], "digest": [found]})

    return _blocked(nodes.select("tree", "at", "n", "digest"), width).groupBy("tree", "block").applyInPandas(top, "tree long, at long, n long, digest string")


_STEPS = "array<struct<before:string,after:string>>"


def _paths(rows: pd.DataFrame, outer: pd.DataFrame, run: int, levels: int) -> Iterator[list[tuple[str, str]]]:
    """Whole proofs of a superblock's nodes: siblings inside it, then the block's own proof."""
    beyond = [(s["before"], s["after"]) for s in outer["steps"].iloc[0]]
    _, inside = reduced(rows["digest"].tolist(), int(rows["n"].iloc[0]) <= run**levels, run, levels)
    for steps in inside:
        yield steps + beyond


def _down(nodes: DataFrame, outer: DataFrame, run: int, levels: int) -> DataFrame:
    """(tree, at, steps) of nodes, from (tree, at, steps) of their superblocks."""

    def joined(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        steps = [[{"before": b, "after": a} for b, a in p] for p in _paths(rows, above, run, levels)]
        return pd.DataFrame({"tree": rows["tree"], "at": rows["at"], "steps": steps})

    blocks = _blocked(nodes, run**levels).groupBy("tree", "block")
    return blocks.cogroup(outer.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInPandas(joined, f"tree long, at long, steps {_STEPS}")


def manifest(rows: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, tree: str = "source", run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified for every row; the first field is the id.

    tampered: the row's last field (the text) as an attacker left it; equal to the field where nothing was done. The folded
    root starts from the tampered leaf and takes the original siblings.
    """
    if run < 2 or levels < 1:
        raise ValueError("a run has two nodes or more, a superblock one level or more")
    own = [F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in fields]
    source = F.col(tree) if tree in rows.columns else F.lit(None).cast("string")
    leaves = materialize(rows.select(own[0].alias("id"), source.alias("source"), leaf(*own).alias("digest"), leaf(*own[:-1], tampered).alias("tampered")), "leaves")
    leaves = numbered(leaves, "source", F.asc_nulls_first("id"), F.asc("digest"), name="ordered-leaves", ranked=True)
    leaves = materialize(leaves.withColumnRenamed("group_at", "tree").drop("source"), "numbered-leaves")
    trees = leaves.where("at = 0").select("tree", "n_groups")

    # up: superblocks of leaves until each tree is one node, then superblocks of tops until one is left
    stages = [leaves]
    while stages[-1].where("n > 1").limit(1).count():
        stages.append(materialize(_up(stages[-1], run, levels), "tops"))
    tops = stages.pop().select("tree", "n", "digest")
    crowns = [tops.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("n_groups").alias("n"), "digest")]
    while crowns[-1].where("n > 1").limit(1).count():
        crowns.append(materialize(_up(crowns[-1], run, levels), "crowns"))
    root = crowns.pop()

    # down: proofs of the tops, then of each stage's nodes
    steps = root.select("tree", "at", F.array().cast(_STEPS).alias("steps"))
    for nodes in reversed(crowns):
        steps = _down(nodes, steps, run, levels)
    outer = steps.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "steps")
    for nodes in reversed(stages[1:]):
        outer = _down(nodes, outer, run, levels)
    # every superblock of leaves gets the two digests it is to name beside its proof; the root is one row
    top = root.first()
    outer = outer.join(tops.select("tree", F.col("digest").alias("subroot")), "tree").withColumn("root", F.lit(top.digest if top else None).cast("string"))
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def finished(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        subroot, top = above["subroot"].iloc[0], above["root"].iloc[0]
        proofs, folds = [], []
        for paths, now in zip(_paths(block, above, run, levels), block["tampered"]):
            proofs.append(digest(*[s for step in paths for s in step]))
            for before, after in paths:
                now = digest(before, now, after)
            folds.append(now)
        return pd.DataFrame({"id": block["id"], "leaf": block["digest"], "subroot": subroot, "root": top, "proof_sha256": proofs, "folded_root": folds, "verified": [f == top for f in folds]})

    # ids travel as text, as pandas would turn integers with nulls into floats
    wanted = _blocked(leaves, run**levels).select("tree", "block", "at", "n", F.col("id").cast("string").alias("id"), "digest", "tampered").groupBy("tree", "block")
    proven = wanted.cogroup(outer.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInPandas(finished, schema)
    return proven.withColumn("id", F.col("id").cast(leaves.schema["id"].dataType))
