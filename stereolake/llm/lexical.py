"""Ranked lexical search of many items at once: term sets that items share are summed once for each document.

Items are handled in blocks of bounded vocabulary. In a block, terms that exactly the same items hold form one class. Then
the pair of classes (or of pairs made before) that most items still hold side by side becomes a node of its own, again and
again while SHARED items or more hold one: each item is a list of nodes, each node a class or the sum of two others, and
the whole is a graph without cycles in which shared term sets stand once. Documents are read once: what they have of the
block's terms is a written table of term numbers and frequencies, from which the corpus counts follow. In the scoring pass
each slice of documents fills the classes' accumulators, sums the graph's nodes in order, once for each document however
many items share them, and combines items from them. Every task keeps its best documents of each item; these few rows are
ranked in two steps, so no item's candidates meet in one task before they are bounded.

All arithmetic is in 64-bit integers but for the weights, so the order of sums doesn't matter. Terms are told apart by
64-bit hashes.

Defined cases: null and empty texts have no terms, count for nothing and are never found; items without terms get no rows;
items that are equal in id and text count once; documents that are equal in all fields each keep a rank; ties go by
ascending id, null ids first; an empty table gives no rows. A text of any length is one row of numbers. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, ByteHasher, map_slices, materialize, release, small_batches, text_bytes

TOP, SHARED, BLOCK_TERMS, SALTS = 50, 3, 1 << 16, 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the terms: digits, letters and whatever isn't ASCII.
IS_TERM = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IS_TERM[_low : _high + 1] = True
_HASHER: list[ByteHasher] = []


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts in order, and the number of the text that each is in."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    if not _HASHER:
        _HASHER.append(ByteHasher(29))
    edge = np.diff(np.concatenate(([0], IS_TERM[data].astype(np.int8))))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _HASHER[0].spans(_HASHER[0].sums(data), start, stop), np.searchsorted(ends, start, side="right")


@dataclass
class Sharing:
    """How a block's items are put together: the class of each term, nodes as sums of two, and each item's nodes."""

    term_class: np.ndarray
    n_classes: int
    nodes: list[tuple[int, int]]
    items: list[np.ndarray]

    def sums(self) -> int:
        """Additions that a document costs."""
        return len(self.nodes) + sum(max(len(own) - 1, 0) for own in self.items)


def share(item_terms: list[np.ndarray], n_terms: int, least: int = SHARED) -> Sharing:
    """The sharing of items given as sets of term numbers."""
    held = np.zeros((len(item_terms), n_terms), dtype=bool)
    for i, terms in enumerate(item_terms):
        held[i, terms] = True
    patterns, term_class = np.unique(held, axis=1, return_inverse=True)
    term_class = term_class.reshape(-1)
    members: list[set[int]] = [set(np.flatnonzero(own).tolist()) for own in patterns]  # items without terms are none's business
    holders: dict[int, set[int]] = {}
    for i, own in enumerate(members):
        for c in own:
            holders.setdefault(c, set()).add(i)
    # pairs of nodes by the number of items that hold both; counts only fall, so a stale one is found when it is drawn
    common = patterns.astype(np.float32).T @ patterns.astype(np.float32)
    np.fill_diagonal(common, 0)
    a, b = np.nonzero(np.triu(common) >= least)
    waiting: dict[int, list[tuple[int, int]]] = {}
    for x, y, n in zip(a.tolist(), b.tolist(), common[a, b].astype(int).tolist()):
        waiting.setdefault(n, []).append((x, y))
    nodes: list[tuple[int, int]] = []
    for n in range(max(waiting, default=0), least - 1, -1):
        queue = sorted(waiting.pop(n, []), reverse=True)
        while queue:
            x, y = queue.pop()
            both = holders[x] & holders[y]
            if len(both) < n:
                if len(both) >= least:
                    waiting.setdefault(len(both), []).append((x, y))
                continue
            new = patterns.shape[1] + len(nodes)
            nodes.append((x, y))
            holders[x] -= both
            holders[y] -= both
            holders[new] = both
            beside: dict[int, int] = {}
            for i in both:
                members[i] -= {x, y}
                for z in members[i]:
                    beside[z] = beside.get(z, 0) + 1
                members[i].add(new)
            for z, k in sorted(beside.items()):
                if k >= least:  # never above n: both held at most n items
                    (queue if k == n else waiting.setdefault(k, [])).append((z, new))
    return Sharing(term_class, patterns.shape[1], nodes, [np.array(sorted(own), dtype=np.int64) for own in members])


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def item_blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """(id, term hashes) of the distinct items with terms, in blocks of about `most` distinct terms or one item that has more.

    The driver holds a block at a time.
    """
    block, seen = [], np.zeros(0, dtype=np.uint64)
    for r in items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct().toLocalIterator():
        own = np.unique(term_hashes([r.text.encode()])[0])
        if not len(own):
            continue
        more = np.union1d(seen, own)
        if block and len(more) > most:
            yield block
            block, more = [], own
        block.append((r.id, own))
        seen = more
    if block:
        yield block


def _found(docs: DataFrame, doc_id: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """(id, n, terms, tfs) of every document with terms: what it has of the sorted vocabulary, as term numbers and frequencies."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        h, doc = term_hashes(text_bytes(batch, "text"))
        n = np.bincount(doc, minlength=batch.num_rows)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        pairs, tf = np.unique(doc[hit] * len(known) + at[hit], return_counts=True)
        offsets = np.searchsorted(pairs // len(known), np.arange(batch.num_rows + 1))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, kind)) for v, kind in ((pairs % len(known), pa.int32()), (tf, pa.int64()))]
        out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])
        return out.filter(pa.array(n > 0))

    kind = dict(docs.dtypes)[doc_id]
    return map_slices(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), count, "text", f"id {kind}, n long, terms array<int>, tfs array<long>")


_RANKED = [("item", "ascending"), ("score", "descending"), ("id", "ascending")]


def _best(rows: pa.Table, top: int) -> pa.Table:
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=_RANKED, null_placement="at_start"))
    item = np.asarray(rows.column("item"))
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return rows.filter(pa.array(place < top))


def _scored(found: DataFrame, plan: Sharing, w: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, id, score) of each task's best documents of each item."""
    id_type = to_arrow_type(found.schema["id"].dataType)
    schema = pa.schema([("item", pa.int32()), ("id", id_type), ("score", pa.int64())])
    kept = found.sparkSession.sparkContext.broadcast((plan, w))

    def accumulators(batch: pa.RecordBatch) -> np.ndarray:
        plan, w = kept.value
        terms, tfs = batch.column("terms"), batch.column("tfs")
        doc = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(terms)))
        term, tf = np.asarray(terms.flatten()), np.asarray(tfs.flatten())
        m = 50 + (50 * np.asarray(batch.column("n")) * n_docs) // n_terms
        given = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        sums = np.zeros((plan.n_classes + len(plan.nodes), batch.num_rows), dtype=np.int64)
        np.add.at(sums, (plan.term_class[term], doc), given)
        for k, (x, y) in enumerate(plan.nodes):
            np.add(sums[x], sums[y], out=sums[plan.n_classes + k])
        return sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = kept.value[0]
        floor = np.ones(len(plan.items), dtype=np.int64)  # what a score must reach to be among the best so far
        best, waiting, rows = schema.empty_table(), [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sums = accumulators(batch)
                for i, own in enumerate(plan.items):
                    score = sums[own].sum(axis=0)
                    hit = np.flatnonzero(score >= floor[i])
                    if len(hit):
                        waiting.append(pa.Table.from_arrays([pa.array(np.full(len(hit), i, dtype=np.int32)), batch.column("id").take(pa.array(hit)), pa.array(score[hit])], schema=schema))
                        rows += len(hit)
                if rows > 2 * top * len(plan.items):
                    best, waiting, rows = _best(pa.concat_tables([best, *waiting]), top), [], 0
                    item, score = np.asarray(best.column("item")), np.asarray(best.column("score"))
                    last = np.searchsorted(item, np.arange(len(plan.items)), side="right")
                    full = np.bincount(item, minlength=len(plan.items)) >= top
                    floor[full] = score[last[full] - 1]
        yield from _best(pa.concat_tables([best, *waiting]), top).combine_chunks().to_batches()
        release()

    return found.mapInArrow(run, f"item int, id {dict(found.dtypes)['id']}, score long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, shared: int = SHARED, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item by the ranking of the module's contract."""
    spark = docs.sparkSession
    item_type, doc_type = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    for block in item_blocks(items, item_id, item_text, block_terms):
        vocabulary = np.unique(np.concatenate([own for _, own in block]))
        found = materialize(_found(docs, doc_id, text, vocabulary), "item-terms")
        totals = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not totals.docs:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # at most a row a term of the block
            df[r.term] = r["count"]
        plan = share([np.searchsorted(vocabulary, own) for _, own in block], len(vocabulary), shared)
        scored = _scored(found, plan, weights(totals.docs, df), totals.docs, totals.terms, top)
        ids = spark.createDataFrame([(i, own) for i, (own, _) in enumerate(block)], f"item int, item_id {item_type}")
        order = [F.desc("score"), F.asc_nulls_first("id")]
        some = scored.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        out = out.unionByName(best.join(F.broadcast(ids), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    return out
