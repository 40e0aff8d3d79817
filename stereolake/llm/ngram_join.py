"""N-gram Jaccard join: which texts share at least 3/4 of their 5-word shingles, found by token-combination prefixes.

Order the shingles of every text the same way: rare ones by hash, then frequent ones by hash. Two texts that link differ
in at most tau = n - ceil(0.75 n) shingles of either, so a prefix holding more than tau "chances" has a chance in common.
A rare shingle is a chance of its own. A frequent one alone would bring together too many texts: frequent shingles are
classed by ranges of their hash, and a class of c shingles in the prefix gives c - 1 chances, as two shared ones of a
class are a shared pair. So the prefix is extended by one shingle a class, and pairs are indexed, not single shingles.

What shares a signature is compared with a pivot of the signature's texts first; texts that have become connected need no
comparison any more. After some rounds all pairs across components that are left are compared. A parity bitmap of the
shingles gives an upper bound of the overlap that spares most texts the exact check on whole shingle sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, ByteHasher, materialize, mix, release, salted_join, slices, small_batches, word_spans
from .components import components

WORDS, NUM, DEN = 5, 75, 100
COUNTERS, PLACES, CHUNK, FAN_IN = 1 << 23, 1 << 21, 1 << 16, 64
PER_CLASS, ROUNDS, PIVOTS, SMALL, SEEN = 4, 1, 4, 10, 50_000
#: The members of a component of more than LARGE, and the texts that meet it, are dealt out over so many tasks each.
LARGE, MEMBER_SALTS, OUTSIDE_SALTS = 256, 8, 4
_HASHER: list[ByteHasher] = []
_MIXERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 3, 5, 7, 9)]


def shingle_sets(batch: pa.RecordBatch, column: str = "text") -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text, words A-Z lower-cased; texts of fewer words are one shingle."""
    if not _HASHER:
        _HASHER.append(ByteHasher(53))
    texts = [t.encode() if t else b"" for t in batch.column(column).to_pylist()]
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    stops = np.cumsum(lengths)
    start, stop = word_spans(data)
    words = _HASHER[0].spans(_HASHER[0].sums(data), start, stop)
    firsts = np.searchsorted(start, stops - lengths)
    lasts = np.searchsorted(start, stops)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
        for k in range(WORDS):
            rolled += words[k : k + len(rolled)] * _MIXERS[k]
        rolled = mix(rolled)
        out = []
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix((words[a:b] * np.array(_MIXERS[: b - a])).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(h: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    with np.errstate(over="ignore"):
        total = mix(h + np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(h)) * _MIXERS[3]
        return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def parity_bitmap(h: np.ndarray, most: int = 16) -> np.ndarray:
    """Parity of the number of shingles by place, as 64-bit words; 2 to 4 places a shingle, 2^most at most. The places in
    which two texts differ are at most the shingles in which they differ."""
    size = 1 << min(max(int(len(h) * 2 - 1).bit_length(), 6), most)
    places = (np.bincount((h >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8)
    return np.packbits(places, bitorder="little").view(np.int64)


def may_link(x: Column, n: Column, y: Column, m: Column) -> Column:
    """Whether sizes and bitmaps allow a link: overlap is at most (n + m - differing places) / 2; a larger bitmap is folded.

    Plain expressions, so that a join can drop pairs before they become rows.
    """
    fold = lambda w: F.zip_with(F.slice(w, 1, F.size(w) / 2), F.slice(w, F.size(w) / 2 + 1, F.size(w) / 2), lambda p, q: p.bitwiseXOR(q))
    differ = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    places = F.when(F.size(x) == F.size(y), differ(x, y)).when(F.size(x) > F.size(y), differ(fold(x), y)).otherwise(differ(x, fold(y)))
    bound = F.floor((n + m - places) / 2)
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (DEN * bound >= NUM * (n + m - bound))


def linked(overlap: int, n: int, m: int) -> bool:
    return DEN * overlap >= NUM * (n + m - overlap)


def size_levels(limit: int = 1 << 40) -> np.ndarray:
    """Least sizes of the levels: texts that link are of the same level or of neighbouring ones."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-out[-1] * DEN // NUM)))
    return np.array(out)


LEVELS = size_levels()


def signatures(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a sorted shingle set; frequent says which of its shingles are."""
    n = len(h)
    chances = n // 4 + 1  # tau + 1
    rare = h[~frequent]
    if len(rare) >= chances:
        return rare[:chances]
    out = [rare]
    often = h[frequent]
    need = chances - len(rare)
    level = int(np.searchsorted(LEVELS, n, side="right")) - 1
    for lv in (level, level + 1):
        classes = max(1, int(LEVELS[lv]) // PER_CLASS)
        own = ((often >> np.uint64(32)) * np.uint64(classes)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(first, len(own)))
        enough = int(np.searchsorted(np.cumsum(sizes - 1), need)) + 1
        with np.errstate(over="ignore"):
            for a, s in zip(first[:enough].tolist(), sizes[:enough].tolist()):
                i, j = np.triu_indices(s, 1)
                out.append(mix(often[a + i] * _MIXERS[1] + often[a + j] * _MIXERS[2] + np.uint64(lv + 1)))
    return np.unique(np.concatenate(out))


def _scan(docs: DataFrame) -> DataFrame:
    """Rows of texts (id, n, node, bitmap, small) and, at the end of each task, of its shingle counters by chunk."""

    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part)
                every = np.concatenate(sets) & np.uint64(COUNTERS - 1)
                np.add.at(counts, every, 1)
                rows = len(sets)
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([parity_bitmap(s) for s in sets], words), pa.array([parity_bitmap(s, SMALL) for s in sets], words), none, none, pa.nulls(rows, pa.binary())], names)
        pid = TaskContext.get().partitionId()
        blobs = [zlib.compress(counts[i : i + CHUNK].tobytes(), 1) for i in range(0, COUNTERS, CHUNK)]
        del counts
        release()
        k = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, words), pa.nulls(k, words), pa.array(range(k), pa.int64()), pa.array([pid] * k, pa.int64()), pa.array(blobs, pa.binary())], names)

    names, words = ["id", "n", "node", "bitmap", "small", "chunk", "part", "counts"], pa.list_(pa.int64())
    id_type = to_arrow_type(docs.schema["id"].dataType)
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n bigint, node bigint, bitmap array<bigint>, small array<bigint>, chunk bigint, part bigint, counts binary")


def frequent_places(scanned: DataFrame) -> np.ndarray:
    """Which counters stand out: bits of a table of fixed size. Counters are summed FAN_IN at a time, level by level."""
    blobs = scanned.where("chunk IS NOT NULL").select("chunk", "part", "counts")
    top = blobs.agg(F.max("part")).head()[0]
    parts = (top if top is not None else 0) + 1

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.uint64)
        for b in table.column("counts"):
            total += np.frombuffer(zlib.decompress(b.as_py()), dtype=np.uint32)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    while True:
        blobs = blobs.groupBy("chunk", F.expr(f"part div {FAN_IN}").alias("g")).applyInArrow(add, "chunk bigint, part bigint, counts binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    total = scanned.agg(F.sum("n")).head()[0] or 0
    mean = total / COUNTERS
    least = mean + 4 * mean**0.5 + 4  # beyond what the shingles that share a counter make up by chance

    def mark(batches):
        for batch in batches:
            for chunk, b in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                flags = np.packbits(np.frombuffer(zlib.decompress(b), dtype=np.uint32) > least, bitorder="little")
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([flags.tobytes()], pa.binary())], ["chunk", "flags"])

    rows = {r["chunk"]: r["flags"] for r in blobs.mapInArrow(mark, "chunk bigint, flags binary").collect()}  # COUNTERS bits
    return np.frombuffer(b"".join(bytes(rows.get(i, bytes(CHUNK // 8))) for i in range(COUNTERS // CHUNK)), dtype=np.uint8)


def _bit(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (flags[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _index(docs: DataFrame, flags: np.ndarray) -> DataFrame:
    """(sig, node) of every text."""
    table = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        seen: set[int] = set()  # of copies within a task one is enough
        for batch in batches:
            for part in slices(batch, "text"):
                sigs, nodes = [], []
                for h in shingle_sets(part):
                    node = set_id(h)
                    if len(h) > 1 and node not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        s = signatures(h, _bit(table.value, (h & np.uint64(COUNTERS - 1)).astype(np.int64)))
                        sigs.append(s)
                        nodes.append(np.full(len(s), node, dtype=np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], ["sig", "node"])
        release()

    return docs.mapInArrow(run, "sig bigint, node bigint")


def _wanted_places(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the places of the given nodes."""
    place = F.col("node").bitwiseAND(F.lit(PLACES - 1))
    rows = nodes.groupBy(F.shiftright(place, 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(node & 31 as int)))").alias("bits")).collect()
    words = np.zeros(PLACES // 32, dtype="<u4")
    for r in rows:
        words[r["word"]] = r["bits"]
    return words.view(np.uint8)


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes (and a few others), read from the texts again, so that no text is shuffled."""
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted_places(nodes))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, blobs = [], []
                for h in shingle_sets(part):
                    node = set_id(h)
                    if len(h) > 1 and node not in seen and _bit(wanted.value, np.array([node & (PLACES - 1)]))[0]:
                        if len(seen) < SEEN:
                            seen.add(node)
                        ids.append(node)
                        blobs.append(h.tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])
        release()

    return docs.mapInArrow(run, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link."""
    na = nodes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("bitmap").alias("x"))
    nb = nodes.select(F.col("node").alias("b_node"), F.col("n").alias("m"), F.col("bitmap").alias("y"))
    met = pairs.join(na, "a")
    return met.join(nb, (met["b"] == nb["b_node"]) & may_link(F.col("x"), F.col("n"), F.col("y"), F.col("m"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose shingle sets link."""
    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    joined = salted_join(salted_join(pairs, one, "b", "a", 16), two, "a", "b", 16)  # a pivot may be in many pairs

    def run(batches):
        for batch in batches:  # of bounded bytes
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                keep.append(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links.

    Texts with equal shingle sets are one node. Null, empty and blank texts have no shingles and are their own component.
    Rows with equal ids each get a row; a null id is reachable but never the name of a component unless all are null.
    Empty tables give no rows. Links are exact up to collisions of 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = materialize(_scan(source), "ngram-scan")
    texts = scanned.where("chunk IS NULL")
    nodes = materialize(texts.where("n > 1").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bitmap", "small")]), "ngram-nodes")
    flags = frequent_places(scanned)
    by_sig = Window.partitionBy("sig")
    members = _index(source, flags).withColumns({"lo": F.min("node").over(by_sig), "hi": F.max("node").over(by_sig)}).where("lo <> hi").select("sig", "node").distinct()
    members = members.join(nodes.select("node", "n"), "node").select("sig", "node", "n", F.col("node").alias("comp"))
    members = materialize(members, "ngram-members")
    tested, links, comps = None, None, None
    for number in range(ROUNDS + 1):
        pairs = _pivot_pairs(members, number) if number < ROUNDS else _pairs_left(members, nodes)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "ngram-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        plausible = materialize(_plausible(pairs, nodes), "ngram-plausible")
        if plausible.isEmpty():
            continue
        # written, as the salted joins read it several times and each time would split all texts again
        sets = materialize(_sets_of(source, plausible.select(F.explode(F.array("a", "b")).alias("node"))), "ngram-sets")
        found = materialize(_verified(plausible, sets), "ngram-links")
        links = found if links is None else links.unionByName(found)
        comps = components(links, comps)
        if number == ROUNDS:
            break
        named = comps.withColumnsRenamed({"node": "c_node", "comp": "c_comp"})
        members = members.join(named, members["node"] == named["c_node"], "left").select("sig", "node", "n", F.coalesce("c_comp", "comp").alias("comp"))
        mixed = members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
        members = members.join(mixed, "sig").select("sig", "node", "n", "comp")
        members = materialize(members, "ngram-members")
        if members.isEmpty():
            break
    return _labelled(texts, comps)


_FITTING = f"{DEN} * least(n, m) >= {NUM} * greatest(n, m)"


def _pivot_pairs(members: DataFrame, number: int) -> DataFrame:
    """(a, b): the nodes of each signature with its pivots, where they are of different components and of fitting size.

    Pivots are the nodes of the smallest hashes, so that a node meets the same few pivots through all its signatures.
    """
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(number * PIVOTS + k)).alias("h"), "node", "comp", "n")) for k in range(PIVOTS)]
    chosen = members.groupBy("sig").agg(F.array_distinct(F.array(*pivots)).alias("pivots"))
    met = members.join(chosen, "sig").select("node", "comp", "n", F.explode("pivots").alias("p"))
    met = met.withColumn("m", F.col("p.n")).where("comp <> p.comp").where(_FITTING)
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _pairs_left(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): all pairs across components that share a signature and are of fitting size, and a few more.

    A signature's largest component is mostly one big group of near copies that the others aren't linked with: each of the
    others meets that component once, however many signatures they share; among the others pairs are found by signature.
    """
    sizes = members.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("count"))
    largest = sizes.groupBy("sig").agg(F.max(F.struct("count", "comp"))["comp"].alias("large"))
    others = materialize(members.join(largest, "sig").where("comp <> large").select("sig", "node", "n", "comp", "large"), "ngram-others")
    fits = may_link(F.col("x"), F.col("n"), F.col("y"), F.col("m"))
    mine = nodes.select("node", F.col("bitmap").alias("x"))
    yours = nodes.select(F.col("node").alias("o_node"), F.col("bitmap").alias("y"))
    # only a large component is dealt out over tasks; elsewhere bitmaps aren't repeated
    wide = lambda salts: F.when(F.col("count") > LARGE, salts).otherwise(1)
    sized = members.select("comp", "node").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("count"))
    sized = sized.select(F.col("comp").alias("met_comp"), wide(MEMBER_SALTS).alias("ms"), wide(OUTSIDE_SALTS).alias("os"))
    met = others.select(F.col("large").alias("met_comp")).distinct().join(sized, "met_comp")
    inside = members.select(F.col("comp").alias("o_comp"), F.col("node").alias("o_node"), F.col("n").alias("m")).distinct()
    inside = inside.join(met, F.col("o_comp") == F.col("met_comp")).join(yours, "o_node")
    inside = inside.select("o_comp", "o_node", "m", "y", F.pmod(F.xxhash64("o_node"), F.col("ms")).alias("o_salt"), F.explode(F.sequence(F.lit(0), F.col("os") - 1)).alias("i_salt"))
    outside = others.select("node", "n", "large").distinct().join(met, F.col("large") == F.col("met_comp")).join(mine, "node")
    outside = outside.select("node", "n", "large", "x", F.pmod(F.xxhash64("node"), F.col("os")).alias("salt"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("m_salt"))
    across = outside.join(inside, (F.col("large") == F.col("o_comp")) & (F.col("salt") == F.col("i_salt")) & (F.col("m_salt") == F.col("o_salt")) & fits)
    mine = nodes.select("node", F.col("small").alias("x"))
    first = others.select("sig", "node", "n", "comp").join(mine, "node")
    second = first.select(F.col("sig").alias("o_sig"), F.col("node").alias("o_node"), F.col("n").alias("m"), F.col("comp").alias("o_comp"), F.col("x").alias("y"))
    among = first.join(second, (F.col("sig") == F.col("o_sig")) & (F.col("node") < F.col("o_node")) & (F.col("comp") != F.col("o_comp")) & fits)
    both = across.select("node", "o_node").unionByName(among.select("node", "o_node"))
    return both.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def _labelled(texts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows with the smallest id of their component; nodes first, so that a node of many copies is one row in the join."""
    by_node = texts.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    if comps is None:
        by_node = by_node.withColumnRenamed("least", "component_id")
    else:
        inside = by_node.join(comps, "node")
        smallest = inside.groupBy("comp").agg(F.min("least").alias("smallest"))
        named = salted_join(inside.select("node", "comp"), smallest, "comp", "node").select("node", "smallest")
        by_node = by_node.join(named, "node", "left").select("node", F.coalesce("smallest", "least").alias("component_id"))
    rows = texts.select("id", F.col("n").alias("n_shingles"), "node")
    named = salted_join(rows.where("n_shingles > 0"), by_node, "node", "id")  # copies are rows of one node
    alone = rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return named.select("id", "n_shingles", "component_id").unionByName(alone)
