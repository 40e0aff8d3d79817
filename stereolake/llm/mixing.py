"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then a seeded block selection.

The corpus is dealt into shards of about `shard_words` words by a seeded hash of the document. In every shard each source
has a line of words (its documents in seeded order) cut into blocks of `block_words`. The shard's blocks are apportioned
to its sources by the highest quotients votes / (2 * seats + 1), where a source's votes are its target times the part of
the source that lies in the shard. A quota takes whole rounds of the line first and then a run of blocks that starts at a
seeded block and wraps around, so what a document gives follows from its place on the line; no block becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, size): weights repeat over the sources by code point, null last.

    The budget (a multiple of all sizes) is shared by weight; a target stops at cap times its source's size and the excess
    goes to the others by weight. Sources sorted by size / weight fill up in that order, so a running sum finds the level
    at which the rest share. The windows run over one row per source, not over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    limit = F.col("source_size") * F.lit(cap)
    fill = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = weighed.withColumn("open", F.when(limit / F.col("weight") >= level, level))
    level = F.first("open", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("target", F.least(limit, F.coalesce(level * F.col("weight"), limit))).select("source", "source_size", "target")


def apportion(votes: DataFrame, group: str, name: str, block: int) -> DataFrame:
    """(group, name, quota) of (group, name, votes): round(sum of votes / block) seats a group, by Sainte-Lague.

    With divisor `block`, rounding gives each name nearly its seats; the rest of the seats (or the surplus) goes by the
    highest (lowest) quotients among the next (last) few seats of each name. How many can matter to a name is bounded by
    its share of the votes, so the candidates are linear in the names of a group. Ties go to the first name.
    """
    whole = Window.partitionBy(group)
    shares = votes.withColumn("start", F.greatest(F.ceil(F.col("votes") / block - 0.5), F.lit(0)).cast("long"))
    shares = shares.withColumn("all", F.sum("votes").over(whole)).withColumn("names", F.count(F.lit(1)).over(whole))
    shares = shares.withColumn("missing", F.round(F.col("all") / block).cast("long") - F.sum("start").over(whole))
    reach = F.ceil((F.abs("missing") + F.col("names")) * F.coalesce(F.try_divide("votes", "all"), F.lit(0.0))).cast("long") + 2
    more = F.sequence(F.col("start"), F.col("start") + reach)
    fewer = F.sequence(F.greatest(F.col("start") - reach, F.lit(0)), F.col("start") - 1)
    none = F.array().cast("array<bigint>")
    seats = F.when(F.col("missing") > 0, more).when((F.col("missing") < 0) & (F.col("start") > 0), fewer).otherwise(none)
    seats = shares.withColumn("seat", F.explode_outer(seats)).withColumn("quotient", F.col("votes") / (2 * F.col("seat") + 1))
    ties = [F.col(name).isNull(), F.col(name), F.col("seat")]
    up = F.row_number().over(whole.orderBy(F.col("quotient").desc_nulls_last(), *ties))
    down = F.row_number().over(whole.orderBy(F.col("quotient").asc_nulls_last(), *[t.desc() for t in ties]))
    chosen = F.col("seat").isNotNull() & (F.when(F.col("missing") > 0, F.col("up")).otherwise(F.col("down")) <= F.abs("missing"))
    picked = seats.withColumn("up", up).withColumn("down", down)
    return picked.groupBy(group, name).agg((F.first("start") + F.sum(F.when(chosen, F.signum("missing").cast("long")).otherwise(0))).alias("quota"))


def taken_ranges(start: Column, size: Column, line: Column, quota: Column, first: Column, block: int) -> Column:
    """Word ranges {begin, end} that the document at [start, start + size) on a line of `line` words gives, for `quota` blocks from block `first` on.

    They count from the document's first word: [0, size) for each whole round, then what the wrapped head and the run
    from the first block take of it. These two never meet, as a part of a round leaves a block out.
    """
    blocks = F.ceil(line / block).cast("long")
    rounds = F.coalesce(F.floor(F.try_divide(quota, blocks)), F.lit(0)).cast("long")
    rest = F.coalesce(quota, F.lit(0)) - rounds * blocks

    def overlap(a: Column, b: Column) -> Column:
        begin, end = F.greatest(start, a) - start, F.least(start + size, F.least(b, line)) - start
        return F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))

    whole = F.struct(F.lit(0).cast("long").alias("begin"), size.cast("long").alias("end"))
    wrapped = F.greatest(first + rest - blocks, F.lit(0)) * block
    parts = F.array(overlap(F.lit(0), wrapped), overlap(first * block, (first + rest) * block))
    return F.filter(F.concat(F.array_repeat(whole, rounds.cast("int")), parts), lambda p: p["begin"] < p["end"])


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, block_words: int = 8, shard_words: int = 100_000, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source, source_size, target, taken, ranges, shard, quota) for every row: how many of its words the mix takes, and which.

    Size counts maximal runs of non-space bytes (null and empty texts: 0, they give nothing). A null source is a source of
    its own. Rows with equal ids stay apart; equal ones among them are tied and get their places in any order, with the
    same sums. An empty table gives no rows. Only ids, sizes and sources are shuffled, and the shards grow in number with
    the corpus, so a source with a third of all rows is spread over all of them. Reruns give the same result.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("at"), *carry)
    sized = materialize(sized, "mix-sizes")
    targets = source_targets(sized.select("source", "size"))
    shards = -(-(sized.agg(F.sum("size")).head()[0] or 1) // shard_words)
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "at"), F.lit(max(shards, 1))))
    lines = dealt.groupBy("shard", "source").agg(F.sum("size").alias("line"))
    lines = lines.join(targets, lines["source"].eqNullSafe(targets["source"])).select("shard", lines["source"], "line", "source_size", "target")
    lines = materialize(lines, "mix-lines")
    votes = lines.withColumn("votes", F.coalesce(F.try_divide(F.col("target") * F.col("line"), F.col("source_size")), F.lit(0.0)))
    quotas = apportion(votes.select("shard", "source", "votes"), "shard", "source", block_words).withColumnsRenamed({"shard": "q_shard", "source": "q_source"})
    lines = lines.join(quotas, (lines["shard"] == quotas["q_shard"]) & lines["source"].eqNullSafe(quotas["q_source"])).select(
        F.col("shard").alias("l_shard"), F.col("source").alias("l_source"), "line", "source_size", "target", F.least("quota", 2 * F.ceil(F.col("line") / block_words)).cast("long").alias("quota")
    )
    order = Window.partitionBy("shard", "source").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = placed.join(lines, (placed["shard"] == lines["l_shard"]) & placed["source"].eqNullSafe(lines["l_source"]))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "shard", "source"), F.greatest(F.ceil(F.col("line") / block_words).cast("long"), F.lit(1)))
    ranges = taken_ranges(F.col("start"), F.col("size"), F.col("line"), F.col("quota"), first, block_words)
    taken = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["begin"])
    return joined.withColumn("ranges", ranges).select("id", "size", "source", "source_size", "target", taken.alias("taken"), "ranges", "shard", "quota", *carry)
