"""Merkle manifest, resharding and lexical search against brute force, and on odd inputs."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolake.llm import lexical, merkle, queries, reshard

from .test_operators import ODD, SCHEMA, documents, odd_docs


def key(v):
    return (v is not None, v if v is not None else 0)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(nodes, run):
    """All levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + run]) for i in range(0, len(last), run)])
    return levels


def climb(levels, at, run):
    """(before, after) of each level from a leaf on."""
    for nodes in levels[:-1]:
        base = at // run * run
        own = nodes[base : base + run]
        yield "".join(own[: at - base]), "".join(own[at - base + 1 :])
        at //= run


def manifest_by_hand(rows, run=3):
    def leaves(r, text):
        return leaf_by_hand(r.doc_id, r.source, r.lang, r.n_chars, text)

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r.source].append((key(r.doc_id), leaves(r, r.text), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in names:
        trees[s].sort(key=lambda x: x[:2])
        grown[s] = grow([x[1] for x in trees[s]], run)
    crown = grow([grown[s][-1][0] for s in names], run)
    out = []
    for k, s in enumerate(names):
        for at, (_, leaf, r) in enumerate(trees[s]):
            steps = [*climb(grown[s], at, run), *climb(crown, k, run)]
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            now = leaves(r, r.text.replace("\n", "")) if hit else leaf
            for before, after in steps:
                now = h(before, now, after)
            out.append((r.doc_id, leaf, grown[s][-1][0], crown[-1][0], h(*itertools.chain(*steps)), now, now == crown[-1][0]))
    return collections.Counter(out)


def tampered():
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))


@pytest.mark.parametrize(("run", "levels"), [(3, 1), (2, 3), (3, 5)])
def test_manifest_of_given_and_odd_rows(spark, run, levels):
    docs = documents(spark).unionByName(odd_docs(spark), allowMissingColumns=True).unionByName(odd_docs(spark).where("doc_id = 3"), allowMissingColumns=True)
    got = collections.Counter(tuple(r) for r in merkle.manifest(docs, tampered(), run=run, levels=levels).collect())
    want = manifest_by_hand(docs.collect(), run)
    assert got == want
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 4, 10])
def test_manifest_of_small_tables(spark, n):
    docs = spark.createDataFrame([(i, f"a\nb{i}", "en", "s", 1) for i in range(n)], SCHEMA)
    got = collections.Counter(tuple(r) for r in merkle.manifest(docs, tampered(), levels=1).collect())
    assert got == (manifest_by_hand(docs.collect()) if n else collections.Counter())


def test_manifest_of_many_sources_and_a_long_text(spark):
    docs = spark.createDataFrame([(i, "x\n" * 2_500_000 if i == 4 else None, None, f"s{i % 17}" if i % 5 else None, None) for i in range(60)], SCHEMA)
    got = collections.Counter(tuple(r) for r in merkle.manifest(docs, tampered(), levels=1).collect())
    assert got == manifest_by_hand(docs.collect())


def test_places_are_those_of_a_sort(spark):
    rows = [(random.Random(i).choice([None, "a", "b", "b", "b"]), i % 7 or None) for i in range(200)]
    found = merkle.numbered(merkle.materialize(spark.createDataFrame(rows, "g string, v int"), "test"), "g", F.asc_nulls_first("v"), name="test", ranked=True).collect()
    for g, n in collections.Counter(g for g, _ in rows).items():
        own = sorted((r for r in found if r.g == g), key=lambda r: r["at"])
        assert [r["at"] for r in own] == list(range(n)) and {r.n for r in own} == {n} and {r.n_groups for r in own} == {3}
        assert [r.v for r in own] == sorted((r.v for r in own), key=key)
        assert {r.group_at for r in own} == {[None, "a", "b"].index(g)}


# ---------------------------------------------------------------- resharding


def cheapest(supply, capacity, price):
    """The least total price by trying all ways, unit by unit."""
    best, olds = math.inf, [i for i, n in supply.items() for _ in range(n)]
    for to in itertools.product(capacity, repeat=len(olds)):
        count = collections.Counter(to)
        if all(count[j] <= capacity[j] for j in capacity):
            best = min(best, sum(price.get((i, j), int(i != j)) for i, j in zip(olds, to)))
    return best


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        supply = {i: rng.randrange(3) for i in range(3)}
        capacity = {j: rng.randrange(1, 4) for j in (0, 1, 5)}
        price = {(i, j): rng.randrange(6) for i in supply for j in capacity} if rng.random() < 0.7 else {}
        if sum(capacity.values()) < sum(supply.values()):
            with pytest.raises(ValueError):
                reshard.min_cost_flow(supply, capacity, price)
            continue
        flow = reshard.min_cost_flow(supply, capacity, price)
        for i in supply:
            assert sum(n for (a, _), n in flow.items() if a == i) == supply[i]
        for j in capacity:
            assert sum(n for (_, b), n in flow.items() if b == j) <= capacity[j]
        assert sum(n * price.get(arc, int(arc[0] != arc[1])) for arc, n in flow.items()) == cheapest(supply, capacity, price)


def test_flow_of_many_shards_moves_what_must_go():
    rng = random.Random(4)
    supply = {i: rng.randrange(10**12) for i in range(60)}
    total = sum(supply.values())
    capacity = {j: total // 80 + (j < total % 80) for j in range(80)}
    flow = reshard.min_cost_flow(supply, capacity)
    assert sum(flow.values()) == total
    assert sum(n for (i, j), n in flow.items() if i != j) == sum(max(0, n - capacity[i]) for i, n in supply.items())


def test_resharded_files(spark):
    docs = documents(spark).repartition(12, "doc_id").unionByName(odd_docs(spark), allowMissingColumns=True).unionByName(odd_docs(spark), allowMissingColumns=True)
    docs = docs.withColumns({"shard": F.lit("theirs"), "file": F.lit(3), "doc": F.lit(1.5)})
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    layout = reshard.write_layout(docs, F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(5)), size)
    before = reshard.shard_sizes(layout)
    capacity = reshard.even_capacities(layout, 7)
    after = reshard.reshard(layout, capacity)
    rows = after.rows().collect()
    assert collections.Counter(tuple(r.doc) for r in rows) == collections.Counter(tuple(r) for r in docs.collect())
    assert len({r.row for r in rows}) == len(rows)
    sizes = reshard.shard_sizes(after)
    longest = max(r.size for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= longest
    moved = sum(r.size for r in rows if r.shard != r.old)
    least = sum(max(0, n - capacity.get(i, 0)) for i, n in before.items())
    assert abs(moved - least) <= 12 * longest
    # only blocks at an arc's end are cut, and every cut is inside its block
    flow = reshard.min_cost_flow(before, capacity)
    plan = reshard.plan_blocks(layout, flow, {}).collect()
    assert sum(len(r.moves) > 1 for r in plan) <= len(flow) - len(before) < len(plan)
    assert all(m.bytes > 0 for r in plan for m in r.moves) and sum(m.bytes for r in plan for m in r.moves) == sum(before.values())
    # a file that the plan leaves where it is isn't written again
    kept = {r.file for r in rows} & {r.file for r in layout.rows().select("file").distinct().collect()}
    assert kept and all(r.shard == r.old for r in rows if r.file in kept)
    assert all(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in kept)
    # a second change of capacities reads old and new files
    fewer = reshard.reshard(after, reshard.even_capacities(after, 3))
    again = fewer.rows().collect()
    assert collections.Counter(tuple(r.doc) for r in again) == collections.Counter(tuple(r.doc) for r in rows)
    assert {r.shard for r in again} == {0, 1, 2}


def test_resharding_moves_nothing_where_all_fits(spark):
    layout = reshard.write_layout(documents(spark), F.col("doc_id") % 3, F.octet_length("text"))
    after = reshard.reshard(layout, dict.fromkeys(range(4), 10**9))
    assert {r.file for r in after.rows().select("file").collect()} == {r.file for r in layout.rows().select("file").collect()}


def test_resharding_of_nothing_and_of_rows_without_size(spark):
    none = reshard.write_layout(documents(spark).limit(0), F.lit(0), F.lit(1))
    assert reshard.reshard(none, reshard.even_capacities(none, 4)).rows().count() == 0
    bare = reshard.write_layout(odd_docs(spark), F.lit(9), F.lit(None).cast("long"))
    rows = reshard.reshard(bare, reshard.even_capacities(bare, 2)).rows().collect()
    assert len(rows) == odd_docs(spark).count() and {r.shard for r in rows} == {0}


def test_op12(spark, tmp_path):
    docs = documents(spark).repartition(6).unionByName(odd_docs(spark), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_reshard(spark, str(tmp_path)).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(8))
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    again = queries.op12_reshard(spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, rows))


# ---------------------------------------------------------------- lexical search


def terms_of(text):
    return re.findall(lexical.TERM, re.sub(r"[A-Z]", lambda m: m.group().lower(), text or ""))


def search_by_hand(docs, items, top):
    counts = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0:
                found.append((-score, key(d), d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found)[:top])]
    return collections.Counter(out)


@pytest.mark.parametrize(("block_terms", "shared", "top"), [(1 << 16, 3, 50), (60, 2, 7), (1 << 16, 10**6, 3)])
def test_search_of_given_and_odd_rows(spark, block_terms, shared, top):
    docs = documents(spark).select("doc_id", "text").unionByName(odd_docs(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text")).unionByName(documents(spark).where("doc_id % 9 = 0").select("doc_id", "text"))
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    odd = [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "word é日 the"), (103, "a"), (7, "the of and")]
    items = items.unionByName(spark.createDataFrame(odd, "item_id long, text string")).unionByName(items.limit(2))
    got = collections.Counter(map(tuple, lexical.search(docs, items, block_terms=block_terms, shared=shared, top=top).collect()))
    assert got == search_by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], top)


def test_search_without_documents_or_items(spark):
    docs, items = documents(spark).select("doc_id", "text"), spark.createDataFrame([(1, "the"), (2, None), (3, "..")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.where("item_id > 1")).count() == 0
    long = spark.createDataFrame([("b", "zebra " * 400_000), ("a", "ZEBRA lion")], "doc_id string, text string")
    assert [(r.doc_id, r["rank"]) for r in lexical.search(long, spark.createDataFrame([(1, "zebra lion")], "item_id long, text string")).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_sharing_keeps_every_item_and_saves_sums():
    rng = random.Random(5)
    for n_terms, n_items in ((1, 1), (12, 5), (40, 30), (9, 60)):
        common = [rng.sample(range(n_terms), min(n_terms, 4)) for _ in range(3)]
        items = [np.unique(rng.choice(common) + rng.choice(common) + [rng.randrange(n_terms)]) for _ in range(n_items)]
        plan = lexical.share(items, n_terms, 2)
        value = np.array([rng.randrange(1000) for _ in range(n_terms)])
        sums = np.concatenate([np.bincount(plan.term_class, value, plan.n_classes), np.zeros(len(plan.nodes))])
        for k, (a, b) in enumerate(plan.nodes):
            sums[plan.n_classes + k] = sums[a] + sums[b]
        assert [sums[own].sum() for own in plan.items] == [value[own].sum() for own in items]
        assert plan.sums() <= sum(len(own) - 1 for own in items)
    assert lexical.share([np.array([0, 1, 2, 3])] * 5 + [np.array([2, 3, 4])] * 4, 5, 3).sums() < 10
