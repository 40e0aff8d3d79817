"""The ten operators against brute force, exact round trips or held-out labels, and on odd inputs."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stereolake.llm import bpe, components, fingerprint, flac, line_dedup, mixing, ngram_join, pii, queries, toxicity, url_rules, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "é日🎉 <|endoftext|>\x00\x1c", "x" * 3000, "word " * 2000, "one two three four five six\n" * 3, "one two three four five six\n" * 3]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, schema=SCHEMA):
    rows = [(i, t, "en", [None, "b", "a"][i % 3], len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "no id", "en", "b", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for c in ("id", "row", "text_", "size", "node", "batch"):
        docs = docs.withColumn(c, F.lit(1))
    return docs


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(spark, tokenizer):
    docs = documents(spark).select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    path = queries.tokenizer_path()
    got = collections.Counter((r.id, bytes(r.ids), r.text) for r in bpe.decode(bpe.encode(docs, "doc_id", "text", path), path).collect())
    want = collections.Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, np.array(ids, dtype="<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_bpe_long_texts_are_cut_where_words_start(tokenizer):
    codec = bpe.TrieCodec(queries.tokenizer_path())
    rng = random.Random(1)
    text = "".join(rng.choice([" the", "\n\n", "  ", " 123", "'s", " é", "!?", "ab"]) for _ in range(20_000))
    old, bpe.PIECE = bpe.PIECE, 500
    try:
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        bpe.PIECE = old


def test_flac_round_trip_and_format(spark):
    docs = odd_docs(spark).select("doc_id", "text", flac.padded_payload(F.col("text")).alias("payload"))
    rows = flac.decode(flac.encode(docs, "doc_id", "payload"))
    want = collections.Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        want[r.doc_id, data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))] += 1
    assert collections.Counter((r.id, bytes(r.pcm)) for r in rows.collect()) == want
    blocks = flac.pcm_blocks(rows.where("id = 6")).orderBy("sample_offset").collect()
    assert [b.sample_offset for b in blocks] == [flac.BLOCK * i for i in range(len(blocks))] and b"".join(bytes(b.pcm) for b in blocks).startswith(b"word word")


@pytest.mark.parametrize("size", [64, 1000, 1024, 1025, 5000])
def test_flac_payloads(size):
    rng = np.random.default_rng(size)
    payloads = [rng.integers(0, 256, size, dtype=np.uint8).tobytes(), bytes(size), bytes(range(256)) * (size // 256 + 1), (np.sin(np.arange(size) / 9) * 100 + 128).astype(np.uint8).tobytes()]
    assert [d for d, _ in flac.decode_streams(flac.encode_streams(payloads))] == payloads


def test_flac_damage_is_found():
    stream = bytearray(flac.encode_streams([b"some text " * 500])[0])
    stream[len(stream) // 2] ^= 1
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(stream)])


def test_flac_partitions_are_read():
    """A hand-made frame: fixed order 1, partition order 1, parameters 0 and 1, residuals 0 | 1 -2."""
    bits = "00010010" + "00000101" + "00" + "0001" + "0000" + "1" + "0001" + "010" + "011"
    data = np.packbits([int(b) for b in bits.ljust(-(-len(bits) // 8) * 8, "0")])
    samples, _ = flac.decode_frames(data, np.array([0]), np.array([4]))
    assert samples[0].tolist() == [5, 5, 6, 4]


def test_flac_text_that_holds_a_frame_header():
    """Bytes in a frame's samples that look like the header of the next one, alone and among other streams."""
    rng = random.Random(12)
    noise = lambda n: "".join(chr(rng.choice([rng.randint(33, 126), rng.randint(0x80, 0x7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(n)).encode()
    header = bytes([0xFF, 0xF8, 0x71, 2, 1, 0, 160])
    header = bytes(b ^ 0x80 for b in header + bytes([flac.crc8(header)]))
    text = noise(150) + header + noise(1200)
    text += bytes(-len(text) % 64)
    plain = b"plain text " * 640
    streams = flac.encode_streams([plain, text, plain])
    assert streams[1].find(bytes(b ^ 0x80 for b in header)) > 0
    assert [d for d, _ in flac.decode_streams(streams)] == [plain, text, plain]
    torn = bytearray(streams[1])
    torn[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([plain and streams[0], bytes(torn)])


def test_warc_round_trip(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdé \r\n") for _ in range(60_000))
    rows = [(1, "http://a/x", "same"), (2, "http://a/y", "same"), (3, None, None), (4, "http://a/z", ""), (5, "u\nv", long), (6, "w", long), (7, "b", "x"), (7, "b", "x"), (None, "c", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit(1))
    records = warc.read_archives(warc.write_archives(pages))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in warc.resolve_revisits(records).collect())
    owner = {}
    for p, _, h in rows:
        if p is not None:
            owner[h or ""] = max(owner.get(h or "", p), p)
    want = collections.Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        first = p is None or owner[h or ""] == p
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else owner[h or ""]] += 1
    assert got == want
    assert sorted(bytes(r.payload) for r in records.where("kind = 'response' AND page_id = 6").collect()) == [long.encode()]


def test_warc_lost_segment_is_an_error(spark):
    parts = list(warc.write_page(1, "u", b"x" * 50_000, None, 0))
    assert len(parts) > 3
    whole = spark.createDataFrame([(0, 0, bytearray(b"".join(parts[::-1])))], "archive long, piece long, content binary")
    assert bytes(warc.read_archives(whole).head().payload) == b"x" * 50_000
    torn = spark.createDataFrame([(0, 0, bytearray(b"".join(parts[:1] + parts[2:])))], "archive long, piece long, content binary")
    with pytest.raises(Exception, match="segments don't make up"):
        warc.read_archives(torn).collect()


def test_url_rules_on_odd_urls(spark):
    urls = ["https://EXAMPLE.org/en/17?x", "http://notexample.org/en/1", "http://a.example.org", "ftp://x.com/de/", "no scheme", "", None, "http://com/fr/a#b", "http://blog.x.net/a.html", "http://blog.x.net/a.html", "http://a|b.org/x", "http://a|.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    judged = url_rules.filter_urls(pages, url_rules.rules_table(spark, url_rules.HOST_RULES + url_rules.PATTERN_RULES))
    got = {r.id: (r.host, r.path, r.rule) for r in judged.collect()}
    assert got[0] == ("example.org", "/en/17", "example.org/en/1") and got[1][2] == "org/" and got[2] == ("a.example.org", "", None)
    assert got[3][2] == "com/de/" and got[4] == ("", "", None) == got[6] and got[7] == ("com", "/fr/a", "com/fr/") and got[8] == got[9] == ("blog.x.net", "/a.html", "blog-html")
    assert got[10] == ("a|b.org", "/x", "org/") and got[11][2] == "com/de/"


def test_url_rules_equal_all_rules_on_all_urls(spark):
    rng = random.Random(3)
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    urls = ["http://" + ".".join(rng.sample(["m", "blog", "example", "a"], rng.randint(1, 3))) + rng.choice([".org", ".com", ".net"]) + rng.choice(["", "/", "/en/1", "/es/a", "/fr/", "/de/9", "/en/95", "/x.html"]) for _ in range(300)]
    got = {r.id: r.rule for r in url_rules.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_rules.rules_table(spark, rules)).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.split("://")[1].partition("/")
        key = host + ("/" + path if _ else "")
        fits = sorted((-r.rank, r.name) for r in rules if re.search(r.pattern, key))
        assert got[i] == (fits[0][1] if fits else None)


def seats(votes, total):
    got = dict.fromkeys(votes, 0)
    for _ in range(total):
        best = min(votes, key=lambda s: (-votes[s] / (2 * got[s] + 1), s))
        got[best] += 1
    return got


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(40):
        votes = {f"s{i:02}": float(rng.choice([0, 1, 7, 30, 500, 4000]) * rng.random()) for i in range(rng.randint(1, 9))}
        rows += [(k, s, v) for s, v in votes.items()]
        total = int(sum(votes.values()) / 8 + 0.5)
        want |= {(k, s): n for s, n in seats(votes, total).items()}
    got = {(r.g, r.s): r.quota for r in mixing.apportion(spark.createDataFrame(rows, "g long, s string, votes double"), "g", "s", 8).collect()}
    assert got == want


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing_reaches_targets(spark):
    docs = documents(spark).select("doc_id", "text", "source").unionByName(odd_docs(spark).select("doc_id", "text", "source"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes, taken, said = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        said[r.source] = r.target
    want = targets_by_hand(sizes)
    for s in sizes:
        assert said[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(16, 0.01 * want[s])
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.id), str(r.source), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_taken_ranges_are_the_selected_blocks(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        line = rng.randint(1, 90)
        start = rng.randint(0, line - 1)
        blocks = -(-line // 8)
        rows.append((k, start, rng.randint(1, line - start), line, rng.randint(0, 2 * blocks), rng.randint(0, blocks - 1)))
    df = spark.createDataFrame(rows, "k long, start long, size long, line long, quota long, first long")
    got = {r.k: [w for p in r.ranges for w in range(p.begin, p.end)] for r in df.select("k", mixing.taken_ranges(*map(F.col, ("start", "size", "line", "quota", "first")), 8).alias("ranges")).collect()}
    for k, start, size, line, quota, first in rows:
        blocks = -(-line // 8)
        chosen = collections.Counter((first + i) % blocks for i in range(quota))
        want = [w for w in range(size) for _ in range(chosen[(start + w) // 8])]
        assert sorted(got[k]) == want


def test_pipeline_mixing_writes_the_selected_words(spark):
    text = {i: " \t".join(f"{i}w{k}" for k in range(900)) + "\n" for i in range(12)}
    docs = spark.createDataFrame([(i, text[i], "en", "abc"[i % 3], len(text[i])) for i in text], SCHEMA)
    got = collections.defaultdict(list)
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
        got[r.doc_id].append(words(r.text))
    place = F.xxhash64(F.lit(corpus_pipeline.SEED), "doc_id", "source", "text").alias("place")
    rows = mixing.mix(docs.select(place, "doc_id", "source", "text"), "place", seed=corpus_pipeline.SEED, carry=("doc_id",)).collect()
    for r in rows:
        own = words(text[r.doc_id])
        assert sorted(got[r.doc_id]) == sorted(own[p.begin : p.end] for p in r.ranges) and sum(map(len, got[r.doc_id])) == r.taken
    assert any(p.begin for r in rows for p in r.ranges)


def brute_components(texts):
    sets = []
    for t in texts:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return [(len(s), g) for s, g in zip(sets, group)]


def near_copies(seed=5):
    """Copies at all distances, a passage that many texts share, short texts and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for size in (1, 3, 4, 5, 6, 7, 8, 12, 30, 60, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
            if edits == 1:
                texts.append(" ".join(w[:-1]).upper())
    for n in range(50):
        texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(n % 25)]))
    return texts


def test_ngram_join_equals_all_pairs(spark, monkeypatch):
    texts = near_copies() + ODD
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("node", F.lit(1))
    want = {i: w for i, w in enumerate(brute_components(texts))}
    assert {r.id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()} == want
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)  # the exhaustive last stage alone
    assert {r.id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()} == want


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_linked_sets_share_a_signature(spark, share):
    """Whatever shingles are frequent, two sets that link have a signature in common, and the bitmaps don't rule them out."""
    rng = np.random.default_rng(int(share * 10))
    rows = []
    for _ in range(1500):
        n = int(rng.integers(2, 120))
        union = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        n = len(union)
        out = rng.random(n) < rng.random() * 0.26
        side = rng.random(n) < rng.random()
        a, b = union[~(out & side)], union[~(out & ~side)]
        k = len(np.intersect1d(a, b))
        if len(a) < 2 or len(b) < 2 or not ngram_join.linked(k, len(a), len(b)) or len(a) == len(b) == k:
            continue
        often = lambda h: (h % np.uint64(1000)) < np.uint64(int(share * 1000))
        assert len(np.intersect1d(ngram_join.signatures(a, often(a)), ngram_join.signatures(b, often(b))))
        rows.append((ngram_join.parity_bitmap(a).tolist(), len(a), ngram_join.parity_bitmap(b).tolist(), len(b)))
    pairs = spark.createDataFrame(rows, "x array<bigint>, n bigint, y array<bigint>, m bigint")
    assert rows and pairs.where(~ngram_join.may_link(*map(F.col, "xnym"))).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 300: 200, 200: 200}


def common_block_lines(a, b, least):
    """Numbers of b's lines in a block of `least` words or more that a has too: every diagonal of the two texts."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if sum(len(words(x)) for x in b[j : j + k]) >= least:
                    gone |= set(range(j, j + k))
    return gone


@pytest.mark.parametrize("least", [1, 12, 50])
def test_line_dedup_equals_all_pairs(spark, least):
    """300 small texts of passages, moved blocks, repeated lines and copies, against every pair of an earlier and a later one."""
    rng = random.Random(least)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 10, 25, 51]))) for _ in range(120)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    texts = []
    for i in range(300):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(passages)
        texts.append(rng.choice(texts) if texts and rng.random() < 0.1 else lines)
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in line_dedup.dedup_lines(docs, least_words=least).collect()}
    for j, t in enumerate(texts):
        gone = set().union(*(common_block_lines(texts[i], t, least) for i in range(j)), set())
        assert got[j] == "\n".join(x for k, x in enumerate(t) if k not in gone), j


def test_line_dedup_of_a_block_that_outgrows_its_owner(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"{rng.random():.9f}" for _ in range(n)) for n in (51, 10, 10, 25))
    docs = spark.createDataFrame([(0, a), (1, "\n".join([a, b, c, d])), (2, "\n".join([a, b, c, d]))], "doc_id long, text string")
    assert {r.row.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {0: a, 1: "\n".join([b, c, d]), 2: ""}


def test_line_dedup_of_many_lines():
    """50 000 lines in seconds, whether they repeat, stand in the same order or the other way round."""
    size = 50_000
    ten = np.full(size, 10, dtype=np.int32)
    up = np.arange(size, dtype=np.int64)
    blocks = lambda a, b: line_dedup.shared_blocks(a, b, ten)
    began = time.perf_counter()
    assert blocks(up, up) == [(0, size)] == blocks(up * 0, up * 0) and blocks(up, up[::-1].copy()) == []
    assert blocks(up, np.roll(up, size // 2)) == [(0, size)] and blocks(up % 2, (up + 1) % 2) == [(0, size)]
    fives = up.reshape(-1, 5)[::-1].ravel().copy()  # 10 000 blocks of 50 words, each where none stood before
    assert blocks(up, fives) == [(0, size)] and blocks(up[:5], np.tile(up[:5], size // 5)) == [(0, size)]
    assert time.perf_counter() - began < 20


def test_line_dedup_goes_by_alignment():
    """Blocks come from anchors of an alignment: a periodic text shares a run that no copy's own place leads to, and keeps it."""
    p, q = 1, 2
    a = np.array([p, q] * 20 + [p, p, q, q], dtype=np.int64)
    b = np.array([p, p, q, q], dtype=np.int64)
    ten = np.full(len(b), 13, dtype=np.int32)
    assert set(line_dedup.runs(b, ten, 50)[0].tolist()) <= set(line_dedup.runs(a, np.full(len(a), 13, dtype=np.int32), 50)[0].tolist())
    assert line_dedup.shared_blocks(a, b, ten) == []
    # with a line that leads there, the alignment takes the whole block
    a, b = np.append(a, 3), np.append(b, 3)
    assert line_dedup.shared_blocks(a, b, np.full(len(b), 13, dtype=np.int32)) == [(0, 5)]
    # the longest common order wins, what moved is aligned on its own, repeated blocks with any copy
    assert line_dedup._chains([(0, 5), (1, 6), (2, 0), (3, 7), (4, 1)]) == [[(0, 5), (1, 6), (3, 7)], [(2, 0), (4, 1)]]


def test_line_dedup_of_runs_that_many_texts_have(spark, monkeypatch):
    """Rare and common runs take different joins and give the same."""
    docs = documents(spark)
    got = []
    for rare in (0, 2, 64):
        monkeypatch.setattr(line_dedup, "RARE_TEXTS", rare)
        got.append(sorted((r.row.doc_id, r.n_deleted) for r in line_dedup.dedup_lines(docs, least_words=5).collect()))
    assert got[0] == got[1] == got[2] and sum(n for _, n in got[0])


def test_line_dedup_removes_shared_blocks(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, pieces, short = line(60), [line(11) for _ in range(6)], line(10)
    texts = [
        "\n".join([line(9), passage, line(9)]), "\n".join([passage, line(9)]), "\n".join([line(9), short, *pieces]), "\n".join([*pieces, line(9), short]),
        "\n".join([*pieces[:3], line(9), *pieces[3:]]), "\n".join([*pieces, passage, line(9)]), "\n".join([passage, line(9), passage]),
    ]
    texts.append(texts[0])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.row.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup_lines(docs).collect()}
    gone = {0: 0, 1: 1, 2: 0, 3: 6, 4: 0, 5: 7, 6: 2, 7: 3}
    assert {i: n for i, (_, n) in got.items()} == gone
    assert got[1][0] == texts[1].split("\n")[1] and got[7][0] == "" and got[2][0] == texts[2]


def test_line_dedup_keeps_the_first_and_leaves_no_run(spark):
    docs = documents(spark)
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.row.doc_id: r.text or "" for r in line_dedup.dedup_lines(docs).collect()}
    left = {x for t in after.values() for x in t.split("\n")}
    assert all(x in left for t in before.values() for x in t.split("\n"))
    seen = collections.defaultdict(set)
    for d, t in after.items():
        lines = [" ".join(words(x)) for x in t.split("\n") if words(x)]
        for i in range(len(lines)):
            total = 0
            for k in range(i, len(lines)):
                total += len(lines[k].split())
                if total >= 50:
                    seen[tuple(lines[i : k + 1])].add(d)
                    break
    assert all(len(v) == 1 for v in seen.values())


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    pairs = [(r.predicted, r.toxic) for r in rows.where("held_out").join(labels, "doc_id").collect()]
    assert sum(p == t for p, t in pairs) / len(pairs) > 0.95
    assert sum(p for p, t in pairs if not t) <= 0.02 * len(pairs)


def test_toxicity_without_labels_and_of_odd_texts(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score < 0.5 for r in rows)


def base_by_hand(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("ab@@..--+1234567890 (é%_") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == base_by_hand(t), t


def test_personal_data_votes_decide(spark):
    """Credentials that labelers agree on are added, strings that look like them and are not go, base spans stay."""
    texts = [f'x token = "{hashlib.sha1(bytes([i])).hexdigest()}" y' for i in range(30)] + [f"key AKIA{i:02}ABCDEFGHIJ{i:04} z" for i in range(30)] + ["an ordinaryverylongwordwithoutdigits here"] * 40
    texts += ["see chapter-12 of release-2024 and order 1234567890123"] * 40 + ["mail a@b.org now"] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r.id: r for r in pii.find(docs).collect()}
    assert len(got) == len(texts) and all(len(got[i].added) == 1 for i in range(60)) and not any(got[i].added for i in range(60, len(texts)))
    assert all(got[i].n_candidates >= 2 for i in range(100, 140)) and all(got[i].n_candidates == 0 for i in range(60, 100))
    assert [(s.kind, s.start, s.stop) for s in got[140].base] == [("email", 5, 12)]
    sixth = texts[30].index("AKIA")
    assert (got[30].added[0].kind, got[30].added[0].start, got[30].added[0].stop) == ("credential", sixth, sixth + 20)


def test_expectation_maximisation_by_hand():
    """The E and M steps once more, candidate by candidate instead of over counts of patterns."""
    rng = random.Random(9)
    counts = collections.Counter()
    for _ in range(400):
        true = rng.random() < 0.4
        votes = "".join(rng.choices("-0+", (1, 1, 8) if true else (7, 2, 1))[0] for _ in range(5))
        counts[f"credential|{votes}|{rng.randint(0, 2)},x"] += 1
    posterior, tables = pii.reliabilities(dict(counts), rounds=12)
    rows = [tuple("-0+".index(v) for v in p.split("|")[1]) for p, n in counts.items() for _ in range(n)]
    z = [1 / (1 + np.exp(-1.5 * sum(v - 1 for v in r))) for r in rows]
    for _ in range(12):
        share = min(max(sum(z) / len(z), 0.01), 0.99)
        chance = [[[0.0] * 3 for _ in range(2)] for _ in range(5)]
        for j in range(5):
            for c in range(2):
                seen = [1.0 + (v == 2 and c == 1) + (v == 0 and c == 0) for v in range(3)]
                for r, p in zip(rows, z):
                    seen[r[j]] += p if c else 1 - p
                chance[j][c] = [s / sum(seen) for s in seen]
        z = []
        for r in rows:
            yes, no = share, 1 - share
            for j, v in enumerate(r):
                yes, no = yes * chance[j][1][v], no * chance[j][0][v]
            z.append(yes / (yes + no))
    for r, p in zip(rows, z):
        assert posterior["credential|" + "".join("-0+"[v] for v in r)] == pytest.approx(p, abs=1e-9)
    assert all(tables["credential", name][1][2] == pytest.approx(chance[j][1][2], abs=1e-9) for j, name in enumerate(pii.LABELERS))


def test_personal_data_query_joins_spans(spark, tmp_path):
    texts = ["a@b.org 1.2.3.4 4111111111111111 +1 (988) 555-2485", None, "é 10.0.0.1 and a@b.co"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op5_personal_data(spark, str(tmp_path)).collect():
        base = base_by_hand(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]


def test_long_texts_take_time_in_proportion():
    text = "a@b.org x9y8z7w6v5 1.2.3.4 555-123-4567 " * 6000
    assert len(pii.candidate_spans(text, pii.base_spans(text))) == 4 * 6000
    assert pii.candidate_spans("x" * 2_000_000, []) == []
    assert pii.base_spans("1.2.3." + "0" * 5000 + "7") == [("ip", 0, 5007)]
    digits = "7" * 1_000_000
    began = time.perf_counter()
    assert pii.base_spans(digits) == pii.base_spans("999." * 250_000) == []
    assert time.perf_counter() - began < 5


def test_addresses_are_matched_once_for_each_run_of_digits():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("0123..9 a") for _ in range(rng.randrange(1, 40)))
        want = [m.span() for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s[1:] for s in pii.base_spans(text) if s[0] == "ip"] == want


@pytest.mark.parametrize("before", ['token = "', "token: ", "password is ", "api_key=", "secret = '"])
def test_context_labeler_hears_secrets(before):
    assert pii._votes("credential", "x9y8z7w6v5u4", before)[2] == 1
    assert pii._votes("credential", "x9y8z7w6v5u4", "version = ")[2] == -1


def test_fingerprints_of_edited_and_next_texts(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id IS NOT NULL").select((F.col("doc_id") + 1000).alias("doc_id"), "text")).dropDuplicates(["doc_id"])
    rows = {r.id: r for r in fingerprint.edited_fingerprints(docs, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for d, after in zip(order, order[1:] + order[:1]):
        t, k = texts[d], len(texts[d]) // 3
        assert rows[d].n_chars == len(t)
        assert rows[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + texts[after][:k]).encode()).hexdigest()
        near = fingerprint.likeness(fingerprint.from_text(rows[d].fingerprint), fingerprint.from_text(rows[after].fingerprint))
        assert rows[d].near_next == pytest.approx(near)
        assert rows[d].near_edited == pytest.approx(fingerprint.likeness(fingerprint.from_text(rows[d].fingerprint), fingerprint.from_text(rows[d].edited_fingerprint)))
    same = collections.defaultdict(set)
    for d, t in texts.items():
        same[t].add(rows[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_selected_windows_by_hand(monkeypatch):
    """Windows one by one: the rarest of each run of 64, those that win 16 runs or more; in stretches as in one piece."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 97 + k, 700, dtype=np.uint8)) for k in (2, 5, 20)] + [b"short", b"", b"x" * 200]
    ranks = np.array(rng.permutation(fingerprint.LEVELS))
    data, starts, counts = fingerprint._laid_out(texts)
    want = []
    for t, start, n in zip(texts, starts.tolist(), counts.tolist()):
        level = fingerprint.window_levels(np.concatenate([np.frombuffer(t, dtype=np.uint8), np.zeros(max(64 - len(t), 0), dtype=np.uint8)])) if t else []
        wins = collections.Counter()
        for first in range(-63, n):
            own = [(int(ranks[level[i]]), i) for i in range(max(first, 0), min(first + 64, n))]
            if own:
                wins[min(own)[1]] += 1
        want += [start + i for i in sorted(wins) if wins[i] >= 16]
    for size in (1 << 18, 100):
        monkeypatch.setattr(fingerprint, "CHUNK", size)
        assert fingerprint.selected(data, starts, counts, ranks).tolist() == want
        assert fingerprint.level_counts(texts).sum() == counts.sum()


def test_fingerprints_with_string_ids(spark):
    rows = [(f"id{i}", f"text {i} " * 30) for i in range(20)] + [(None, "none"), ("id3", "text 3 " * 30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {(r.id, r.text): r.next_text for r in fingerprint.with_next(docs, "doc_id", "text").collect()}
    order = sorted({i for i, _ in rows if i}, reverse=True)
    for a, b in zip(order, order[1:]):
        assert got[a, f"text {a[2:]} " * 30] in (f"text {b[2:]} " * 30, f"text {a[2:]} " * 30)
    assert got["id0", "text 0 " * 30] == "none" and len(got) == 21


def test_window_levels_equal_counts_of_each_window():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 7, 400, dtype=np.uint8)
    c = np.arange(66, dtype=float)
    cost = np.rint(c * np.log2(np.maximum(c, 1)) * 4096).astype(int)
    want = [(cost[64] - sum(cost[n] for n in collections.Counter(data[i : i + 64].tolist()).values())) * (fingerprint.LEVELS - 1) // cost[64] for i in range(len(data) - 63)]
    assert fingerprint.window_levels(data).tolist() == want


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables_and_odd_rows(spark, tmp_path):
    path = queries.tokenizer_path()
    for docs, n in ((empty(spark), 0), (odd_docs(spark), odd_docs(spark).count())):
        assert bpe.encode(docs, "doc_id", "text", path).count() == n
        assert line_dedup.dedup_lines(docs).count() == n
        assert mixing.mix(docs).count() == n
        assert ngram_join.link(docs).count() == n
        assert pii.find(docs).count() == n
        assert len(fingerprint.edited_fingerprints(docs, "doc_id", "text").collect()) == n
        assert toxicity.score(docs, (np.zeros(toxicity.BUCKETS), -1.0)).count() == n
        assert flac.decode(flac.encode(docs.withColumn("payload", flac.padded_payload(F.col("text"))), "doc_id", "payload")).count() == n
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolve_revisits(warc.read_archives(warc.write_archives(none))).count() == 0
    assert url_rules.filter_urls(none, url_rules.rules_table(spark, url_rules.HOST_RULES)).count() == 0


def test_pipeline_stages(spark, tokenizer):
    docs = documents(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = docs.collect()
    assert len(kept["toxicity"]) <= 200 and len(kept["near_duplicates"]) <= len(kept["line_dedup"]) <= len(kept["toxicity"])
    groups = brute_components([r.text for r in kept["line_dedup"]])
    first = {}
    for r, (n, g) in zip(kept["line_dedup"], groups):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    assert sorted(first.values()) == sorted(r.doc_id for r in kept["near_duplicates"])
    mixed = collections.Counter()
    for r in kept["mixing"]:
        mixed[r.source] += len(words(r.text))
    sizes = collections.Counter()
    for r in kept["near_duplicates"]:
        sizes[r.source] += len(words(r.text))
    want = targets_by_hand(sizes)
    assert all(abs(mixed[s] - want[s]) <= max(16, 0.02 * want[s]) for s in sizes)
    assert collections.Counter(bytes(r.ids) for r in kept["encoding"]) == collections.Counter(np.array(tokenizer.encode(r.text, add_special_tokens=False).ids, dtype="<u4").tobytes() for r in kept["mixing"])


def test_pipeline_on_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("empty", empty(spark)), ("odd", odd_docs(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(rows) == (name == "odd")


