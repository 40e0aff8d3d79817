"""Toxicity by loops, FLAC columns by hashlib and zlib, the pipeline's first stages by brute force, very long texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stereolake.llm import flac, line_dedup, mixing, ngram_join, queries, toxicity

from .test_operators import ODD, SF, common_block_lines, documents, odd_docs, words

MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & MASK
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ (h >> 33)


def buckets(text):
    """Distinct buckets of the n-grams of a text, one n-gram after the other."""
    plain = " " + re.sub(r"[\W_]+", " ", (text or "").lower()).strip() + " "
    found = set()
    for n in toxicity.NGRAMS:
        for at in range(len(plain) - n + 1):
            h = sum(mixed(ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(plain[at : at + n])) & MASK
            found.add((h * 0xD6E8FEB86659FD93 & MASK) >> (64 - toxicity.BUCKET_BITS))
    return found


def score_by_hand(text, model):
    weights, intercept = model
    return 1 / (1 + math.exp(-(sum(float(np.float32(weights[b])) for b in buckets(text)) + intercept) / toxicity.FLATTER))


def test_features_by_loops():
    texts = [t or "" for t in ODD] + ["Ärger über ΣΑΣ_42, naïve!", "abc", "ab\tcd ef"]
    idx, counts = toxicity.features(texts)
    ends = np.cumsum(counts)
    for t, n, e in zip(texts, counts, ends):
        assert sorted(idx[e - n : e].tolist()) == sorted(buckets(t)), t


def test_ratios_and_a_step_by_loops(monkeypatch):
    """Log-count ratios with smoothing, the cut, and the first step of the descent, all in dicts."""
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.choice(40, 12)).astype(np.int32) for _ in range(60)]
    labels = np.array([float(0 in r or 1 in r) for r in rows])
    prior = 0.3
    w, b = toxicity.fit_bag(rows, labels, prior)
    n1, n0, s = labels.sum(), (1 - labels).sum(), toxicity.SMOOTH
    have = [collections.Counter(int(x) for r, y in zip(rows, labels) if y == v for x in r) for v in (0, 1)]
    ratio = {}
    for x in range(40):
        p, q = have[1][x] + s, have[0][x] + s
        r = math.log((p / (n1 + 2 * s)) / (q / (n0 + 2 * s)))
        ratio[x] = r if have[0][x] + have[1][x] >= toxicity.LEAST_TEXTS and abs(r) >= toxicity.LEAST_RATIO else 0.0
    share = labels.mean()
    weight = [(prior / share if y else (1 - prior) / (1 - share)) / len(rows) for y in labels]
    error = [u * (prior - y) for u, y in zip(weight, labels)]  # at weights 0 the model gives the prior
    for x in range(40):
        grad = sum(e * ratio[x] for e, r in zip(error, rows) if x in r)
        want = -0.05 * grad / (abs(grad) + 1e-9) * ratio[x] if ratio[x] else 0.0
        assert w[x] == pytest.approx(want, abs=1e-6), x
    assert any(ratio.values()) and w[40:].max() == 0
    assert b == pytest.approx(math.log(prior / (1 - prior)) - 0.05 * math.copysign(1, sum(error)) * (abs(sum(error)) > 1e-12), abs=1e-6)


def test_first_stages_of_the_pipeline(spark):
    """Rows of the toxicity and line dedup stages, each against its own input."""
    docs = documents(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    kept = corpus_pipeline.reject_toxic(spark, docs, SF).collect()
    want = [r for r in docs.collect() if score_by_hand(r.text, model) < 0.5]
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in want) and 0 < len(want) < 200
    rows = sorted(kept, key=lambda r: r.doc_id)
    lines = [(r.text or "").split("\n") for r in rows]
    plain = [[" ".join(words(x)) for x in own if words(x)] for own in lines]
    want = {}
    for j, r in enumerate(rows):
        gone = set().union(*(common_block_lines(plain[i], plain[j], line_dedup.LEAST_WORDS) for i in range(j) if set(plain[i]) & set(plain[j])), set())
        at = [n for n, x in enumerate(lines[j]) if words(x)]
        spans = [at[n] for n in sorted(gone)]
        whole = set(spans)
        for a, b in zip(spans, spans[1:]):  # blank lines inside a block go with it
            if not any(n in at for n in range(a + 1, b)):
                whole |= set(range(a, b))
        text = "\n".join(x for n, x in enumerate(lines[j]) if n not in whole) if r.text is not None else None
        if not whole or words(text):
            want[r.doc_id] = text
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_shared_blocks(spark, spark.createDataFrame(kept, docs.schema), SF).collect()}
    assert {k: " ".join(words(t)) for k, (t, _) in got.items()} == {k: " ".join(words(t)) for k, t in want.items()}
    assert all(n == len(t) for k, (t, n) in got.items() if t != next(r.text for r in rows if r.doc_id == k))


def test_columns_of_op6(spark, tmp_path):
    docs = documents(spark).unionByName(odd_docs(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    media = {r.id: bytes(r.media) for r in flac.encode(docs.select("doc_id", flac.padded_payload(F.col("text")).alias("payload")), "doc_id", "payload").collect()}
    same = collections.defaultdict(set)
    rows = queries.op6_flac(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(media[r.doc_id]) and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest()
        same[raw].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())


def test_texts_of_megabytes(spark):
    """5 MB in one text, in words, in one word and in one line, through the operators that take whole texts."""
    texts = ["word other " * 460_000, "x" * 5_000_000, "a\n" * 2_500_000, "short"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.id: r["size"] for r in mixing.mix(docs).collect()} == {0: 920_000, 1: 1, 2: 2_500_000, 3: 1}
    assert {r.id: r.n_shingles for r in ngram_join.link(docs).collect()} == {0: 2, 1: 1, 2: 1, 3: 1}
    scored = toxicity.score(docs, (np.ones(toxicity.BUCKETS), -1.0)).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    back = flac.decode(flac.encode(docs.select("doc_id", flac.padded_payload(F.col("text")).alias("payload")), "doc_id", "payload"))
    assert {r.id: r.n for r in back.select("id", F.octet_length("pcm").alias("n")).collect()} == {i: max(64, -(-len(t) // 64) * 64) for i, t in enumerate(texts)}
    assert {r.row.doc_id: r.n_deleted for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()} == dict.fromkeys(range(4), 0)
