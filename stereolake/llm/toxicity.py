"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its lower-cased characters (code points), present or not, taken from the whole
text. Presence, not frequency, keeps a single telling word telling in a text of any length. Each bag of labelled rows gives
log-count ratios and a logistic regression on the features scaled by them; the bags are fitted in parallel tasks and
their weights averaged. Scoring is a sum of weights, without any shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, map_slices, materialize, mix, small_batches

NGRAMS, BUCKET_BITS, TOGETHER, PIECE = (4, 5, 6), 18, 32, 1 << 18
BUCKETS = 1 << BUCKET_BITS
#: Fixed values of the fit: rows a class and bag at most, bags, rounds, ridge, smoothing.
ROWS_PER_CLASS, BAGS, ROUNDS, RIDGE, SMOOTH = 1200, 1, 300, 1e-5, 0.5
#: N-grams in fewer labelled texts, or nearly as likely in either class, carry no evidence and get no weight.
LEAST_TEXTS, LEAST_RATIO = 3, 1.0

#: Margins are sums over hundreds of n-grams; divided by this, scores don't all round to 0 or 1. The decision at 0.5 stays.
FLATTER = 8.0

_BETWEEN = re.compile(r"[\W_]+")
_STEPS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(max(NGRAMS))]
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, one after the other, and how many each text has.

    A text is lower-cased and set between spaces; runs of anything but letters and digits count as one space, so that
    n-grams show where words start and end.
    """
    found, counts = [], []
    for first in range(0, len(texts), TOGETHER):
        plain = [f" {_BETWEEN.sub(' ', t.lower()).strip()} " for t in texts[first : first + TOGETHER]]
        ends = np.cumsum([len(t) for t in plain])
        data = np.frombuffer("".join(plain).encode("utf-32-le"), dtype=np.uint32)
        present = np.zeros(len(plain) << BUCKET_BITS, dtype=bool)
        for lo in range(0, len(data), PIECE):
            codes = mix(data[lo : lo + PIECE + max(NGRAMS) - 1].astype(np.uint64) + np.uint64(1))
            at = np.arange(lo, min(lo + PIECE, len(data)))
            owner = np.searchsorted(ends, at, side="right")
            rest, owner = ends[owner] - at, owner << BUCKET_BITS
            h = np.zeros(len(at), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(max(NGRAMS)):
                    m = max(min(len(h), len(codes) - k), 0)
                    h = h[:m] + codes[k : k + m] * _STEPS[k]
                    if k + 1 in NGRAMS:
                        bucket = (h * _SPREAD >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                        inside = rest[:m] > k
                        present[(owner[:m] + bucket)[inside]] = True
        keys = np.flatnonzero(present)
        found.append((keys & (BUCKETS - 1)).astype(np.int32))
        counts.append(np.bincount(keys >> BUCKET_BITS, minlength=len(plain)))
    none = [np.zeros(0, dtype=np.int32)]
    return np.concatenate(found or none), np.concatenate(counts or none)


def fit_bag(rows: list[np.ndarray], labels: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights by bucket and intercept. prior: the share of label 1 that the rows are weighed to."""
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for r, y in zip(rows, labels):  # a row's buckets are distinct
        (p if y == 1 else q)[r] += 1
    ratio = np.log((p / (labels.sum() + 2 * SMOOTH)) / (q / ((1 - labels).sum() + 2 * SMOOTH)))
    ratio[(p + q < LEAST_TEXTS + 2 * SMOOTH) | (np.abs(ratio) < LEAST_RATIO)] = 0
    # only the telling n-grams of each row are kept, so that the fit's memory is a small part of the sample's
    told = [r[ratio[r] != 0] for r in rows]
    idx = np.concatenate(told)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in told])
    x = ratio[idx]
    share = max(labels.mean(), 1e-9)
    weight = np.where(labels == 1, prior / share, (1 - prior) / max(1 - share, 1e-9)) / len(rows)
    w, b = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, ROUNDS + 1):
        margin = np.bincount(owner, weights=x * w[idx], minlength=len(rows)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        grad = np.append(np.bincount(idx, weights=x * error[owner], minlength=BUCKETS) + RIDGE * w, error.sum())
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    return w * ratio, b


def training_rows(labels: DataFrame, id_col: str, label_col: str, per_class: int, bags: int) -> DataFrame:
    """(id, label, bag): at most per_class * bags labelled rows of each class, chosen by a hash of the id; an id with both labels has label 1."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id", F.lit(5))
    chosen = [known.where(F.col("label") == v).orderBy(order, "id").limit(per_class * bags) for v in (0, 1)]
    return chosen[0].unionByName(chosen[1]).withColumn("bag", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(bags)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, per_class: int = ROWS_PER_CLASS, bags: int = BAGS) -> tuple[np.ndarray, float]:
    """Averaged weights and intercept of a classifier of label_col, from a bounded sample of labelled rows.

    per_class * bags rows of a class at most take part; the share of label 1 is that of all labelled rows. Rows without a
    text or label don't take part; texts of repeated ids all do. Without both labels (or any rows) the model says nothing:
    weights 0 and a score below one half, above it where all labels are 1. Very long texts count as a whole. Other columns
    of either table, whatever their names, aren't read.
    """
    small_batches(docs.sparkSession)
    share = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(F.col(label_col).cast("double")).alias("share")).head()["share"]
    if not share or share >= 1:
        return np.zeros(BUCKETS), -2.0 if not share else 2.0
    sample = training_rows(labels, id_col, label_col, per_class, bags)
    sample = materialize(sample, "toxicity-sample")  # at most 2 * per_class * bags rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "id").select("label", "bag", "text")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        idx, counts = features([t or "" for t in batch.column("text").to_pylist()])
        ends = np.cumsum(counts)
        blobs = [idx[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["label", "bag", "features"])

    found = map_slices(rows, extract, "text", "label int, bag int, features binary")

    def train(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(b, dtype=np.int32) for b in table.column("features").to_pylist()]
        y = np.array(table.column("label").to_pylist(), dtype=np.float64)
        w, b = fit_bag(own, y, float(share)) if 0 < y.mean() < 1 else (np.zeros(BUCKETS), 0.0)
        return pa.table({"weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "intercept": [float(b)], "whole": [bool(0 < y.mean() < 1)]})

    models = found.groupBy("bag").applyInArrow(train, "weights binary, intercept double, whole boolean").where("whole").collect()  # a row for each bag
    if not models:
        return np.zeros(BUCKETS), -2.0
    return np.mean([np.frombuffer(m["weights"], dtype=np.float32) for m in models], axis=0), float(np.mean([m["intercept"] for m in models]))


def score_column(spark: SparkSession, model: tuple[np.ndarray, float], text: Column) -> Column:
    """The score of a text column, 0 to 1, from the whole text; null and empty texts get the score that no n-gram gives."""
    weights, intercept = spark.sparkContext.broadcast(model[0].astype(np.float32)), model[1]  # a float for each bucket

    def run(batch: pa.RecordBatch) -> pa.Array:
        idx, counts = features([t or "" for t in batch.column(0).to_pylist()])
        owner = np.repeat(np.arange(len(counts)), counts)
        margin = np.bincount(owner, weights=weights.value[idx], minlength=len(counts)) + intercept
        return pa.array(1 / (1 + np.exp(-np.clip(margin / FLATTER, -500, 500))))

    return by_text(spark, run, "double", text)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, repeated ones alike; other columns aren't carried, an empty table gives no rows."""
    return docs.select(docs[id_col].alias("id"), score_column(docs.sparkSession, model, docs[text_col]).alias("score"))
