"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, encoding; each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns the columns of documents (the last one its encodings), working on all
that its predecessor kept:

* toxicity: a classifier fitted on all labelled rows scores every text; rows with a score of 0.5 or more go. Null and
  empty texts are scored like texts without any n-gram.
* line_dedup: blocks of 50 words or more that an earlier document has go from a text, and n_chars is counted anew. A
  document of which nothing is left goes; texts that were empty, null or without words before stay.
* near_duplicates: of each component of texts that share 3/4 of their 5-word shingles the document with the smallest
  doc_id stays. Equal rows become one row; different texts under one doc_id, or without one, are documents of their own.
* mixing: each source's share is brought to its target. A document of which the mix takes k whole rounds is k rows; where
  it takes a part of a round, each range of words that the selected blocks cover follows as a row, wherever in the text
  it lies (two where the run of blocks wraps within the document). What it takes nothing of goes.
* encoding: doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers) and ids_sha256 of every row.

Extra columns of documents pass through the filtering stages. Empty tables give empty results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereolake.llm import bpe, line_dedup, mixing, ngram_join, queries, toxicity
from stereolake.llm.common import WORD, by_text, materialize

SEED = 7


def _row(docs: DataFrame) -> F.Column:
    return F.struct(*[docs[c] for c in docs.columns])


def _unpacked(rows: DataFrame, docs: DataFrame, changed: dict[str, F.Column] | None = None) -> DataFrame:
    """The columns of docs out of the struct `row`, some of them changed."""
    changed = changed or {}
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below 0.5, whole and in any number; texts without n-grams (null, empty) get the score of none."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return docs.where(toxicity.score_column(spark, model, docs["text"]) < 0.5)


def drop_shared_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of earlier ones; a row of which no word is left goes, rows that lost nothing stay as they are."""
    cleaned = line_dedup.dedup_lines(docs).where((F.col("n_deleted") == 0) | F.col("text").rlike(WORD))
    n_chars = F.when(F.col("n_deleted") == 0, F.col("row.n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return _unpacked(cleaned, docs, {"text": F.col("text"), "n_chars": n_chars})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest doc_id (null ids last, then by a hash of the row); of equal rows one.

    Rows are told apart by id and hash, so different texts under one id, or under none, are documents of their own. Rows
    without words link with nothing and stay, equal ones once.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    rows = docs.select(_row(docs).alias("row"), F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), F.xxhash64(*[docs[c] for c in hashed]).alias("hash")).alias("key"))
    linked = ngram_join.link(rows.select("key", F.col("row")["text"].alias("text")), "key")
    own = (F.col("id.hash") == F.col("component_id.hash")) & F.col("id.id").eqNullSafe(F.col("component_id.id"))
    first = linked.where(own).select(F.col("id.hash").alias("kept_hash"))
    rows = rows.select("row", F.col("key.hash").alias("own_hash"))  # the hash covers the id, so texts are shuffled once
    kept = rows.join(first, F.col("own_hash") == F.col("kept_hash"), "left_semi").dropDuplicates(["own_hash"])
    return _unpacked(kept, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The word ranges that the mix takes, a row each; rows equal in doc_id, source and text all give the same ranges."""
    place = F.xxhash64(F.lit(SEED), docs["doc_id"], docs["source"], docs["text"])
    rows = docs.select(_row(docs).alias("row"), place.alias("place"))
    sizes = docs.select(place.alias("place"), docs["source"].alias("source"), docs["text"].alias("text"))
    taken = mixing.mix(sizes, "place", "source", "text", seed=SEED).where("taken > 0")
    taken = taken.groupBy(F.col("id").alias("taken_place")).agg(F.max(F.struct("size", "ranges")).alias("taken"))
    joined = rows.join(taken, F.col("place") == F.col("taken_place"))
    parts = joined.select("row", F.col("taken.size").alias("size"), F.explode("taken.ranges").alias("part"))

    def words_of(batch: pa.RecordBatch) -> pa.Array:
        texts = []
        for text, size, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            if end - begin < size:
                first, last = 0, len(text)
                for k, m in enumerate(_WORD.finditer(text)):
                    if k == begin and begin:
                        first = m.start()
                    if k == end - 1 and end < size:
                        last = m.end()
                        break
                text = text[first:last]
            texts.append(text)
        return pa.array(texts, pa.string())

    cut = parts.withColumn("text", by_text(spark, words_of, "string", F.col("row.text"), F.col("size"), F.col("part.begin"), F.col("part.end")))
    return _unpacked(cut, docs, {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)})


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row; null and empty texts have none."""
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    encoded = bpe.encode(keyed, "key", "text", queries.tokenizer_path())
    return encoded.select("id.doc_id", "id.source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


_WORD = re.compile(WORD)

STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_shared_blocks), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("encoding", encode_texts)]

#: SQL expresses neither a fitted classifier nor patience diff; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
