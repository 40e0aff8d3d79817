"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, flac, lexical, line_dedup, merkle, mixing, ngram_join, pii, reshard, toxicity, url_rules, warc
from .common import materialize

TOKENIZER = "byte_bpe_50k.json"
SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the blocks of earlier documents, n_lines, n_deleted over all documents."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("row.doc_id", "text", "n_lines", "n_deleted")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken over all documents; source, shard and quota follow."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "shard", "quota")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted over all documents; only rows that aren't held out give labels to the fit."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id over all documents."""
    return ngram_join.link(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_candidates, n_doubtful over the whole texts of all documents."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, pii.BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), "n_candidates", "n_doubtful")


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature over all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", flac.padded_payload(F.col("text")).alias("payload"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    docs = docs.select(F.struct("doc_id", "n_bytes").alias("key"), "payload")
    back = flac.decode(flac.encode(docs, "key", "payload"))
    tail = F.substring("pcm", -64, 64)
    return back.select(
        "id.doc_id", "id.n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict over all pages: a host rule's verdict, else a pattern rule's, else allow."""
    rules = url_rules.rules_table(spark, url_rules.HOST_RULES + url_rules.PATTERN_RULES)
    judged = url_rules.filter_urls(_table(spark, sf_dir, "pages"), rules)
    named = [r.name for r in url_rules.HOST_RULES]
    return judged.select(F.col("id").alias("page_id"), "host", "path", F.when(F.col("rule").isin(named), F.col("rule")).alias("rule"), F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 over the whole texts of all documents."""
    path = tokenizer_path()
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), "doc_id", "text", path), path)
    return decoded.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to over all pages, written to archives and read back."""
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.resolve_revisits(warc.read_archives(archives)).withColumnRenamed("kind", "record_type")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next over all documents."""
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified over all documents; texts of even crc32(doc_id) lose their newlines."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered).withColumnRenamed("id", "doc_id")


def op12_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard over all documents: from shards by source to 8 of equal bytes; old_shard follows."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(SHARDS)).cast("int")
    layout = reshard.write_layout(_table(spark, sf_dir, "documents"), old, size)
    moved = reshard.reshard(layout, reshard.even_capacities(layout, SHARDS))
    rows = moved.rows().select(F.col("doc.doc_id").alias("doc_id"), (F.coalesce(F.octet_length("doc.text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("doc.text", F.lit(""))).alias("text_crc32"), "shard", F.col("old").alias("old_shard"), "row")
    rows = merkle.numbered(materialize(rows, "placed"), "shard", F.asc_nulls_first("doc_id"), F.asc("row"), name="slots")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("at").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_source_mixing, op3_toxicity, op4_ngram_join, op5_personal_data, op6_flac, op7_url_filter, op8_bpe, op9_warc, op10_fingerprint, op11_merkle_manifest, op12_reshard, op13_lexical_search)}

_URL_PARTS = r"""
parsed AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parsed)"""

def _sql_field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_sql_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: CRC-32 of a short ASCII text: each byte is taken in, then eight steps of one bit.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, v: CASE WHEN v >= 0 THEN xor(crc, v) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)"""

ORACLES: dict[str, str] = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE marked AS (SELECT *, CASE WHEN {_SQL_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents),
leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                  {_sql_leaf('text')} AS leaf, {_sql_leaf('tampered')} AS tampered FROM marked),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves UNION ALL
          SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n),
crowns AS (SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM nodes WHERE n = 1 UNION ALL
           SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM crowns WHERE n > 1 GROUP BY level, pos // 3, n),
beside AS (SELECT tree, level, pos, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
           FROM nodes WHERE n > 1 WINDOW r AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)),
above AS (SELECT level, pos, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
          FROM crowns WHERE n > 1 WINDOW r AS (PARTITION BY level, pos // 3 ORDER BY pos)),
walk AS (SELECT doc_id, tree, pos, 0 AS level, tampered AS h, '' AS proof FROM leaves UNION ALL
         SELECT w.doc_id, w.tree, w.pos // 3, w.level + 1, sha256(before || w.h || after), w.proof || before || after FROM walk w JOIN beside b ON w.tree = b.tree AND w.level = b.level AND w.pos = b.pos),
reached AS (SELECT doc_id, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY doc_id, tree),
climb AS (SELECT doc_id, tree AS pos, 0 AS level, h, proof FROM reached UNION ALL
          SELECT w.doc_id, w.pos // 3, w.level + 1, sha256(before || w.h || after), w.proof || before || after FROM climb w JOIN above b ON w.level = b.level AND w.pos = b.pos),
folded AS (SELECT doc_id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY doc_id)
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN folded f ON l.doc_id = f.doc_id JOIN (SELECT tree, h FROM nodes WHERE n = 1) t ON l.tree = t.tree CROSS JOIN (SELECT h FROM crowns WHERE n = 1) r""",
    "op13_lexical_search": r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts CROSS JOIN corpus GROUP BY term, docs),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sized AS (SELECT doc_id, 50 + (50 * n * docs) // all_terms AS m FROM lengths CROSS JOIN corpus),
scores AS (SELECT item_id, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM wanted i JOIN counts c ON i.term = c.term JOIN weighed t ON i.term = t.term JOIN sized s ON c.doc_id = s.doc_id GROUP BY item_id, c.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op9_warc": """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned""",
    "op7_url_filter": rf"""
WITH {_URL_PARTS.strip()},
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN starts_with(host, 'blog.') AND path LIKE '%.html' THEN 'block'
    WHEN starts_with(host, 'm.') AND starts_with(path, '/es/') THEN 'block'
    WHEN host LIKE '%.net' AND starts_with(path, '/en/9') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
