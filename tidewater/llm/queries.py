"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, mixing, quality, toxicity
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .packing import pack
from .shared import shared_path
from .simhash import hexadecimal, simhash_groups
from .substring_dedup import substring_dedup
from .token_orc import token_index, write_tokens

#: The policy in force.
POLICY = 2
#: Reject documents with this score or more.
TOXIC = 0.7


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.ledger(_read(spark, sf_dir, "documents")), POLICY)
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE)) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(_read(spark, sf_dir, "documents"), shared_path(spark, "token-ids"), vocabulary("word_bpe_49k.json"), 2)
    return token_index(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), "spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_read(spark, sf_dir, "documents")).select("doc_id", hexadecimal("print").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_orc, op3_toxicity, op4_mixing, op5_exact_dedup, op6_packing, op7_substring_dedup, op8_license_scan, op9_simhash, op10_line_dedup)}

OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM w),
win AS (SELECT doc_id, k, CASE WHEN lead(word, 4) OVER d IS NOT NULL THEN [word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d] END AS g FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
twice AS (SELECT doc_id, k, CAST(g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS INT) AS t FROM win),
cov AS (SELECT doc_id, max(t) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
rep AS (SELECT doc_id, sum(c) AS n FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
  + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT + 64 * (10 * n_letters < 5 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 15) = 0 AS kept, fail_bits FROM b"""

OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS c FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY c DESC, doc_id NULLS LAST) AS place FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM k"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM w),
win AS (SELECT doc_id, k, word, CASE WHEN lead(word, 49) OVER d IS NOT NULL THEN sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS g FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
least AS (SELECT doc_id, k, word, CAST(g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS INT) AS x FROM win),
cov AS (SELECT doc_id, k, word, max(x) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM least),
per AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0), '') AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN per USING (doc_id)"""

ORACLES = {"op1_quality_rules": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op8_license_scan": license_scan.oracle()}
