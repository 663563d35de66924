"""The queries of the corpus operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, neighbours, packing, passages, quality, simhash, tokencount, toxicity, urlrules
from .common import held_out, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage's place is in words, its end exclusive; class_id is the smallest document that links of passages lead to."""
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.join(passages.classes(found), "doc_id").select("doc_id", "ref_doc_id", "start", "end", "ref_start", "ref_end", "similarity", "class_id")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "_mix.*")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.fit(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), TOKENIZER))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_passages, op4_neighbours, op5_mixing, op6_tokens, op7_urls, op8_quality, op9_language, op10_packing)}

ORACLES = {
    "op5_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
-- Shares the total by weight, fixes the sources above their limit at it, and shares the rest again until none is above.
rounds AS (
  SELECT 0 AS step, source, source_size, weight, false AS fixed, false AS over, CAST(NULL AS DOUBLE) AS level FROM weighed
  UNION ALL
  SELECT step + 1, source, source_size, weight, fixed OR over, NOT (fixed OR over) AND level * weight > 3 * source_size, level FROM (
    SELECT step, source, source_size, weight, fixed, over,
           CAST(sum(source_size) OVER () - sum(CASE WHEN fixed OR over THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE)
             / nullif(sum(CASE WHEN fixed OR over THEN 0 ELSE weight END) OVER (), 0) AS level,
           bool_or(over) OVER () AS again
    FROM rounds) WHERE step = 0 OR again),
aimed AS (
  SELECT source, source_size, CASE WHEN fixed OR over THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target
  FROM rounds WHERE step = (SELECT max(step) FROM rounds)),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS ahead,
         CAST(floor(a.target) AS BIGINT) AS budget
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - ahead)) END AS taken
FROM placed"""
}
