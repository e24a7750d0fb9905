"""The operators applied to their whole tables with production parameters, as queries of (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import ann, html_extract, mixing, packing, quality, secret_scan, sharding, simhash, sketch, toxicity
from cairnlog.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.forest(spark))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.withColumns({"mix_order": F.round("mix_order", 6), "weight": F.round("weight", 9), "alpha": F.round("alpha", 7)})


def op3_consensus_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op8_fuzzy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited(table(spark, sf_dir, "documents"))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_temperature_mixing, op3_consensus_extract, op4_byte_quality, op5_best_fit_packing, op6_simhash, op7_projection_forest, op8_fuzzy_toxicity,
    op9_bottom_k, op10_rendezvous_sharding,
)}

#: The shard with the largest hash of (key, shard), as the weights are equal; CRC-32 by its polynomial, a byte at a time.
_SHARDS = """WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT] || list_transform(range(8), lambda z: z::UBIGINT),
  lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS tab),
rows_ AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h,
  coalesce('k' || CAST(doc_id AS VARCHAR), 'null') AS key, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/slot'), 1, 8))::BIGINT % 512 AS block FROM documents),
sized AS (SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::INT, 2))::UBIGINT),
  lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  list_transform(range(9), lambda s: ('0x' || substr(md5(key || '/' || CAST(s AS VARCHAR)), 1, 13))::BIGINT) AS u FROM rows_, tab),
dealt AS (SELECT *, list_position(u[1:8], list_max(u[1:8])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM dealt"""
#: The least exponent on the bisection's grid that keeps to two reads, the weights, and each block's permutations up to its budget.
_MIX = """WITH rows_ AS (SELECT doc_id, source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))) AS n,
  coalesce('k' || CAST(doc_id AS VARCHAR), 'null') AS name FROM documents),
sizes AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS m FROM rows_ GROUP BY source),
ex AS (SELECT CASE WHEN max(tokens) = min(tokens) THEN 1 ELSE least(1073741824, greatest(1, ceil(1073741824 * (1 - ln(2) / ln(max(tokens) / min(tokens))))))
  END / 1073741824 AS alpha FROM sizes),
total AS (SELECT sum(pow(tokens, alpha)) AS z FROM sizes, ex),
weighed AS (SELECT source, tokens, m, alpha, pow(tokens, alpha) / z AS weight FROM sizes, ex, total),
shares AS (SELECT *, round(weight * (SELECT max(tokens / weight) FROM weighed) / tokens, 9) AS reads, CAST(ceil(m / 64) AS BIGINT) AS blocks FROM weighed),
dealt AS (SELECT r.*, s.alpha, s.weight, s.reads, ('0x' || substr(md5(name || '/block/42'), 1, 8))::BIGINT % s.blocks AS block FROM rows_ r JOIN shares s ON r.source IS NOT DISTINCT FROM s.source),
read_ AS (SELECT *, ('0x' || substr(md5(name || '/' || CAST(epoch AS VARCHAR) || '/42'), 1, 15))::BIGINT AS key
  FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(reads) AS BIGINT)))) AS epoch FROM dealt)),
placed AS (SELECT *, sum(n) OVER b AS whole, coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER o - 1 AS position FROM read_
  WINDOW b AS (PARTITION BY source, block, epoch), o AS (PARTITION BY source, block, epoch ORDER BY key, doc_id NULLS FIRST, n))
SELECT doc_id, source, CAST(n AS BIGINT) AS tokens, CAST(epoch AS INTEGER) AS epoch, block, position, round((epoch + before / whole) / reads, 6) AS mix_order,
  round(weight, 9) AS weight, round(alpha, 7) AS alpha FROM placed WHERE before < whole * (reads - epoch) OR reads >= epoch + 1"""
ORACLES: dict[str, str] = {"op2_temperature_mixing": _MIX, "op10_rendezvous_sharding": _SHARDS}
