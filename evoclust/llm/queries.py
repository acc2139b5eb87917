"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoclust.llm import (chat_trie, collocations, decontaminate, fm_quality, gbt_quality, gru_toxicity, lang_centroids, lm_bloom, mixing,
                          secrets, simhash, token_align, url_graph)
from evoclust.llm.common import fold_of, table

TOKENIZERS = "/opt/tokenizers"


def op1_lm_bloom(spark: SparkSession, sf: str) -> DataFrame:
    return lm_bloom.score(table(spark, sf, "documents"), fold_of("doc_id", 7) != 2)


def op2_fm_quality(spark: SparkSession, sf: str) -> DataFrame:
    return fm_quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), fold_of("__id", 3) != 1)


def op3_spaced_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_url_graph(spark: SparkSession, sf: str) -> DataFrame:
    return url_graph.judge(table(spark, sf, "pages"))


def op5_gbt_rules(spark: SparkSession, sf: str) -> DataFrame:
    return gbt_quality.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_gru_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return gru_toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), fold_of("__id", 4) != 2)


def op7_chat_trie(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(said).alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_trie.digests(rows)


def op8_simhash_ball(spark: SparkSession, sf: str) -> DataFrame:
    got = simhash.components(table(spark, sf, "documents"))
    return got.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op9_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_markov_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents"))


def op11_token_align(spark: SparkSession, sf: str) -> DataFrame:
    return token_align.digests(table(spark, sf, "documents"), f"{TOKENIZERS}/{token_align.A_FILE}",
                               f"{TOKENIZERS}/{token_align.B_FILE}")


def op12_lang_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return lang_centroids.by_fold(table(spark, sf, "documents"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lm_bloom, op2_fm_quality, op3_spaced_seeds, op4_url_graph, op5_gbt_rules, op6_gru_toxicity, op7_chat_trie,
    op8_simhash_ball, op9_soft_mixing, op10_markov_secrets, op11_token_align, op12_lang_centroids,
    op13_collocations)}

_CONV = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, role = 'assistant' AS learn,
        regexp_replace(replace(text, '\\', '\\\\'), '<(\\||/?s>|<)', '<\\\\\\1', 'g') AS t1 FROM c),
f AS (SELECT *, regexp_replace(t1, '\\[(/?INST\\])', '[\\\\\\1', 'g') AS t2 FROM e),
g AS (SELECT *, length(role) + length(t2) + 23 AS chars FROM f),
h AS (SELECT *, CAST(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - chars AS BIGINT) AS beg FROM g)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN learn THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN learn THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, sha256(string_agg(CAST(beg AS VARCHAR), ',' ORDER BY beg)) AS positions_sha256
FROM h GROUP BY conv_id"""

SQL = {"op3_spaced_seeds": decontaminate.oracle(), "op7_chat_trie": _CONV, "op13_collocations": collocations.oracle()}
