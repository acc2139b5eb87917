"""Corpus pipeline over ``documents``: every stage works on what the one
before kept, written as Parquet and read again.

toxicity: documents scored toxic go.  simhash_dedup: one document of each
class of near duplicates stays.  decontamination: documents that hold a
benchmark passage go.  secrets: spans are replaced in the text (``n_chars``
follows).  mixing: the rate of every remaining document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoclust.llm import decontaminate, gru_toxicity, mixing, secrets, simhash
from evoclust.llm.common import table
from evoclust.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = gru_toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS, gru_toxicity.toxicity(model).alias("__s")).filter("__s < 0.3").drop("__s")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_class(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs.select(*COLUMNS).withColumn("__old", F.length("text")))
    changed = F.col("__old") != F.length("text")
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the domain model is trained before any stage took documents out: hardly a toxic one is left
    return mixing.mix(docs, table(spark, sf_dir, "labels"), train_docs=table(spark, sf_dir, "documents"))


STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination),
          ("secrets", secret_scan), ("mixing", mixing_rates)]

#: learned models and 64-bit hashes are beyond SQL; tests hold the stages
#: against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
