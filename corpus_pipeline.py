"""A corpus pipeline of five stages over the documents table.

Each stage is ``(spark, docs, folder) -> DataFrame``; ``run`` writes every
stage's result to the shared folder and reads it again as the next one's
documents, so a lost executor repeats work of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_ledger.llm import decontaminate, mixing, prob_minhash, quality_gbt, sharding
from cohort_ledger.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_gbt.keep_good(docs, quality_gbt.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return prob_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a phrase of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


#: Domains of the labels (decent, toxic) and their shares of the words.
TARGETS = [0.93, 0.07]


def mixing_weights(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated so that the domains meet their shares; none is dropped."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = mixing.fit(docs, labels, F.col("toxic"), len(TARGETS))
    return mixing.mixed(docs, model, TARGETS, least=1.0)


def shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document's shard and place, each shard with the mixture of the whole."""
    return sharding.interleave(docs, carry=("source",))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
    ("sharding", shards),
]

#: The stages fit models, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, applied to the documents of ``folder``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
