"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Quality rules and toxicity drop the documents that they reject, the near-duplicate stage keeps one document of each
group that a similarity of 0.8 over five-word shingles links (SimHash first, then exactly), the secret scan masks what it finds, and packing cuts what is left into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from callproof.llm import bpe, jaccard, packing, rules, secrets, toxicity
from callproof.llm._common import checkpoint_dir, removed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_rows(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept_rows(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, bpe.vocabulary())


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("packing", pack)]

#: Trained models and token ids cannot be put in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result goes through a table in the shared checkpoint folder.

    A stage's table is removed when the next one is written; the last, which the result reads, stays.
    """
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return docs
