"""The training-data pipeline: five stages over `documents`, each an operator of tidemark.llm.

Quality rules reject documents; of near-duplicates one document of each group stays; documents that
hold a benchmark passage go; secrets are masked in the texts; what is left is encoded to token ids
and decoded again. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, quality, secrets, simhash
from tidemark.llm.common import bounded_batches, documents
from tidemark.llm.queries import PATTERN, RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the counts and digests of ids and decoded bytes."""
    bounded_batches(spark)
    return bpe.digests(bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_masking),
    ("byte_bpe", token_ids),
]

#: Near-duplicate groups are reachability over bit distances, which SQL cannot express at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
