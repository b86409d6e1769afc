"""From raw documents to packed sequences in five stages, each written and read again.

Stages but the last return the columns of ``documents``:
quality rules drop what they reject; one document of each near-duplicate group stays;
secrets in texts are replaced by a mark; documents are repeated or left out to meet the
sources' weights; what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.llm import minhash, mixing, packing, quality, secrets
from gaitframe.llm.queries import tokenizer_path
from gaitframe.llm.shared import fresh, settle, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; rows that are equal in id and text count once.

    Where such rows differ in other columns, any one of them stays.
    """
    found = minhash.near_duplicates(docs, words=5, percent=80)
    one, key = fresh(docs, "kept_id", "kept_key")
    keep = settle(found.where("kept").select(F.col("doc_id").alias(one), F.col("text_key").alias(key)).distinct(), "kept")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & F.xxhash64("text").eqNullSafe(F.col(key))
    return docs.join(keep, match).dropDuplicates([one, key]).drop(one, key)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Minima, models and tokens are beyond SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
