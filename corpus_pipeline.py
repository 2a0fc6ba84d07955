"""A corpus pipeline of five stages: quality rules, toxicity, near duplicates, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last
with the columns of documents. Documents that quality rules or toxicity reject go; of each group of near duplicates
(five words, similarity 0.8) one row of the smallest doc_id stays; secrets are replaced by the name of their kind; what remains
is packed into sequences. Labels are only learned from.

Edge cases: an empty table passes through every stage; null texts fail the quality rules; null ids are never learned
from, and go where they repeat a document (one row stays of a group without any id); of repeated rows one stays;
columns beside doc_id and text are carried along as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from causeway.llm.common import ensure_checkpoint_dir
from causeway.llm.near_dup import keep_one_of_each
from causeway.llm.packing import pack_documents
from causeway.llm.quality import keep_quality
from causeway.llm.secrets import mask_secrets
from causeway.llm.toxicity import keep_clean


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # SQL has no learned ratios, sketches or tokenizers; tests/llm compares with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; each stage's rows are written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
