"""A training corpus from documents: quality, near-duplicates, benchmark copies, secrets, packing.

Each stage takes all rows that its predecessor kept and returns the columns of documents, the last one pieces of
sequences. Rows with a null doc_id are judged by their texts like all others; empty texts are rejected as junk. A stage's
result is written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm import leaks, near_dups, packing, quality, secrets
from assetflow.session import shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds neither junk nor toxic."""
    scorer, _ = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.apply_scorer(docs, scorer, column="_judged").where("_judged.kept").select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts, that with the smallest doc_id; a doc_id's different texts all stay."""
    return near_dups.one_of_each_group(docs, shingle=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of test items."""
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars that tells the new length."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n_chars)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
