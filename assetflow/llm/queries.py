"""The registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm import balance, chats, chunked_bpe, lattice, leaks, near_dups, packing, quality, ranked, secrets, shards, vectors, whitening
from assetflow.session import shared_dir

TOKENIZER = "word_bpe_49k.json"
VOCABULARY = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-shards")
    shards.write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return shards.read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.conversations(table(spark, sf_dir, "conversations"))


def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets.joined(spans, ("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.joined(spans).alias("spans"),
        secrets.count_of(spans, "guess").alias("n_guess"),
    )


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balance.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return packed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_hnsw_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = chunked_bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTRY = {
    "op1_token_shards": (op1_token_shards, None),
    "op2_subword_lattice": (op2_subword_lattice, None),
    "op3_snapshot_collapse": (op3_snapshot_collapse, chats.CONVERSATIONS_SQL),
    "op4_minhash_near_dups": (op4_minhash_near_dups, None),
    "op5_decontamination": (op5_decontamination, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_balanced_shards": (op7_balanced_shards, None),
    "op8_weak_label_quality": (op8_weak_label_quality, None),
    "op9_packing": (op9_packing, None),
    "op10_hnsw_near_vectors": (op10_hnsw_near_vectors, None),
    "op11_feast_whitening": (op11_feast_whitening, None),
    "op12_chunked_bpe": (op12_chunked_bpe, None),
    "op13_ranked_search": (op13_ranked_search, ranked.SQL),
}
