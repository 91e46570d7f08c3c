"""The ten operators applied to their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import decontamination, language_id, lm_scoring, mixing, near_duplicates, perspectives, quality, sharding, token_counts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of all words, weights 3, 1, 2 repeating, no source above twice its size."""
    return mixing.mix_report(_table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents; the target are the documents labelled as good."""
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every vector whose id is divisible by 50, against all vectors."""
    return topk.top_k(topk.scaled(_table(spark, sf_dir, "embeddings")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three stated edits of each."""
    docs = _table(spark, sf_dir, "documents")
    return token_counts.edited_counts(docs, token_counts.stated_edits(F.col("doc_id"), F.col("text")), token_counts.default_vocabulary())


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ten-word benchmark windows in all documents."""
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the perspective of each of its participants."""
    return perspectives.rotation_report(_table(spark, sf_dir, "conversations"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four fifths of the labelled ones."""
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_lm_score": op2_lm_score,
    "op3_topk": op3_topk,
    "op4_token_counts": op4_token_counts,
    "op5_shard": op5_shard,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_perspectives": op8_perspectives,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op1_mix": mixing.ORACLE_SQL,
    "op3_topk": topk.ORACLE_SQL,
    "op6_decontaminate": decontamination.ORACLE_SQL,
    "op8_perspectives": perspectives.ORACLE_SQL,
}
