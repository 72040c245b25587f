"""Queries of the deduplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tether.llm import embeddings, minhash, suffixes
from tether.llm.queries_tables import documents


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op7_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffixes.removed(docs, suffixes.find_repeats(docs))
