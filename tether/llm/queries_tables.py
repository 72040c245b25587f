"""Queries of the operators on language, mixing and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tether.llm import language, media, mixing, quality
from tether.runtime.scratch import Scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language.is_held_out(4, 2)
    trees = language.learn(docs.where(~held).select("doc_id", "lang", "text"))
    return language.identify(docs.select("doc_id", held.alias("held_out"), "text"), trees).drop("text")


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    stats = scratch.save(quality.statistics(documents(spark, sf_dir).select("doc_id", "text")), "statistics")
    held = language.is_held_out(3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.learn(stats, labels.where(~held))
    return quality.score(stats, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, stored = media.documents_as_pages(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark))
    items = media.interleave(pages, media.describe(stored), "doc_id").where("kind = 'media'")
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return items.select("doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
