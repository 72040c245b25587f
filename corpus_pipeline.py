"""A training corpus from raw documents: language, near copies, repeated passages, mixture, packed sequences."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tether.llm import language, minhash, mixing, packing, suffixes
from tether.runtime.scratch import Scratch

#: No SQL can express context trees, suffix merges and best-fit packing.
ORACLE_SQL = None
#: Documents that a task hands to Python at once. The stages share executors, so what one holds is short for the next.
ROWS_AT_ONCE = 1_000


def few_at_once(stage):
    """The stage, in a session that sends at most ``ROWS_AT_ONCE`` rows in an Arrow batch; a smaller setting stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name))
        spark.conf.set(name, min(now, ROWS_AT_ONCE) if now > 0 else ROWS_AT_ONCE)
        return stage(spark, docs, sf_dir)

    return run


@few_at_once
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter have no language and go."""
    trees = language.learn(docs.select("doc_id", "lang", "text"))
    told = language.identify(docs, trees)
    return told.where("lang_pred <> 'und'").select(*docs.columns)


@few_at_once
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    kept = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


@few_at_once
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that an earlier document or place has go; documents of which nothing is left go too."""
    return suffixes.kept_texts(docs, suffixes.find_repeats(docs.select("doc_id", "text")))


@few_at_once
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Rows with one doc_id are told apart by source and text; rows that agree in these have one count each.
    """
    key = F.sha2(F.to_json(F.struct("doc_id", "source", "text")), 256)
    taken = mixing.mix(docs.select(key.alias("doc_id"), "source", "text")).groupBy("doc_id").agg(F.sort_array(F.collect_list("copies")).alias("_copies"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    both = docs.withColumn("_key", key).join(taken.withColumnRenamed("doc_id", "_key"), "_key").withColumn("_nth", nth)
    times = F.element_at("_copies", F.col("_nth"))
    return both.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


@few_at_once
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the taken documents with their sequence and offset."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("suffix_dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
