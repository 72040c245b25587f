"""Queries of the token operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tether.llm import editcount, packing
from tether.llm.queries_tables import documents

#: Characters removed and text put in by the edits that op10 makes in every document.
EDITS = ((0, " inserted words"), (7, ""), (3, "x"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def planned_edits(doc_id: Column, text: Column) -> Column:
    """One edit of each kind, at places that follow from doc_id and the text's length."""

    def one(k: int, gone: int, put: str) -> Column:
        spot = F.crc32(F.concat_ws(":", doc_id.cast("string"), F.lit(str(k))).cast("binary")) % (F.coalesce(F.length(text), F.lit(0)) + 1)
        return F.struct(spot.cast("int").alias("pos"), F.lit(gone).alias("gone"), F.lit(put).alias("put"))

    return F.array(*[one(k, gone, put) for k, (gone, put) in enumerate(EDITS)])


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return editcount.recount(docs.withColumn("edits", planned_edits(F.col("doc_id"), F.col("text"))))
