"""Vectors of records from names, sounds and a caller's embeddings.

Sparse streams are hashed into a fixed number of dimensions before they are reduced, which bounds every matrix. Records
without an embedding column get hashed word vectors in its place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tether.config import Config
from tether.functions.phonetic import phonetic_tokens
from tether.functions.vectors import balance_streams, l2_normalize, mean_energies
from tether.operators.ngram import counts, idf, postings
from tether.operators.reduction import Projection, pca, truncated_svd
from tether.runtime.scratch import Scratch

DIMENSIONS = 256
WORD_DIMENSIONS = 64


def hashed(rows: DataFrame, key: str, term: str, weight: str, dims: int) -> DataFrame:
    """``<key>, vec`` where each term adds its weight, with a sign from its hash, to one of ``dims`` places."""
    h = F.xxhash64(term)
    sign = F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, F.col(weight)).otherwise(-F.col(weight))
    cells = rows.groupBy(key, F.pmod(h, F.lit(dims)).cast("int").alias("i")).agg(F.sum(sign).alias("x"))
    m = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


@dataclass(frozen=True)
class Encoders:
    """Fitted parts: the n-gram table, the words kept, the reductions of both sparse streams and all streams' energies."""

    grams: DataFrame
    words: DataFrame
    reductions: dict[str, tuple[Projection, Projection]]
    energies: dict[str, float]

    def save(self, path: str) -> None:
        """Tables for grams and words, one of the reductions' matrices (row by row) and one of the energies."""
        spark = self.grams.sparkSession
        self.grams.write.mode("overwrite").parquet(f"{path}/grams")
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        steps = [(name, k, p.mean.tolist(), p.axes.ravel().tolist(), p.values.tolist()) for name, both in self.reductions.items() for k, p in enumerate(both)]
        spark.createDataFrame(steps, "stream string, step int, mean array<double>, axes array<double>, sizes array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/reductions")
        spark.createDataFrame(list(self.energies.items()), "stream string, energy double").coalesce(1).write.mode("overwrite").parquet(f"{path}/energies")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoders:
        reductions: dict[str, tuple[Projection, ...]] = {}
        for r in spark.read.parquet(f"{path}/reductions").orderBy("stream", "step").collect():
            mean = np.array(r["mean"])
            p = Projection(mean, np.array(r["axes"]).reshape(len(mean), -1), np.array(r["sizes"]))
            reductions[r["stream"]] = (*reductions.get(r["stream"], ()), p)
        energies = {r["stream"]: r["energy"] for r in spark.read.parquet(f"{path}/energies").collect()}
        return cls(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/words"), reductions, energies)


def _text(df: DataFrame, cfg: Config) -> DataFrame:
    with_address = cfg.modeling.use_address_in_encoding and "addr_normalized_key" in df.columns
    t = F.concat_ws(" ", "normalized_text", "addr_normalized_key") if with_address else F.col("normalized_text")
    return df.select("rec_id", F.trim(t).alias("s"))


def _words(df: DataFrame, cfg: Config) -> DataFrame:
    t = df.select("rec_id", phonetic_tokens(F.col("normalized_text"), cfg.modeling.phonetic_max_words).alias("t"))
    return t.select("rec_id", F.explode(F.array_distinct(F.split("t", " "))).alias("term"))


def _streams(df: DataFrame, cfg: Config, grams: DataFrame, words: DataFrame, dims: int) -> dict[str, DataFrame]:
    t = _text(df, cfg)
    p = postings(t.select("s").distinct(), table=grams, sublinear=cfg.modeling.tfidf_params["sublinear_tf"])
    a = t.join(hashed(p, "s", "gram", "w", dims), "s").select("rec_id", "vec")
    w = _words(df, cfg).join(words, "term", "left_semi").withColumn("one", F.lit(1.0))
    return {"tfidf": a, "phonetic": hashed(w, "rec_id", "term", "one", dims)}


def fit(df: DataFrame, cfg: Config, dims: int = DIMENSIONS, semantic: str | None = None) -> Encoders:
    """Learns from ``df(rec_id, normalized_text, ...)`` which grams and words count and how streams are reduced and scaled."""
    m = cfg.modeling
    if not m.encoders:
        raise RuntimeError("no encoders are configured")
    t = _text(df, cfg).select("s").distinct()
    table = idf(t, min_df=m.tfidf_params["min_df"])
    # the grams with most occurrences over all texts
    top = counts(t).groupBy("gram").agg(F.sum("tf").alias("all")).orderBy(F.desc("all"), "gram").limit(m.tfidf_params["max_features"]).select("gram")
    grams = table.join(top, "gram", "left_semi")
    words = _words(df, cfg).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(m.phonetic_params["max_features"]).select("term")
    reductions = {}
    for name, rows in _streams(df, cfg, grams, words, dims).items():
        svd = truncated_svd(rows, min(dims, getattr(m, f"{name}_svd_params")["n_components"]))
        reductions[name] = (svd, pca(svd.apply(rows), min(dims, getattr(m, f"{name}_pca_params")["n_components"])))
    scratch = Scratch(df.sparkSession)
    grams, words = scratch.save(grams, "grams"), scratch.save(words, "words")
    side = _side_by_side(df, Encoders(grams, words, reductions, {}), cfg, dims, semantic)
    return Encoders(grams, words, reductions, mean_energies(side, side.columns[1:]))


def _side_by_side(df: DataFrame, enc: Encoders, cfg: Config, dims: int, semantic: str | None) -> DataFrame:
    """``rec_id, semantic, tfidf, phonetic``; a stream in which a record has nothing is all zeros."""
    out = df.select("rec_id", *([F.col(semantic).cast("array<double>").alias("semantic")] if semantic else []))
    if not semantic:
        w = df.select("rec_id", F.explode(F.array_distinct(F.split("normalized_text", " "))).alias("term")).withColumn("one", F.lit(1.0))
        out = out.join(hashed(w, "rec_id", "term", "one", WORD_DIMENSIONS).withColumnRenamed("vec", "semantic"), "rec_id", "left")
        out = out.withColumn("semantic", F.coalesce("semantic", F.array_repeat(F.lit(0.0), WORD_DIMENSIONS)))
    for name, rows in _streams(df, cfg, enc.grams, enc.words, dims).items():
        svd, comp = enc.reductions[name]
        out = out.join(comp.apply(svd.apply(rows)).withColumnRenamed("vec", name), "rec_id", "left")
        zero = F.array_repeat(F.lit(0.0), comp.axes.shape[1])
        out = out.withColumn(name, F.coalesce(name, zero))
    return out


def encode(df: DataFrame, enc: Encoders, cfg: Config, dims: int = DIMENSIONS, semantic: str | None = None) -> DataFrame:
    """``id, vec`` of each record: the balanced streams side by side, of unit length.

    ``semantic`` names a column with a caller's embedding; without it, hashed words of the name stand in. Streams are
    scaled by the energies of the rows fitted on, so a record's vector does not depend on the others given with it.
    """
    out = _side_by_side(df, enc, cfg, dims, semantic)
    wanted = {k: p for k, p in cfg.modeling.stream_proportions.items() if k in cfg.modeling.encoders}
    balanced = balance_streams(out, wanted, cfg.modeling.epsilon, enc.energies)
    return balanced.select(F.col("rec_id").alias("id"), l2_normalize(F.concat(*wanted)).alias("vec"))
