"""Final results: canonical names, confidence, review flags, reports and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.config import Config
from tether.functions.address import PARTS, parse_address
from tether.functions.text import size_factor, squeeze, text, title_case
from tether.operators.ngram import pair_similarities
from tether.runtime.scratch import Scratch

CFG = Config()
KEY = "addr_normalized_key"
CATEGORIES = ((0.5, "Low"), (0.7, "Medium"), (0.85, "High"), (1.0, "Very High"))


def apply_map(df: DataFrame, cmap: DataFrame, cfg: Config = CFG) -> DataFrame:
    """Adds canonical_name and canonical_address; rows without a cluster keep their own."""
    m = cmap.select("final_cluster", "canonical_name", F.col(KEY).alias("canonical_address"))
    out = df.join(m, "final_cluster", "left").withColumn("canonical_name", F.coalesce("canonical_name", "normalized_text"))
    out = out.withColumn("canonical_address", F.coalesce("canonical_address", KEY))
    return out.withColumn("canonical_name", title_case(F.col("canonical_name"))) if cfg.output.output_format == "proper" else out


def category(score):
    out = F.when(score <= CATEGORIES[0][0], CATEGORIES[0][1])
    for top, name in CATEGORIES[1:]:
        out = out.when(score <= top, name)
    return out


def combine(prob, name, address, cohesion, size, change, enriched, noise, w: dict):
    """The confidence from its parts: weighted sum, then the penalties; noise has half its name similarity."""
    base = prob * w["cluster_probability"] + name * w["name_similarity"] + address * w["address_confidence"] + cohesion * w["cohesion_score"] + size_factor(size) * w["cluster_size_factor"]
    base = F.when(change > 0.5, base * 0.9).otherwise(base)
    base = F.when(enriched, base * 0.95).otherwise(base)
    base = F.when((size <= 2) & (change > 0.7), base * 0.85).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(noise, name * 0.5).otherwise(base)))


def score(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    """Adds the similarities, cluster figures, confidence_score and confidence_category."""
    df = df.withColumn("_lower", F.lower("canonical_name")).withColumn("_entity", F.lower(text(F.col(cfg.columns.entity_col))))
    kinds = {"name_similarity": ("normalized_text", "_lower"), "address_confidence": (KEY, "canonical_address"), "_same": ("_entity", "_lower")}
    df = Scratch(df.sparkSession).save(pair_similarities(df, kinds, exact_is_one=True), "similar")
    metrics = df.where("final_cluster >= 0").groupBy("final_cluster").agg(
        F.count("normalized_text").alias("cluster_size"),
        F.avg("cluster_probability").alias("avg_cluster_prob"),
        F.coalesce(F.stddev_samp("name_similarity"), F.lit(0.0)).alias("name_variation"),
    )
    metrics = metrics.withColumn("cohesion_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("name_variation"))))
    df = df.join(metrics, "final_cluster", "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1))).withColumn("cohesion_score", F.coalesce("cohesion_score", F.lit(1.0)))
    df = df.withColumn("change_magnitude", F.round(1.0 - F.col("_same"), 6))
    enriched = F.coalesce(F.col("address_was_enriched"), F.lit(False)) if "address_was_enriched" in df.columns else F.lit(False)
    conf = combine(F.coalesce("cluster_probability", F.lit(0.0)), F.col("name_similarity"), F.col("address_confidence"), F.col("cohesion_score"), F.col("cluster_size"), F.col("change_magnitude"), enriched, F.col("final_cluster") == -1, cfg.scoring.weights)
    df = df.withColumn("confidence_score", F.round(conf, 6))
    return df.withColumn("confidence_category", category(F.col("confidence_score"))).drop("_lower", "_entity", "_same")


def flag(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    """Adds needs_review and review_reason (reasons in a fixed order, joined by commas, '' if none)."""
    if "confidence_score" not in df.columns:
        raise ValueError("score the records before they are flagged")
    c, change = F.col("confidence_score"), F.col("change_magnitude")
    enriched = F.coalesce(F.col("address_was_enriched"), F.lit(False)) if "address_was_enriched" in df.columns else F.lit(False)
    reasons = (
        ("low_confidence", c < cfg.output.review_confidence_threshold),
        ("drastic_change", change > 0.7),
        ("single_member_change", (F.col("cluster_size") == 1) & (change > 0.01)),
        ("enriched_low_conf", enriched & (c < 0.8)),
    )
    told = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in reasons])
    return df.withColumn("review_reason", told).withColumn("needs_review", F.col("review_reason") != "")


def review_table(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    """Distinct original and canonical names and addresses, sorted for review."""
    address = squeeze(F.concat_ws(" ", *[text(F.col(c)) for c in cfg.columns.address_cols]))
    rows = df.select(F.col(cfg.columns.entity_col).alias("original_name"), address.alias("original_address"), "canonical_name", "canonical_address").distinct()
    return rows.orderBy("canonical_name", "canonical_address", "original_name")


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column, as one row."""
    v = F.col(value).cast("double")
    q = [F.expr(f"percentile(cast({value} as double), {p})").alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *q, F.max(v).alias("max"))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.where("needs_review").select(F.explode(F.split("review_reason", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


def report(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    """``section, metric, value`` of the whole result."""
    entity = F.col(cfg.columns.entity_col)
    one = df.agg(
        F.count("*").cast("double").alias("summary.total_records"),
        F.countDistinct(entity).cast("double").alias("summary.unique_entities_before"),
        F.countDistinct("canonical_name").cast("double").alias("summary.unique_entities_after"),
        (1.0 - F.countDistinct("canonical_name") / F.greatest(F.countDistinct(entity), F.lit(1))).alias("summary.reduction_rate"),
        F.sum((F.lower(entity) != F.lower("canonical_name")).cast("double")).alias("summary.records_changed"),
        F.countDistinct(F.when(F.col("final_cluster") != -1, F.col("final_cluster"))).cast("double").alias("clustering.clusters_found"),
        F.sum((F.col("final_cluster") == -1).cast("double")).alias("clustering.unclustered_records"),
        F.sum(F.col("canonical_name").rlike(r" - \d+$").cast("double")).alias("clustering.chain_entities_found"),
        F.sum(F.col("address_was_enriched").cast("double")).alias("clustering.enriched_addresses"),
        F.sum(F.col("needs_review").cast("double")).alias("review.records_for_review"),
    )
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c.split(".")[0]).alias("section"), F.lit(c.split(".")[1]).alias("metric"), F.round(F.col(f"`{c}`"), 6).alias("value")) for c in one.columns])).alias("x")).select("x.*")
    sizes = df.where("final_cluster <> -1").groupBy("final_cluster").agg(F.count("*").alias("size"))
    parts = [long]
    for section, d in (("cluster_size", describe(sizes, "size")), ("confidence", describe(df, "confidence_score"))):
        parts.append(d.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in d.columns])).alias("x")).select("x.*"))
    parts.append(reason_counts(df).select(F.lit("review_reason").alias("section"), F.col("reason").alias("metric"), F.col("records").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_canonical_address(df: DataFrame) -> DataFrame:
    return parse_address(df, F.col("canonical_address"), tuple(p.replace("addr_", "canonical_") for p in PARTS))


def identity_violations(df: DataFrame, col: str = "cluster") -> DataFrame:
    """(name, address) pairs that occur in several clusters."""
    return df.where(F.col(col) != -1).groupBy("normalized_text", KEY).agg(F.countDistinct(col).alias("clusters")).where("clusters > 1")


def canonical_violations(df: DataFrame) -> DataFrame:
    """Canonical names with several addresses, a null counting as one."""
    n = F.countDistinct("canonical_address") + F.max(F.col("canonical_address").isNull().cast("int"))
    return df.groupBy("canonical_name").agg(n.cast("bigint").alias("addresses")).where("addresses > 1")
