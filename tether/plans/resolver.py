"""Fitting, applying, saving and loading a record-linkage model."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tether.config import Config
from tether.operators import clustering, encode, neighbors
from tether.operators.graph import connected_components
from tether.operators.ngram import both_alike, idf
from tether.plans import score, stages
from tether.runtime.scratch import Scratch

log = logging.getLogger(__name__)
KEY = stages.KEY


#: Settings that are accepted for the sake of configurations made elsewhere, and read by nothing here.
NO_EFFECT = (
    "modeling.sparse_reducers", "modeling.feature_variance_threshold", "modeling.semantic_batch_size", "modeling.cosine_consensus_batch_size",
    "modeling.semantic_model", "modeling.profile_comparison_max_pairs_per_chunk", "modeling.umap_n_runs", "modeling.umap_params",
    "modeling.umap_param_ranges", "modeling.similarity_tfidf", "validation.validate_cluster_batch_size", "validation.empty_state_is_null", "random_state",
)


def without_effect(cfg: Config) -> list[str]:
    """The settings that differ from their defaults although nothing reads them."""

    def value(c: Config, name: str):
        for part in name.split("."):
            c = getattr(c, part, None)
        return c

    return [n for n in NO_EFFECT if value(cfg, n) != value(Config(), n)]


def block_clusters(df: DataFrame, cfg: Config) -> DataFrame:
    """Clusters without vectors: records are linked whose names are alike and whose addresses are alike.

    Works on distinct (name, address) pairs. The cluster id is the smallest rec_id, and the probability 1 for clusters
    of several records; single records are noise.
    """
    v = cfg.validation
    kinds = df.groupBy("normalized_text", KEY).agg(F.min("rec_id").alias("node"), F.count("*").alias("n"))
    x = kinds.select(F.col("normalized_text").alias("a"), F.col(KEY).alias("c"), F.col("node").alias("src"))
    y = kinds.select(F.col("normalized_text").alias("b"), F.col(KEY).alias("d"), F.col("node").alias("dst"))
    keys = stages.alike(kinds, KEY, v.address_fuzz_ratio).withColumnsRenamed({"a": "c", "b": "d"})
    edges = both_alike(x, y, stages.alike(kinds, "normalized_text", v.name_fuzz_ratio), keys).where("src < dst").select("src", "dst")
    groups = connected_components(edges)
    found = kinds.join(groups, F.col("node") == F.col("vertex"), "left").withColumn("g", F.coalesce("component_id", "node"))
    found = found.withColumn("all", F.sum("n").over(W.partitionBy("g"))).select("normalized_text", KEY, F.when(F.col("all") > 1, F.col("g")).otherwise(F.lit(-1)).cast("bigint").alias("cluster"))
    out = df.join(found, ["normalized_text", KEY])
    return out.withColumn("cluster_probability", F.when(F.col("cluster") != -1, 1.0).otherwise(0.0))


def vector_clusters(df: DataFrame, vectors: DataFrame, cfg: Config, scratch: Scratch) -> DataFrame:
    """Clusters by HDBSCAN, and by communities of shared neighbours that rescue its noise."""
    m = cfg.modeling
    h = m.hdbscan_params
    hdb = scratch.save(clustering.hdbscan(vectors, h["min_cluster_size"], h["min_samples"], h["cluster_selection_epsilon"], h["alpha"], m.nearest_neighbors_params["n_neighbors"], scratch), "hdb")
    s = m.snn_clustering_params
    graph = scratch.save(neighbors.mutual_ranks(vectors, s["k_neighbors"]), "snn")
    found = clustering.louvain(graph, s["louvain_resolution"], scratch=scratch)
    labels = vectors.select("id").join(found.withColumnRenamed("vertex", "id"), "id", "left").select("id", F.coalesce("community", F.lit(-1)).alias("label"))
    a = m.noise_attachment_params
    near = neighbors.nearest(vectors, a["k_neighbors"])
    labels = neighbors.attach_noise(near, labels, a["attachment_similarity_threshold"], a["min_matching_neighbors"], a["attachment_ratio_threshold"])
    c = m.cluster_merging_params
    labels = scratch.save(labels, "labels")
    pairs = neighbors.merge_candidates(vectors, labels, c["centroid_similarity_threshold"], c["merge_median_threshold"], c["merge_max_threshold"], c["merge_sample_size"])
    joined = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    labels = labels.join(joined, labels["label"] == joined["vertex"], "left").select("id", F.coalesce("component_id", "label").alias("snn"))
    e = m.ensemble_params
    both = hdb.join(labels, "id").select("id", F.col("cluster").alias("hdb"), "snn", F.col("cluster_probability").alias("probability"))
    final = neighbors.ensemble_labels(both, e["purity_min"], e["min_overlap"], e["allow_new_snn_clusters"], e["min_newcluster_size"], e["default_rescue_conf"])
    return df.join(final.withColumnRenamed("id", "rec_id"), "rec_id")


@dataclass
class Resolver:
    """``fit`` learns a model from records with ``rec_id`` and the configured columns.

    ``method`` is ``block`` (names and addresses alike) or ``vector`` (encoders, HDBSCAN and shared neighbours).
    ``parsed`` says that the five address parts are given and need no parsing.
    """

    config: Config = Config()
    method: str = "block"
    parsed: bool = False
    semantic_col: str | None = None

    def _prepare(self, df: DataFrame, consolidated: bool = True) -> DataFrame:
        df = stages.normalize(df, self.config)
        if not self.parsed:
            return stages.parse_addresses(df, self.config, consolidated)
        df = stages.add_address_key(df)
        return stages.consolidate_addresses(df, self.config) if consolidated else df

    def fit(self, df: DataFrame) -> ResolverModel:
        spark, cfg = df.sparkSession, self.config
        log.setLevel(cfg.output.log_level)
        for name in without_effect(cfg):
            log.warning("the setting %s has no effect", name)
        scratch = Scratch(spark)
        rows = scratch.save(stages.names_by_address(scratch.save(self._prepare(df), "prepared")), "named")
        enc = known = None
        if self.method == "vector":
            enc = encode.fit(rows, cfg, semantic=self.semantic_col)
            vectors = scratch.save(encode.encode(rows, enc, cfg, semantic=self.semantic_col), "vectors")
            rows = vector_clusters(rows, vectors, cfg, scratch)
        else:
            rows = block_clusters(rows, cfg)
        rows = scratch.save(stages.reassign(scratch.save(rows, "clustered"), cfg), "valid")
        rows = scratch.save(stages.merge_similar_clusters(rows, cfg), "merged")
        rows = scratch.save(stages.consolidate_identical(rows), "identical")
        self._check(score.identity_violations(rows), "a name and address in several clusters")
        rows = scratch.save(stages.refine(rows, cfg), "refined")
        rows = scratch.save(stages.consolidate_identical(rows, "final_cluster"), "final")
        cmap = scratch.save(stages.canonical_map(rows), "map")
        if stages.duplicate_names(cmap).limit(1).count():
            raise ValueError("the canonical map has one name for several clusters")
        members = scratch.save(rows.select("normalized_text", KEY, "addr_state", "final_cluster").where("final_cluster <> -1").distinct(), "members")
        resolved = score.flag(score.score(score.apply_map(rows, cmap, cfg), cfg), cfg)
        if cfg.output.split_address_components:
            resolved = score.split_canonical_address(resolved)
        weights = [scratch.save(idf(members.select(F.col(c).alias("s"))), "idf") for c in ("normalized_text", KEY)]
        if self.method == "vector":
            placed = rows.where("final_cluster <> -1").select(F.col("rec_id").alias("id"), "final_cluster")
            known = scratch.save(vectors.join(placed, "id"), "known")
        return ResolverModel(self, cmap, members, *weights, scratch.save(resolved, "resolved"), enc, known)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).resolved

    def _check(self, bad: DataFrame, what: str) -> None:
        n = bad.count()
        if n:
            log.warning("%d cases of %s", n, what)


@dataclass
class ResolverModel:
    resolver: Resolver
    canonical_map: DataFrame
    members: DataFrame
    name_idf: DataFrame
    key_idf: DataFrame
    resolved: DataFrame | None = None
    encoders: encode.Encoders | None = None
    vectors: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """New records with the cluster of the most similar known record, or as new entities.

        With ``method="block"`` a record joins the cluster of a member whose name and address are alike and whose state
        agrees; the most similar one counts, then the smallest cluster. With ``method="vector"`` it joins the cluster of
        the nearest known vector (then of the smallest id) if their cosine reaches ``attachment_similarity_threshold``,
        and leaves it again where address or state is at odds with the cluster's. Similarities use the weights and
        scales kept in the model, and addresses are taken as parsed, so what a record gets does not depend on the
        others of its batch.
        """
        cfg = self.resolver.config
        rows = self.resolver._prepare(df, consolidated=False)
        best = self._nearest(rows) if self.resolver.method == "vector" else self._most_alike(rows)
        out = rows.join(best, "rec_id", "left").withColumn("final_cluster", F.coalesce("final_cluster", F.lit(-1)))
        prob = self.canonical_map.select("final_cluster", F.col("avg_cluster_prob").alias("cluster_probability"))
        out = out.join(prob, "final_cluster", "left").withColumn("cluster_probability", F.coalesce("cluster_probability", F.lit(0.0)))
        if self.resolver.method == "vector":
            prof = self.canonical_map.select(F.col("final_cluster").alias("cluster"), F.col(KEY).alias("address"), F.col("addr_state").alias("state"))
            out = stages.evict(out, prof, "final_cluster", cfg, self.key_idf)
        return score.apply_map(out, self.canonical_map, cfg).withColumn("is_new_entity", F.col("final_cluster") == -1)

    def _nearest(self, rows: DataFrame) -> DataFrame:
        """``rec_id, final_cluster`` by vectors; records near no known one are left out."""
        cfg = self.resolver.config
        asked = Scratch(rows.sparkSession).save(encode.encode(rows, self.encoders, cfg, semantic=self.resolver.semantic_col), "asked")
        # a new record's id may be a known one's too; they are different rows
        near = neighbors.nearest(self.vectors.select("id", "vec"), 1, asked, with_self=True)
        near = near.where(F.col("similarity") >= cfg.modeling.noise_attachment_params["attachment_similarity_threshold"])
        return near.join(self.vectors.select(F.col("id").alias("dst"), "final_cluster"), "dst").select(F.col("src").alias("rec_id"), "final_cluster")

    def _most_alike(self, rows: DataFrame) -> DataFrame:
        """``rec_id, final_cluster`` by names and addresses; records like no member are left out."""
        cfg = self.resolver.config
        v = cfg.validation
        names = stages.similar_to(rows.select(F.col("normalized_text").alias("s")), self.members.select(F.col("normalized_text").alias("s")), v.name_fuzz_ratio / 100.0, self.name_idf)
        keys = stages.similar_to(rows.select(F.col(KEY).alias("s")), self.members.select(F.col(KEY).alias("s")), v.address_fuzz_ratio / 100.0, self.key_idf)
        m = self.members.select(F.col("normalized_text").alias("b"), F.col(KEY).alias("d"), F.col("addr_state").alias("m_state"), "final_cluster")
        left = rows.select("rec_id", F.col("normalized_text").alias("a"), F.col(KEY).alias("c"), "addr_state")
        pairs = both_alike(left, m, names.withColumnRenamed("similarity", "s1"), keys.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("similarity").alias("s2")))
        if v.enforce_state_boundaries:
            pairs = pairs.where(stages.states_agree(F.col("addr_state"), F.col("m_state"), v.allow_neighboring_states))
        return pairs.groupBy("rec_id").agg(F.min(F.struct((-(F.col("s1") + F.col("s2"))).alias("n"), "final_cluster")).alias("b")).select("rec_id", F.col("b.final_cluster").alias("final_cluster"))

    def review(self) -> DataFrame:
        if self.resolved is None:
            raise RuntimeError("a loaded model has no resolved records")
        return score.review_table(self.resolved, self.resolver.config)

    def report(self) -> DataFrame:
        if self.resolved is None:
            raise RuntimeError("a loaded model has no resolved records")
        return score.report(self.resolved, self.resolver.config)

    def save(self, path: str) -> None:
        """A folder with the settings as one JSON row and the tables as Parquet."""
        spark = self.canonical_map.sparkSession
        r = self.resolver
        spark.createDataFrame([(r.config.to_json(), r.method, r.parsed, r.semantic_col)], "config string, method string, parsed boolean, semantic_col string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
        self.canonical_map.write.mode("overwrite").parquet(f"{path}/canonical_map")
        for name in ("members", "name_idf", "key_idf"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        if self.encoders is not None:
            self.encoders.save(f"{path}/encoders")
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ResolverModel:
        r = spark.read.schema("config string, method string, parsed boolean, semantic_col string").json(f"{path}/settings").first()
        resolver = Resolver(Config.from_json(r["config"]), r["method"], r["parsed"], r["semantic_col"])
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("canonical_map", "members", "name_idf", "key_idf")]
        if resolver.method != "vector":
            return cls(resolver, *tables)
        return cls(resolver, *tables, None, encode.Encoders.load(spark, f"{path}/encoders"), spark.read.parquet(f"{path}/vectors"))
