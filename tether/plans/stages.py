"""Stages of record linkage, each from DataFrame to DataFrame.

Rows have ``rec_id``, ``normalized_text``, the five address parts, ``addr_normalized_key``, and from clustering on
``cluster`` (-1: none) and ``cluster_probability``. Ties are settled by value, never by row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tether.config import Config
from tether.functions.address import PARTS, address_key, completeness, parse_address, states_agree
from tether.functions.text import normalize_name, size_factor, squeeze, text
from tether.operators.graph import connected_components
from tether.operators.ngram import both_alike, pair_similarities, pair_similarity, postings, similarity_join
from tether.runtime.scratch import Scratch

CFG = Config()
KEY = "addr_normalized_key"


def normalize(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    return df.withColumn("normalized_text", normalize_name(F.col(cfg.columns.entity_col), cfg.normalization))


def add_address_key(df: DataFrame) -> DataFrame:
    for p in PARTS:
        if p not in df.columns:
            df = df.withColumn(p, F.lit(""))
    return df.withColumn(KEY, address_key())


def best_address(df: DataFrame, by: str) -> DataFrame:
    """One row a group: its address with most completeness points, then rows, then the first key.

    A key that was consolidated can have rows with different parts; the most complete ones stand for it.
    """
    parts = F.struct((-completeness()).alias("lacks"), *[F.col(p) for p in PARTS])
    each = df.groupBy(by, KEY).agg(F.count("*").alias("freq"), F.min(parts).alias("p")).select(by, KEY, "freq", "p.*").drop("lacks")
    best = each.withColumn("score", completeness()).groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("freq")).alias("f"), KEY, *PARTS)).alias("b"))
    return best.select(by, F.col(f"b.{KEY}").alias(KEY), *[F.col(f"b.{p}").alias(p) for p in PARTS], (-F.col("b.f")).alias("freq"), (-F.col("b.s")).alias("score"))


def canonical_names(df: DataFrame, by: str, name: str = "normalized_text") -> DataFrame:
    """One row a group: the name that is most like the group's names, frequent and long.

    The score is (sum over names of cosine * share + own share) * min(ln(length + 1), 3.5), the cosines over the
    group's own n-gram weights. The sum is one product with the group's weighted mean row, so no pairs are made.
    """
    each = df.groupBy(by, F.col(name).alias("s")).agg(F.count("*").alias("c"))
    group = W.partitionBy(by)
    each = each.withColumn("f", F.col("c") / F.sum("c").over(group)).withColumn("kinds", F.count("*").over(group))
    several = each.where("kinds > 1")
    p = postings(several, by=(by,), min_df=1, sublinear=False).join(several.select(by, "s", "f"), [by, "s"])
    mean = F.sum(F.col("w") * F.col("f")).over(W.partitionBy(by, "gram"))
    like = p.withColumn("m", mean).groupBy(by, "s").agg(F.sum(F.col("w") * F.col("m")).alias("like"))
    scored = each.join(like, [by, "s"], "left")
    score = (F.coalesce("like", F.lit(0.0)) + F.col("f")) * F.least(F.log(F.length("s") + 1.0), F.lit(3.5))
    scored = scored.withColumn("score", F.round(score, 6))
    best = scored.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("n"), "s")).alias("b"))
    return best.select(by, F.col("b.s").alias("canonical_name"), (-F.col("b.n")).alias("score"))


def consolidate(df: DataFrame, ratio: float | None = None, key: str = KEY, cfg: Config = CFG) -> DataFrame:
    """``original, canonical`` of the address keys that a fuzzy group replaces by its best member."""
    ratio = (cfg.validation.address_fuzz_ratio if ratio is None else ratio) / 100.0
    pairs = similarity_join(df.select(F.col(key).alias("s")).distinct(), ratio)
    groups = connected_components(id_edges(pairs))
    names = key_ids(df.select(F.col(key).alias("s")).distinct())
    member = groups.join(names, F.col("vertex") == F.col("id")).select("component_id", F.col("s").alias(key))
    rows = df.join(member, key)
    best = best_address(rows, "component_id").select("component_id", F.col(KEY).alias("canonical"))
    return member.join(best, "component_id").where(F.col(key) != F.col("canonical")).select(F.col(key).alias("original"), "canonical")


def key_ids(strings: DataFrame) -> DataFrame:
    """A 64-bit id of each distinct string."""
    return strings.select("s", F.xxhash64("s").alias("id"))


def id_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"))


def consolidate_addresses(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    m = consolidate(df, cfg=cfg)
    return df.join(m, F.col(KEY) == F.col("original"), "left").withColumn(KEY, F.coalesce("canonical", KEY)).drop("original", "canonical")


def parse_addresses(df: DataFrame, cfg: Config = CFG, consolidated: bool = True) -> DataFrame:
    """Parses the joined address columns into parts, builds the key and consolidates it; without any, parts are ''."""
    if cfg.columns.address_cols:
        line = squeeze(F.concat_ws(" ", *[text(F.col(c)) for c in cfg.columns.address_cols]))
        df = parse_address(df, line)
    df = add_address_key(df)
    return consolidate_addresses(df, cfg) if consolidated else df


def names_by_address(df: DataFrame) -> DataFrame:
    """Records that share an address get one name."""
    many = df.groupBy(KEY).agg(F.countDistinct("normalized_text").alias("n")).where("n > 1").select(KEY)
    named = canonical_names(df.join(many, KEY, "left_semi"), KEY).select(KEY, "canonical_name")
    return df.join(named, KEY, "left").withColumn("normalized_text", F.coalesce("canonical_name", "normalized_text")).drop("canonical_name")


def profiles(df: DataFrame, by: str = "cluster") -> DataFrame:
    """``<by>, name, address, state, size, avg_probability`` of each cluster."""
    rows = df.where(F.col(by) != -1)
    stats = rows.groupBy(by).agg(F.count("normalized_text").alias("size"), F.avg("cluster_probability").alias("avg_probability"))
    names = canonical_names(rows, by).select(by, F.col("canonical_name").alias("name"))
    address = best_address(rows, by).select(by, F.col(KEY).alias("address"), F.col("addr_state").alias("state"))
    return names.join(address, by).join(stats, by)


def validate_members(df: DataFrame, prof: DataFrame, cfg: Config = CFG) -> DataFrame:
    """``df`` with ``name_sim, addr_sim, is_valid`` against its own cluster's profile."""
    v = cfg.validation
    p = prof.select("cluster", F.col("name").alias("p_name"), F.col("address").alias("p_address"), F.col("state").alias("p_state"))
    rows = df.join(p, "cluster", "left")
    rows = pair_similarities(rows, {"name_sim": ("normalized_text", "p_name"), "addr_sim": (KEY, "p_address")}, exact_is_one=True)
    ok = (F.round("name_sim", 6) >= v.name_fuzz_ratio / 100.0) & (F.round("addr_sim", 6) >= v.address_fuzz_ratio / 100.0) & (F.col("cluster") != -1)
    if v.enforce_state_boundaries:
        ok = ok & states_agree(F.col("addr_state"), F.col("p_state"), v.allow_neighboring_states)
    return rows.withColumn("is_valid", F.coalesce(ok, F.lit(False))).drop("p_name", "p_address", "p_state")


def similar_to(left: DataFrame, right: DataFrame, ratio: float, table: DataFrame | None = None) -> DataFrame:
    """(a, b, sim) of strings of two tables whose cosine is at least the ratio; equal non-empty strings have 1.

    The weights are those of both tables' strings, or of a corpus's ``table`` from ``idf``.
    """
    corpus = left.select("s").union(right.select("s")).distinct()
    both = Scratch(left.sparkSession).save(similarity_join(corpus, ratio, strict=False, table=table), "similar")
    same = left.select("s").intersect(right.select("s")).where("s <> ''").select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(1.0).alias("similarity"))
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(same)


def alike(df: DataFrame, col: str, percent: float) -> DataFrame:
    """``a, b`` of the values of a column whose cosine is above the percentage, both ways round, and of each with itself."""
    s = df.select(F.col(col).alias("s")).distinct()
    p = Scratch(df.sparkSession).save(similarity_join(s, percent / 100.0).select("a", "b"), "alike")
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(s.select(F.col("s").alias("a"), F.col("s").alias("b")))


def best_clusters(rows: DataFrame, prof: DataFrame, cfg: Config = CFG) -> DataFrame:
    """``rec_id, best_cluster, best_score, best_prob`` of the best cluster that each row may join, if any.

    Instead of all pairs of rows and profiles, only names that a similarity join finds are paired; then address and
    state are held against the thresholds. Equal scores go to the smaller cluster.
    """
    v = cfg.validation
    names = similar_to(rows.select(F.col("normalized_text").alias("s")), prof.select(F.col("name").alias("s")), v.name_fuzz_ratio / 100.0)
    keys = similar_to(rows.select(F.col(KEY).alias("s")), prof.select(F.col("address").alias("s")), v.address_fuzz_ratio / 100.0)
    left = rows.select("rec_id", F.col("normalized_text").alias("a"), F.col(KEY).alias("c"), "addr_state")
    right = prof.withColumnsRenamed({"name": "b", "address": "d"})
    pairs = both_alike(left, right, names.withColumnRenamed("similarity", "name_sim"), keys.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("similarity").alias("addr_sim")))
    if v.enforce_state_boundaries:
        pairs = pairs.where(states_agree(F.col("addr_state"), F.col("state"), v.allow_neighboring_states))
    w = v.reassignment_scoring_weights
    score = w["name_similarity"] * F.col("name_sim") + w["address_similarity"] * F.col("addr_sim") + w["cluster_size"] * size_factor(F.col("size")) + w["cluster_probability"] * F.col("avg_probability")
    scored = pairs.withColumn("score", F.round(score, 6))
    best = scored.groupBy("rec_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "cluster", "avg_probability")).alias("b"))
    return best.select("rec_id", F.col("b.cluster").alias("best_cluster"), (-F.col("b.n")).alias("best_score"), F.col("b.avg_probability").alias("best_prob"))


def reassign(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    """Rows that do not fit their cluster, and noise, go to the best cluster that takes them, or become noise."""
    scratch = Scratch(df.sparkSession)
    prof = scratch.save(profiles(df), "profiles")
    checked = scratch.save(validate_members(df, prof, cfg), "checked")
    best = best_clusters(checked.where("not is_valid"), prof, cfg)
    out = checked.join(best, "rec_id", "left")
    moved = ~F.col("is_valid")
    prob = F.when(moved, F.coalesce(F.col("best_score") * F.col("best_prob"), F.lit(0.0))).otherwise(F.col("cluster_probability"))
    out = out.withColumn("cluster_probability", prob).withColumn("cluster", F.when(moved, F.coalesce("best_cluster", F.lit(-1))).otherwise(F.col("cluster")).cast("bigint"))
    return out.drop("name_sim", "addr_sim", "is_valid", "best_cluster", "best_score", "best_prob")


def evict(df: DataFrame, prof: DataFrame, col: str = "cluster", cfg: Config = CFG, table: DataFrame | None = None) -> DataFrame:
    """Rows whose state or address is at odds with their cluster's become noise with probability 0.

    Addresses are compared with the weights of those given, or of a corpus's ``table`` from ``idf``.
    """
    v = cfg.validation
    p = prof.select(F.col("cluster").alias(col), F.col("address").alias("p_address"), F.col("state").alias("p_state"))
    rows = pair_similarity(df.join(p, col, "left"), KEY, "p_address", out="_sim", exact_is_one=True, table=table)
    out = F.coalesce((F.round("_sim", 6) < v.address_fuzz_ratio / 100.0) & F.col("p_address").isNotNull() & F.col(KEY).isNotNull(), F.lit(False))
    if v.enforce_state_boundaries:
        out = out | ~states_agree(F.col("addr_state"), F.col("p_state"), v.allow_neighboring_states)
    out = out & (F.col(col) != -1)
    rows = rows.withColumn("_out", out)
    rows = rows.withColumn("cluster_probability", F.when(F.col("_out"), 0.0).otherwise(F.col("cluster_probability")))
    return rows.withColumn(col, F.when(F.col("_out"), F.lit(-1)).otherwise(F.col(col)).cast("bigint")).drop("_out", "_sim", "p_address", "p_state")


def merge_by_address(prof: DataFrame) -> DataFrame:
    """``loser, winner`` of clusters with one address; the largest wins, then the smallest id."""
    w = F.min(F.struct((-F.col("size")).alias("n"), "cluster")).over(W.partitionBy("address"))["cluster"]
    return prof.withColumn("winner", w).where("cluster <> winner").select(F.col("cluster").alias("loser"), "winner")


def merge_by_similarity(prof: DataFrame, cfg: Config = CFG) -> DataFrame:
    """``loser, winner`` of clusters whose names and addresses are both alike, over whole components."""
    v = cfg.validation
    x = prof.select(F.col("cluster").alias("src"), F.col("name").alias("a"), F.col("address").alias("c"))
    y = prof.select(F.col("cluster").alias("dst"), F.col("name").alias("b"), F.col("address").alias("d"))
    keys = alike(prof, "address", v.address_fuzz_ratio).withColumnsRenamed({"a": "c", "b": "d"})
    pairs = both_alike(x, y, alike(prof, "name", v.name_fuzz_ratio), keys)
    groups = connected_components(pairs.where("src < dst").select("src", "dst"))
    return _largest(groups, prof)


def _largest(groups: DataFrame, prof: DataFrame) -> DataFrame:
    sized = groups.join(prof.select(F.col("cluster").alias("vertex"), "size"), "vertex")
    w = F.min(F.struct((-F.col("size")).alias("n"), "vertex")).over(W.partitionBy("component_id"))["vertex"]
    return sized.withColumn("winner", w).where("vertex <> winner").select(F.col("vertex").alias("loser"), "winner")


def remap(df: DataFrame, plan: DataFrame, col: str = "cluster") -> DataFrame:
    return df.join(plan, F.col(col) == F.col("loser"), "left").withColumn(col, F.coalesce("winner", col)).drop("loser", "winner")


def merge_similar_clusters(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    """Merges by address, then by similarity, and gives merged clusters one name and their commonest address."""
    scratch = Scratch(df.sparkSession)
    exact = scratch.save(merge_by_address(profiles(df)), "exact")
    once = scratch.save(remap(df, exact), "once")
    fuzzy = scratch.save(merge_by_similarity(scratch.save(profiles(once), "profiles"), cfg), "fuzzy")
    twice = scratch.save(remap(once, fuzzy), "twice")
    winners = exact.select(F.col("winner").alias("loser")).join(fuzzy, "loser", "left").select(F.coalesce("winner", "loser").alias("cluster")).union(fuzzy.select("winner")).distinct()
    rows = twice.join(winners, "cluster", "left_semi")
    names = canonical_names(rows, "cluster").select("cluster", F.col("canonical_name").alias("_name"))
    common = rows.groupBy("cluster", KEY).agg(F.count("*").alias("n")).groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), KEY)).alias("b"))
    both = names.join(common.select("cluster", F.col(f"b.{KEY}").alias("_key")), "cluster")
    out = twice.join(both, "cluster", "left").withColumn("normalized_text", F.coalesce("_name", "normalized_text"))
    return out.withColumn(KEY, F.coalesce("_key", KEY)).drop("_name", "_key")


def consolidate_identical(df: DataFrame, col: str = "cluster") -> DataFrame:
    """Clusters that share a (name, address) become one: the largest, then the most probable, then the smallest id."""
    rows = df.where(F.col(col) != -1)
    hub = F.min(col).over(W.partitionBy("normalized_text", F.coalesce(KEY, F.lit(""))))
    edges = rows.select(F.col(col).alias("src"), hub.alias("dst")).where("src <> dst").distinct()
    groups = connected_components(edges)
    stats = rows.groupBy(col).agg(F.count("*").alias("size"), F.avg("cluster_probability").alias("p")).withColumnRenamed(col, "vertex")
    w = F.min(F.struct((-F.col("size")).alias("n"), (-F.round("p", 9)).alias("p"), "vertex")).over(W.partitionBy("component_id"))["vertex"]
    plan = groups.join(stats, "vertex").withColumn("winner", w).where("vertex <> winner").select(F.col("vertex").alias("loser"), "winner")
    return remap(df, plan, col)


def enrich(df: DataFrame) -> DataFrame:
    """Rows without a street take that of their cluster's best address if city, state and zip are equal."""
    best = best_address(df.where("cluster <> -1"), "cluster").select("cluster", *[F.col(p).alias(f"c_{p}") for p in PARTS])
    rows = df.join(best, "cluster", "left")
    same = [F.col(p) == F.col(f"c_{p}") for p in PARTS[2:]]
    lacks = F.coalesce(F.col("addr_street_name"), F.lit("")) == ""
    yes = F.coalesce((F.col("cluster") != -1) & lacks & same[0] & same[1] & same[2], F.lit(False))
    rows = rows.withColumn("address_was_enriched", yes)
    for p in PARTS[:2]:
        rows = rows.withColumn(p, F.when(F.col("address_was_enriched"), F.col(f"c_{p}")).otherwise(F.col(p)))
    rows = rows.withColumn(KEY, F.when(F.col("address_was_enriched"), address_key()).otherwise(F.col(KEY)))
    return rows.drop(*[f"c_{p}" for p in PARTS])


def _renumber(df: DataFrame, groups: list[str], conflict: str) -> DataFrame:
    """Rows in conflict get new cluster ids, one for each tuple of ``groups``, from the largest id + 1 on."""
    tuples = df.where(conflict).select(*groups).distinct()
    ids = tuples.withColumn("_new", F.row_number().over(W.orderBy(*[F.col(g).asc_nulls_first() for g in groups])).cast("bigint"))
    top = df.agg(F.coalesce(F.max("final_cluster"), F.lit(-1)).alias("_top"))
    named = ids.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], "_new")
    on = F.expr(conflict)
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = df.join(named, on, "left").crossJoin(F.broadcast(top))  # one row
    return out.withColumn("final_cluster", F.coalesce(F.col("_top") + F.col("_new"), F.col("final_cluster"))).drop("_top", "_new", *[f"_g{k}" for k in range(len(groups))])


def split_by_state(df: DataFrame) -> DataFrame:
    """Clusters with several states become one for each state."""
    states = df.where("final_cluster <> -1").groupBy("final_cluster").agg(F.countDistinct("addr_state").alias("n")).where("n > 1").select("final_cluster", F.lit(True).alias("_split"))
    rows = df.join(states, "final_cluster", "left")
    return _renumber(rows, ["final_cluster", "addr_state"], "coalesce(_split, false)").drop("_split")


def split_by_street_range(df: DataFrame, threshold: int = CFG.validation.street_number_threshold) -> DataFrame:
    """Rows of one cluster, street and zip become one cluster for each number where the numbers lie far apart."""
    number = F.when(F.col("addr_street_number").rlike(r"^[0-9]+(\.[0-9]+)?$"), F.expr("try_cast(addr_street_number as double)"))
    rows = df.withColumn("_n", number)
    keys = ["final_cluster", "addr_street_name", "addr_zip"]
    wide = rows.where("final_cluster <> -1").groupBy(*keys).agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"), F.countDistinct("_n").alias("k"))
    wide = wide.where((F.col("k") > 1) & (F.col("hi") - F.col("lo") > threshold)).select(*keys, F.lit(True).alias("_split"))
    rows = rows.join(wide, keys, "left")
    return _renumber(rows, [*keys, "addr_street_number"], "coalesce(_split, false)").drop("_split", "_n")


def refine(df: DataFrame, cfg: Config = CFG) -> DataFrame:
    out = enrich(df).withColumn("final_cluster", F.col("cluster"))
    if cfg.validation.enforce_state_boundaries:
        out = split_by_state(out)
    return split_by_street_range(out, cfg.validation.street_number_threshold)


def canonical_map(df: DataFrame) -> DataFrame:
    """One row a final cluster: name, best address, mean probability; names at several addresses are numbered.

    ValueError-worthy duplicates (one name and address in two clusters) are left for ``duplicate_names`` to find.
    """
    rows = df.where("final_cluster <> -1")
    names = canonical_names(rows, "final_cluster").select("final_cluster", "canonical_name")
    address = best_address(rows, "final_cluster").select("final_cluster", KEY, *PARTS)
    prob = rows.groupBy("final_cluster").agg(F.avg("cluster_probability").alias("avg_cluster_prob"))
    m = names.join(address, "final_cluster").join(prob, "final_cluster")
    by = W.partitionBy("canonical_name").orderBy(KEY)
    m = m.withColumn("_k", F.dense_rank().over(by)).withColumn("_m", F.max("_k").over(W.partitionBy("canonical_name")))
    name = F.when(F.col("_m") > 1, F.concat_ws(" - ", "canonical_name", F.col("_k").cast("string"))).otherwise(F.col("canonical_name"))
    return m.withColumn("canonical_name", name).drop("_k", "_m")


def duplicate_names(cmap: DataFrame) -> DataFrame:
    return cmap.groupBy("canonical_name").agg(F.count("*").alias("clusters")).where("clusters > 1")
