import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tether.operators import clustering, neighbors, reduction
from tether.operators.graph import connected_components
from tether.operators.ngram import both_alike, pair_similarity, similarity_join
from tether.plans import score, stages


def test_similarity_needs_grams_of_two_strings(spark):
    df = spark.createDataFrame([("crystal clean", "crystal clean"), ("midwest waste", "midwest waste services")], "a string, b string")
    got = {r["a"]: round(r["similarity"], 6) for r in pair_similarity(df).collect()}
    assert got == {"crystal clean": 0.0, "midwest waste": 1.0}
    assert {r["a"]: r["similarity"] for r in pair_similarity(df, exact_is_one=True).collect()}["crystal clean"] == 1.0
    assert round(pair_similarity(df.where("a <> b"), min_df=1).first()["similarity"], 6) > 0.5


def test_both_alike_agrees_with_all_pairs(spark):
    # a name at many addresses, an address alike to many, and names and keys without a partner
    rows = [(i, "hub", f"k{i}") for i in range(30)] + [(100 + i, f"n{i}", "k0") for i in range(5)] + [(200, "lone", "k1"), (201, "n0", "none")]
    alike = {("hub", "hub"), ("hub", "n0"), ("n0", "hub"), ("n0", "n0"), ("n1", "n2"), ("n3", "n3"), ("gone", "hub")}
    near = {(f"k{i}", f"k{j}") for i in range(30) for j in range(30) if abs(i - j) < 2 or (i == 0 and j % 2 == 0)}
    left = spark.createDataFrame(rows, "src long, a string, c string")
    right = spark.createDataFrame(rows, "dst long, b string, d string")
    got = both_alike(left, right, spark.createDataFrame(sorted(alike), "a string, b string"), spark.createDataFrame(sorted(near), "c string, d string"))
    want = sorted((i, j) for i, a, c in rows for j, b, d in rows if (a, b) in alike and (c, d) in near)
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == want
    empty = both_alike(left.limit(0), right, spark.createDataFrame(sorted(alike), "a string, b string"), spark.createDataFrame(sorted(near), "c string, d string"))
    assert empty.count() == 0


def test_similarity_join_agrees_with_all_pairs(spark):
    words = ["main street", "main streets", "maine street", "oak avenue", "oak avenues", "elm road", "main street 5", "oak ave", ""]
    s = spark.createDataFrame([(w,) for w in words], "s string")
    x, y = s.select(F.col("s").alias("a")), s.select(F.col("s").alias("b"))
    every = pair_similarity(x.join(y, F.col("a") < F.col("b"))).collect()
    for t in (0.3, 0.6, 0.87):
        want = {(r["a"], r["b"]) for r in every if round(r["similarity"], 6) > t}
        assert {(r["a"], r["b"]) for r in similarity_join(s, t).collect()} == want


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["vertex"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    joined = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: find(v) for v in joined}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nearest_agrees_with_numpy(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {(i, int(j), k) for i in range(60) for k, j in enumerate(np.lexsort((np.arange(60), -s[i]))[:4])}
    assert {(r["src"], r["dst"], r["rank"]) for r in neighbors.nearest(df, 4).collect()} == want


def test_attach_noise(spark):
    cases = {1: [(1, 0.9), (1, 0.85), (2, 0.5)], 2: [(1, 0.9), (1, 0.85), (2, 0.7)], 3: [(1, 0.95)], 4: [(1, 0.9), (1, 0.8)]}
    near, labels = [], [(k, -1) for k in cases]
    for point, votes in cases.items():
        for k, (label, sim) in enumerate(votes):
            labels.append((point * 10 + k, label))
            near.append((point, point * 10 + k, sim, k))
    got = neighbors.attach_noise(spark.createDataFrame(near, "src long, dst long, similarity double, rank int"), spark.createDataFrame(labels, "id long, label long"))
    assert {r["id"]: r["label"] for r in got.where("id < 10").collect()} == {1: 1, 2: -1, 3: -1, 4: -1}


def test_label_ensemble(spark):
    rows = [(i, 0, 5, 0.9) for i in (1, 2, 3)] + [(4, -1, 5, 0.0)] + [(i, -1, 7, 0.0) for i in (5, 6, 7, 8)]
    got = neighbors.ensemble_labels(spark.createDataFrame(rows, "id long, hdb long, snn long, probability double")).collect()
    assert {r["id"]: (r["cluster"], r["label_source"], r["cluster_probability"]) for r in got} == {
        **{i: (0, 0, 0.9) for i in (1, 2, 3)}, 4: (0, 1, 0.6), **{i: (1, 2, 0.6) for i in (5, 6, 7, 8)},
    }


def test_hdbscan_finds_separate_groups(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:3]
    x = [(i * 20 + k, (c + rng.normal(scale=0.02, size=8)).tolist()) for i, c in enumerate(centres) for k in range(20)]
    got = clustering.hdbscan(spark.createDataFrame(x, "id long, vec array<double>"), min_cluster_size=5, min_samples=2, epsilon=0.5, neighbors=25).collect()
    groups = {i: {r["cluster"] for r in got if r["id"] // 20 == i and r["cluster"] != -1} for i in range(3)}
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3


def test_louvain_stays_within_components(spark):
    two = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)]
    got = {r["vertex"]: r["community"] for r in clustering.louvain(spark.createDataFrame(two, "src long, dst long, weight double")).collect()}
    assert {got[v] for v in range(5)} == {0} and {got[v] for v in range(10, 15)} == {10}


def test_projections_agree_with_numpy(spark):
    x = np.random.default_rng(4).normal(size=(50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    assert np.allclose(reduction.truncated_svd(df, 3).values, np.linalg.svd(x, compute_uv=False)[:3])
    c = x - x.mean(0)
    assert np.allclose(reduction.pca(df, 3).values, np.linalg.svd(c, compute_uv=False)[:3] / math.sqrt(49))
    with pytest.raises(RuntimeError):
        reduction.pca(df.limit(0), 3)


def test_canonical_names(spark):
    rows = [(1, "crystal clean")] * 2 + [(1, "crystal cleaning"), (2, "midwest waste"), (2, "midwest waste services"), (3, "acme")] + [(3, "acme truck repair")] * 2 + [(4, "only")]
    got = {r["g"]: (r["canonical_name"], r["score"]) for r in stages.canonical_names(spark.createDataFrame(rows, "g long, normalized_text string"), "g").collect()}
    assert got[1] == ("crystal clean", 4.21581)
    assert got[2] == ("midwest waste services", 4.076139)
    assert got[3] == ("acme truck repair", 4.040357)
    assert got[4][0] == "only"


def test_confidence_formula(spark):
    w = stages.CFG.scoring.weights
    one = lambda change, enriched: spark.range(1).select(F.round(score.combine(F.lit(0.9), F.lit(0.95), F.lit(1.0), F.lit(0.98), F.lit(3), F.lit(change), F.lit(enriched), F.lit(False), w), 6)).first()[0]
    assert [one(0.0, False), one(0.0, True), one(0.6, False), one(0.6, True)] == [0.898719, 0.853783, 0.808848, 0.768405]
    c = [(0.0, "Low"), (0.5, "Low"), (0.5001, "Medium"), (0.7, "Medium"), (0.85, "High"), (0.8501, "Very High"), (None, None)]
    df = spark.createDataFrame(c, "s double, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", score.category(F.col("s")).alias("got")).collect())


def test_chain_numbers(spark):
    rows = [(1, "acme", "a"), (2, "acme", "b"), (3, "zeta", "c")]
    df = spark.createDataFrame([(i, c, n, 0.9, k, "", "", k, "IL", "") for i, (c, n, k) in enumerate(rows)], "rec_id long, final_cluster long, normalized_text string, cluster_probability double, addr_normalized_key string, addr_street_number string, addr_street_name string, addr_city string, addr_state string, addr_zip string")
    assert {r["final_cluster"]: r["canonical_name"] for r in stages.canonical_map(df).collect()} == {1: "acme - 1", 2: "acme - 2", 3: "zeta"}
