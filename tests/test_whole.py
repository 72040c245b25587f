"""Operators and queries do their whole job: no row, edge or pair is left out."""

import time

import numpy as np

from tether.operators import clustering, neighbors, reduction
from tether.plans import catalog
from tether.runtime.scratch import Scratch


def roots(edges, vertices):
    """The smallest member of each vertex's component."""
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in vertices}


def small_tables(spark, path, n=300):
    """The tables of the entity view with ``n`` records."""
    spark.createDataFrame([(i,) for i in range(1, n + 1)], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    parts = [(i, f"part {i % 9}", "type", f"Brand#{i % 3}", i % 2) for i in range(200)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(i, f"NATION {i}", i % 5) for i in range(25)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{path}/nation.parquet")
    return str(path)


def test_consolidate_identical_keeps_every_record(spark, tmp_path):
    d = small_tables(spark, tmp_path)
    rows = [r.asDict() | {"k": r["rec_id"] % 23} for r in catalog.clustered(spark, d).collect()]
    assert len(rows) == 300
    first, edges = {}, []
    for r in rows:
        edges.append((first.setdefault((r["normalized_text"], r["addr_normalized_key"]), r["k"]), r["k"]))
    root = roots(edges, {r["k"] for r in rows})
    rank = lambda k: (-sum(r["k"] == k for r in rows), -round(np.mean([r["cluster_probability"] for r in rows if r["k"] == k]), 9), k)
    winner = {k: min((x for x in root if root[x] == root[k]), key=rank) for k in root}
    got = {r["rec_id"]: r["k"] for r in catalog.queries()["consolidate_identical"](spark, d).collect()}
    assert got == {r["rec_id"]: winner[r["k"]] for r in rows}


def test_consensus_embedding_is_fitted_on_every_vector(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(600, 64)).round(3)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = lambda v: v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
    one, two = unit(x.astype(np.float32).astype(float)), unit(x[:, :32].astype(np.float32).astype(float))
    value, vector = np.linalg.eigh(reduction.center_kernel((one @ one.T + two @ two.T) / 2))
    want = unit((vector * np.sqrt(np.maximum(value, 0)))[:, ::-1][:, :48])
    got = np.array([r["vec"] for r in catalog.queries()["consensus_embedding"](spark, str(tmp_path)).orderBy("id").collect()])
    sign = np.sign((want * got).sum(axis=0))
    assert got.shape == (600, 48) and np.allclose(got, want * sign, atol=2e-5)


def test_merge_candidates_are_every_close_pair(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 30)
    rng = np.random.default_rng(9)
    x = np.eye(8)[0] + rng.normal(scale=0.15, size=(90, 8))
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id long, label long, vec array<double>")
    got = {(r["a"], r["b"]) for r in neighbors.merge_candidates(df.select("id", "vec"), df.select("id", "label"), 0.75, 0.8, 0.8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(np.round(u @ u.T, 6) >= 0.8, 1))
    assert got == set(zip(a.tolist(), b.tolist())) and max(np.bincount(a)) > 64


def test_merge_candidates_count_all_pairs_of_large_clusters(spark, monkeypatch):
    """Exact over millions of pairs, of odd and even numbers, without a row for each; copies and opposites among them."""
    rng = np.random.default_rng(11)
    label = np.repeat([3, 5, 8, 9], [2001, 1500, 2001, 3])
    x = np.eye(16)[0] * 0.5 + rng.normal(scale=0.3, size=(len(label), 16))
    x[:400], x[2200:2300], x[4000] = x[0], -x[2200:2300], x[0]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, label long, vec array<double>").cache()
    monkeypatch.setattr(neighbors, "BLOCK", 700)
    began = time.monotonic()
    got = {(r["a"], r["b"]): (r["median_sim"], r["max_sim"]) for r in neighbors.merge_candidates(df.select("id", "vec"), df.select("id", "label"), 0.0, -1.0, -1.0, 10_000).collect()}
    # a row for each of the ten million pairs takes minutes
    assert time.monotonic() - began < 60
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    s = {(a, b): np.round(u[label == a] @ u[label == b].T, 6) for a in (3, 5, 8, 9) for b in (3, 5, 8, 9) if a < b}
    assert set(got) == set(s) and all(np.allclose(got[k], (np.median(v), v.max()), rtol=0, atol=6e-7) for k, v in s.items())
    assert all(got[k][1] == v.max() for k, v in s.items())


def test_louvain_goes_on_until_no_communities_gain(spark):
    n, resolution = 400, 0.1
    path = [(i, i + 1, 1.0) for i in range(n - 1)]
    got = {r["vertex"]: r["community"] for r in clustering.louvain(spark.createDataFrame(path, "src long, dst long, weight double"), resolution).collect()}
    mass = {}
    for a, b, _ in path:
        for v in (a, b):
            mass[got[v]] = mass.get(got[v], 0) + 1
    between = {}
    for a, b, _ in path:
        if got[a] != got[b]:
            pair = tuple(sorted((got[a], got[b])))
            between[pair] = between.get(pair, 0) + 1
    assert len(got) == n and all(w - resolution * mass[a] * mass[b] / (2 * len(path)) <= 1e-6 for (a, b), w in between.items())


def test_louvain_takes_a_graph_that_fits_in_one_task(spark, monkeypatch):
    """Few tables are written, however many moves it takes; in one task, or by sweeps first, nothing gains in the end."""
    rng, resolution = np.random.default_rng(12), 0.65
    at = [(int(a), int(b), float(w)) for g in range(4) for a, b, w in zip(rng.integers(0, 20, 90) + 20 * g, rng.integers(0, 20, 90) + 20 * g, rng.uniform(0.1, 1, 90).round(3))]
    at += [(int(a), int(b), 0.2) for a, b in rng.integers(0, 80, (40, 2))] + [(200 + i, 201 + i, 1.0) for i in range(60)]
    at += [at[0], (at[1][1], at[1][0], 0.5), (500, 500, 3.0)]
    w = np.zeros((300, 300))
    for a, b, x in at:
        if a != b:
            w[a, b] += x
            w[b, a] += x
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": saved.append(name) or save(self, df, name))
    edges, quality = spark.createDataFrame(at, "src long, dst long, weight double"), {}
    for whole in (clustering.WHOLE, np.count_nonzero(w) - 1):
        monkeypatch.setattr(clustering, "WHOLE", whole)
        saved.clear()
        got = {r["vertex"]: r["community"] for r in clustering.louvain(edges, resolution).collect()}
        if not quality:
            assert len(saved) <= 4
        assert set(got) == set(np.flatnonzero(w.sum(axis=1)).tolist())
        member = np.array([[got.get(v) == c for c in sorted(set(got.values()))] for v in range(300)], float)
        between, mass = member.T @ w @ member, member.T @ w.sum(axis=1)
        gain = between - resolution * np.outer(mass, mass) / w.sum()
        assert (gain[~np.eye(len(mass), dtype=bool)] <= 1e-6).all()
        assert all(c == min(v for v in got if got[v] == c) for c in set(got.values()))
        assert all((got[v] >= 200) == (v >= 200) for v in got)
        quality[whole] = np.trace(gain) / w.sum()
    assert max(quality.values()) - min(quality.values()) < 0.05


def test_nearest_over_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 900)
    x = np.random.default_rng(13).normal(size=(2500, 6)).round(1)
    x[100:1400:3], x[7] = x[0], 0
    ids = np.random.default_rng(14).permutation(2500) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>")
    n = np.linalg.norm(x, axis=1)[:, None]
    u = x / np.where(n > 0, n, 1)
    s = np.round(u @ u.T, 6)
    for itself, asked in ((False, None), (True, None), (False, df.where("id % 100 = 0"))):
        want = {}
        for i in range(len(x)) if asked is None else np.flatnonzero(ids % 100 == 0):
            order = np.lexsort((ids, -s[i]))
            want[ids[i]] = [(ids[j], s[i, j]) for j in (order if itself else order[order != i])[:5]]
        got = {}
        for r in neighbors.nearest(df, 5, asked, itself).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append((r["dst"], r["similarity"]))
        # products are summed in another order, so one in the middle of two millionths may be rounded either way
        assert set(got) == set(want) and all([d for d, _ in got[k]] == [d for d, _ in want[k]] or np.allclose([v for _, v in got[k]], [v for _, v in want[k]], rtol=0, atol=1.1e-6) for k in want)
        assert sum([d for d, _ in got[k]] != [d for d, _ in want[k]] for k in want) < 5


def test_hdbscan_joins_groups_beyond_the_neighbour_lists(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TILE", 40)
    rng = np.random.default_rng(10)
    x = np.concatenate([np.repeat(np.eye(6)[:1], 30, axis=0), np.repeat(np.eye(6)[1:2], 30, axis=0), np.eye(6)[2] + rng.normal(scale=0.01, size=(25, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r["id"]: r["cluster"] for r in clustering.hdbscan(df, 10, 1, 0.0, neighbors=5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * np.round(u @ u.T, 6))) / 0.8, 9)
    near = np.round(np.sort(d + np.diag([np.inf] * len(x)), axis=1)[:, 0] * 0.8, 9)
    edges = sorted((max(d[i, j], near[i], near[j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    a, b, w = (np.array(c) for c in zip(*[(i, j, e) for e, i, j in edges]))
    label, _ = clustering.condense(len(x), a, b, w, 10, 0.0)
    groups = lambda of: {frozenset(i for i in range(len(x)) if of[i] == c) for c in set(of[i] for i in range(len(x))) - {-1}}
    assert groups(got) == groups(label) and any(set(range(30)) <= g for g in groups(got))
