"""Density and community clustering."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tether.operators.graph import connected_components
from tether.operators.neighbors import nearest
from tether.runtime.scratch import Scratch

#: Rows of a graph, two for an edge, that one task takes in; it then moves vertices one at a time.
WHOLE = 2_000_000
#: Vectors of a block of the spanning tree's tiles; a task holds two blocks.
TILE = 8192


def louvain(edges: DataFrame, resolution: float = 0.65, sweeps: int = 1000, levels: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """``vertex, community`` of the vertices of ``edges(src, dst, weight)`` by local moving and contraction.

    In a sweep each vertex looks at the communities of its neighbours and takes the one with the largest gain of
    modularity; half of the vertices, by hash, move at a time, so that neighbours do not swap. Once that no longer leaves
    fewer vertices with a gain, each community takes part in its best move only; such moves do not touch one another,
    so modularity grows until no vertex has a gain. Communities are then contracted and the sweeps repeated until
    nothing moves. A graph of up to ``WHOLE`` rows, from the start or once contracted, goes through the same steps in one
    task, vertex by vertex. Communities never cross components; their id is the smallest member's. More than ``sweeps`` in a
    level, or more than ``levels``, raise.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    e = e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    sym = scratch.save(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "sym")
    total = sym.agg(F.sum("weight")).first()[0]
    member = scratch.save(sym.select(F.col("src").alias("vertex")).distinct().withColumn("community", F.col("vertex")), "member")
    if not total:
        return member
    for _ in range(levels):
        if sym.count() <= WHOLE:
            found = scratch.save(communities(sym, resolution, total, sweeps, levels), "found")
            member = member.join(found, member["community"] == found["src"]).select("vertex", F.col("c").alias("community"))
            break
        degree = scratch.save(sym.groupBy("src").agg(F.sum("weight").alias("d")), "degree")
        label = scratch.save(degree.select("src", F.col("src").alias("c")), "label")
        moved, fewest, waits, single = False, None, 0, False
        for sweep in range(sweeps):
            mass = degree.join(label, "src").groupBy("c").agg(F.sum("d").alias("m"))
            to = sym.where("src <> dst").join(label.select(F.col("src").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("weight").alias("k"))
            # staying counts too, without the vertex's own weight
            own = label.join(to, ["src", "c"], "left_anti").select("src", "c", F.lit(0.0).alias("k"))
            seen = to.unionByName(own).join(mass, "c").join(degree, "src").join(label.select("src", F.col("c").alias("mine")), "src")
            m = F.when(F.col("c") == F.col("mine"), F.col("m") - F.col("d")).otherwise(F.col("m"))
            gain = F.round(F.col("k") - F.lit(resolution) * F.col("d") * m / F.lit(total), 9)
            stay = F.max(F.when(F.col("c") == F.col("mine"), gain))
            best = seen.groupBy("src").agg(F.min(F.struct((-gain).alias("g"), (F.col("c") != F.col("mine")).alias("moves"), "c")).alias("b"), F.first("mine").alias("mine"), stay.alias("stay"))
            best = scratch.save(best.select("src", "mine", F.col("b.c").alias("c"), F.col("b.moves").alias("moves"), (F.col("b.g") + F.col("stay")).alias("g")), "best")
            wants = best.where("moves").count()
            if not wants:
                scratch.drop(best)
                break
            moved = True
            waits = 0 if fewest is None or wants < fewest else waits + 1
            fewest = min(wants, fewest or wants)
            single = single or waits >= 4
            if single:
                moves = best.where("moves").select("src", "g", F.explode(F.array("mine", "c")).alias("touched"))
                first = moves.groupBy("touched").agg(F.min(F.struct("g", "src")).alias("f")).groupBy("f.src").agg(F.count("*").alias("n")).where("n = 2").select("src", F.lit(True).alias("turn"))
                new = best.join(first, "src", "left").select("src", F.when(F.col("turn"), F.col("c")).otherwise(F.col("mine")).alias("c"))
            else:
                turn = F.pmod(F.xxhash64("src", F.lit(sweep // 2)), F.lit(2)) == sweep % 2
                new = best.select("src", F.when(turn, F.col("c")).otherwise(F.col("mine")).alias("c"))
            new = scratch.save(new, "label")
            scratch.drop(label, best)
            label = new
        else:
            raise RuntimeError(f"vertices still move after {sweeps} sweeps")
        if not moved:
            break
        low = W.partitionBy("c")
        label = label.withColumn("c", F.min("src").over(low))
        member = scratch.save(member.join(label, member["community"] == label["src"]).select("vertex", F.col("c").alias("community")), "member")
        a, b = label.select("src", F.col("c").alias("x")), label.select(F.col("src").alias("dst"), F.col("c").alias("y"))
        sym = scratch.save(sym.join(a, "src").join(b, "dst").groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.sum("weight").alias("weight")), "sym")
    else:
        raise RuntimeError(f"communities still change after {levels} levels")
    return member


def communities(sym: DataFrame, resolution: float, total: float, sweeps: int, levels: int) -> DataFrame:
    """``src, c`` of the vertices of ``sym(src, dst, weight)``, which has each edge both ways, by ``louvain``'s steps in one task.

    Vertices move one at a time to the community with the largest gain, first all by id, then those with a neighbour that
    left them, until a pass over all finds no gain.
    """

    def moved(at: np.ndarray, to: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        d = np.bincount(at, w, n).tolist()
        mass, c = list(d), list(range(n))
        other = at != to
        start = np.searchsorted(at[other], np.arange(n + 1)).tolist()
        to, w = to[other], w[other]
        least = 1e-9 * max(1.0, float(w.max())) if len(w) else 0.0
        for _ in range(sweeps):
            todo, waits, any_moved = deque(range(n)), bytearray(b"\1") * n, False
            while todo:
                v = todo.popleft()
                waits[v] = 0
                if start[v] == start[v + 1]:
                    continue
                mine, near, k = c[v], to[start[v] : start[v + 1]].tolist(), {}
                for u, x in zip(near, w[start[v] : start[v + 1]].tolist()):
                    k[c[u]] = k.get(c[u], 0.0) + x
                f = resolution * d[v] / total
                mass[mine] -= d[v]
                best, most = mine, k.get(mine, 0.0) - f * mass[mine] + least
                for y, x in k.items():
                    gain = x - f * mass[y]
                    if gain > most:
                        best, most = y, gain
                mass[best] += d[v]
                if best != mine:
                    c[v], any_moved = best, True
                    for u in near:
                        if c[u] != best and not waits[u]:
                            waits[u] = 1
                            todo.append(u)
            if not any_moved:
                return np.array(c)
        raise RuntimeError(f"vertices still move after {sweeps} sweeps")

    def whole(t: pa.Table) -> pa.Table:
        ids, at = np.unique(t["src"].to_numpy(), return_inverse=True)
        to, w = np.searchsorted(ids, t["dst"].to_numpy()), t["weight"].to_numpy()
        own, n = np.arange(len(ids)), len(ids)
        for _ in range(levels):
            order = np.lexsort((to, at))
            at, to, w = at[order], to[order], w[order]
            c = moved(at, to, w, n)
            # communities are numbered by their smallest member
            _, first, c = np.unique(c, return_index=True, return_inverse=True)
            place = np.empty(len(first), np.int64)
            place[np.argsort(first)] = np.arange(len(first))
            c = place[c]
            own = c[own]
            if len(first) == n:
                break
            n = len(first)
            edge, into = np.unique(c[at] * n + c[to], return_inverse=True)
            at, to, w = edge // n, edge % n, np.bincount(into, w)
        else:
            raise RuntimeError(f"communities still change after {levels} levels")
        return pa.table({"src": ids, "c": ids[np.unique(own, return_index=True)[1]][own]})

    return sym.groupBy(F.lit(0).alias("all")).applyInArrow(whole, "src long, c long")


def shortest_out(points: DataFrame, alpha: float) -> DataFrame:
    """``x, src, dst, d`` (src < dst): the first edge, by (d, src, dst), from each component to another one, in each tile.

    Rows are ``(id, vec, core, x)`` with component x. Every pair of vectors is compared, tile by tile; d is the mutual
    reachability distance. A component has a row for each tile in which it has an edge out.
    """
    n = max(1, -(-points.count() // TILE))
    rows = points.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.select(F.least("own", "other").alias("q"), F.greatest("own", "other").alias("b"), "own", "id", "vec", "core", "x")

    def tile(t: pa.Table) -> pa.Table:
        q, b, own = t["q"][0].as_py(), t["b"][0].as_py(), t["own"].to_numpy()
        ids, core, comp = t["id"].to_numpy(), t["core"].to_numpy(), t["x"].to_numpy()
        v = np.array(t["vec"].combine_chunks().flatten()).reshape(len(ids), -1)
        norm = np.linalg.norm(v, axis=1)
        v = v / np.where(norm > 0, norm, 1)[:, None]
        order = np.argsort(ids, kind="stable")
        sides = [order[own[order] == k] for k in (q, b)]
        found = [np.zeros((4, 0))]
        for left, right in [sides, sides[::-1]][: 1 + (q != b)]:
            for i in range(0, len(left) if len(right) else 0, 256):
                mine = left[i : i + 256]
                d = np.sqrt(np.maximum(0, 2 - 2 * np.round(v[mine] @ v[right].T, 6))) / alpha
                d = np.round(np.maximum(np.maximum(d, core[mine][:, None]), core[right][None, :]), 9)
                d[comp[mine][:, None] == comp[right][None, :]] = np.inf
                # of equal distances the smallest id comes first
                at = d.argmin(axis=1)
                least = d[np.arange(len(mine)), at]
                ok = np.isfinite(least)
                u, w = mine[ok], right[at[ok]]
                found.append(np.stack([u, w, least[ok], comp[u]]))
        u, w, d, _ = np.concatenate(found, axis=1)
        u, w = u.astype(int), w.astype(int)
        src, dst, x = np.minimum(ids[u], ids[w]), np.maximum(ids[u], ids[w]), comp[u]
        order = np.lexsort((dst, src, d, x))
        first = order[np.append(True, x[order][1:] != x[order][:-1])] if len(order) else order
        return pa.table({"x": x[first], "src": src[first], "dst": dst[first], "d": d[first]})

    return rows.groupBy("q", "b").applyInArrow(tile, "x long, src long, dst long, d double")


def spanning_tree(points: DataFrame, tree: DataFrame, alpha: float, scratch: Scratch) -> DataFrame:
    """The minimum spanning tree of the mutual reachability of ``points(id, vec, core)`` by Boruvka rounds from a part of it.

    Every component takes its first edge out. Edges are in one total order, so rounds make no cycles; each at least
    halves the components.
    """
    for _ in range(64):
        g = connected_components(tree.select("src", "dst"), scratch)
        rows = points.join(g.withColumnRenamed("vertex", "id"), "id", "left").withColumn("x", F.coalesce("component_id", "id")).drop("component_id")
        best = shortest_out(rows, alpha).groupBy("x").agg(F.min(F.struct("d", "src", "dst")).alias("b")).select("b.src", "b.dst", "b.d").distinct()
        best = scratch.save(best, "best")
        if best.limit(1).count() == 0:
            return tree
        tree = scratch.save(tree.unionByName(best), "tree")
    raise RuntimeError("the spanning tree did not settle in 64 rounds")


def hdbscan(vectors: DataFrame, min_cluster_size: int = 3, min_samples: int = 1, epsilon: float = 0.15, alpha: float = 0.8, neighbors: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """``id, cluster, cluster_probability`` of ``vectors(id, vec)`` by HDBSCAN with leaf selection and an epsilon.

    Neighbour lists, core distances, mutual reachability and the spanning tree, which is that of all pairs, are
    distributed. The lists of ``neighbors`` only save work: an edge shorter than any that a list leaves out is taken
    from it. The driver reads the tree, n - 1 rows of three numbers, to condense it. Vectors without a cluster have -1
    and probability 0.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    near = scratch.save(nearest(vectors, max(neighbors, min_samples)).withColumn("d", F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("similarity")))), "near")
    core = scratch.save(near.where(F.col("rank") < min_samples).groupBy("src").agg(F.max("d").alias("core")), "core")
    reach = near.join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("core").alias("core2")), "dst")
    reach = reach.select("src", "dst", F.round(F.greatest(F.col("core"), F.col("core2"), F.col("d") / alpha), 9).alias("d"), F.round(F.greatest(F.col("core"), F.col("d") / alpha), 9).alias("least"))
    sure = reach.groupBy("src").agg(F.min(F.struct("d", "dst")).alias("b"), F.max("least").alias("beyond")).where("b.d < beyond")
    sure = sure.select(F.least("src", "b.dst").alias("src"), F.greatest("src", "b.dst").alias("dst"), "b.d").distinct()
    points = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).join(core.withColumnRenamed("src", "id"), "id")
    table = spanning_tree(scratch.save(points, "points"), scratch.save(sure, "tree"), alpha, scratch).orderBy("d", "src", "dst").toArrow()
    ids, at = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
    label, prob = condense(len(ids), at[: table.num_rows], at[table.num_rows :], table["d"].to_numpy(), min_cluster_size, epsilon)
    told = spark.createDataFrame(list(zip(ids.tolist(), label.tolist(), prob.tolist())), "id bigint, cluster bigint, cluster_probability double")
    return vectors.select("id").join(told, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("cluster_probability", F.lit(0.0)).alias("cluster_probability"))


def condense(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, least: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels and probabilities from tree edges sorted by distance.

    Going down from the root, a split into two parts of ``least`` points each makes two clusters; points that fall off
    leave at 1 / distance. Leaves of this tree are the clusters; one born below ``epsilon`` gives way to its first
    ancestor born above it. A point's probability is its leaving level over its cluster's highest.
    """
    parent = list(range(n))
    node, size = list(range(n)), [1] * n
    left, right, height, count = [], [], [], [1] * n

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y, w in zip(a.tolist(), b.tolist(), d.tolist()):
        x, y = find(x), find(y)
        if x == y:
            continue
        left.append(node[x])
        right.append(node[y])
        height.append(w)
        count.append(count[node[x]] + count[node[y]])
        if size[x] < size[y]:
            x, y = y, x
        parent[y] = x
        size[x] += size[y]
        node[x] = n + len(left) - 1
    label, prob = np.full(n, -1), np.zeros(n)
    if not left:
        return label, prob
    level = lambda w: 1.0 / w if w > 0 else 1e12
    roots = sorted({node[find(x)] for x in range(n)})
    birth, up, children, falls = [], [], [], []
    stack = []
    for r in roots:
        birth.append(0.0)
        up.append(-1)
        children.append([])
        falls.append([])
        stack.append((r, len(birth) - 1))

    def points(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += [left[v - n], right[v - n]]
        return out

    while stack:
        v, c = stack.pop()
        if v < n:
            falls[c].append((v, 1e12))
            continue
        lam, l, r = level(height[v - n]), left[v - n], right[v - n]
        if count[l] >= least and count[r] >= least:
            for child in (l, r):
                birth.append(lam)
                up.append(c)
                children.append([])
                falls.append([])
                children[c].append(len(birth) - 1)
                stack.append((child, len(birth) - 1))
            continue
        for child in (l, r):
            if count[child] >= least:
                stack.append((child, c))
            else:
                falls[c] += [(p, lam) for p in points(child)]
    chosen = set()
    for c in range(len(birth)):
        if children[c] or up[c] < 0:
            continue
        while up[c] >= 0 and epsilon and birth[c] > 1.0 / epsilon and up[up[c]] >= 0:
            c = up[c]
        chosen.add(c)
    owner = {}
    for c in sorted(chosen, reverse=False):
        x = up[c]
        while x >= 0 and x not in chosen:
            x = up[x]
        if x < 0:
            owner[c] = c
    number = {c: k for k, c in enumerate(sorted(owner))}
    for c in sorted(owner):
        todo, own = [c], []
        while todo:
            x = todo.pop()
            own += falls[x]
            todo += children[x]
        top = max((w for _, w in own if w < 1e12), default=1.0)
        for p, w in own:
            label[p], prob[p] = number[c], min(1.0, w / top)
    return label, prob
