"""Nearest neighbours and the operators over neighbour lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tether.runtime.scratch import Scratch

#: Vectors of a block; a task holds two blocks.
BLOCK = 8192
#: Similarities are counted in millionths: one by one for up to FEW pairs, else in steps of 2 ** STEP first.
UNIT, FEW, STEP = 1_000_000, 4096, 10


def nearest(vectors: DataFrame, k: int, queries: DataFrame | None = None, with_self: bool = False) -> DataFrame:
    """``src, dst, similarity, rank`` (from 0) of the k most similar vectors of each query by cosine.

    Rows are ``(id, vec)``; queries are all rows if not given. Similarities have six digits and ties go to the smaller
    id. Query and base blocks are multiplied tile by tile and only a tile's k best of each query are passed on. Without
    queries of their own, two blocks meet once, for both directions.
    """
    base = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nb = blocks(base)
    if queries is None:
        tiles = nb * (nb + 1) // 2
        sent = base.withColumn("own", spot(nb)).withColumn("other", every(nb))
        sent = sent.select(F.least("own", "other").alias("q"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "vec")
    else:
        asked = queries.select("id", F.col("vec").cast("array<double>").alias("vec"))
        nq = blocks(asked)
        tiles = nq * nb
        left = asked.select(spot(nq).alias("q"), every(nb).alias("b"), F.lit(0).alias("side"), "id", "vec")
        sent = left.unionByName(base.select(every(nq).alias("q"), spot(nb).alias("b"), F.lit(1).alias("side"), "id", "vec"))
    mutual = queries is None

    def tile(t: pa.Table) -> pa.Table:
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        x = np.array(t["vec"].combine_chunks().flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        n = np.linalg.norm(x, axis=1)
        x = x / np.where(n > 0, n, 1)[:, None]
        order = np.argsort(ids, kind="stable")
        order = order[np.isfinite(x[order]).all(axis=1)]
        a, b = order[side[order] == 0], order[side[order] == 1]
        todo = [(a, b)]
        if mutual:
            todo = [(a, b), (b, a)] if t["q"][0].as_py() != t["b"][0].as_py() else [(a, a)]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for left, right in todo:
            meets = np.zeros(len(left), bool) if with_self else np.isin(ids[left], ids[right])
            for i in range(0, len(left), 128):
                own = left[i : i + 128]
                same = meets[i : i + 128].any()
                row, dst, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                least = np.full(len(own), -np.inf)
                for j in range(0, len(right), 1024):
                    part = right[j : j + 1024]
                    s = x[own] @ x[part].T
                    if same:
                        s[ids[own][:, None] == ids[part][None, :]] = -np.inf
                    # a later part has larger ids, so a row that is full gives way to larger rounded values only
                    bar = least + 4e-7
                    if len(part) > k and not np.isfinite(least).all():
                        bar = np.maximum(bar, np.partition(s, len(part) - k, axis=1)[:, len(part) - k] - 1.1e-6)
                    r, c = np.nonzero(s >= bar[:, None])
                    if not len(r):
                        continue
                    row, dst, sim = np.append(row, r), np.append(dst, ids[part[c]]), np.append(sim, np.round(s[r, c], 6))
                    best = np.lexsort((dst, -sim, row))
                    first = np.searchsorted(row[best], np.arange(len(own)))
                    best = best[(np.arange(len(best)) - first[row[best]] < k) & np.isfinite(sim[best])]
                    row, dst, sim = row[best], dst[best], sim[best]
                    full = np.bincount(row, minlength=len(own)) == k
                    last = np.searchsorted(row, np.arange(len(own)), side="right") - 1
                    least[full] = sim[last[full]]
                out.append((ids[own][row], dst, sim))
        src, dst, sim = (np.concatenate(v) for v in zip(*out))
        return pa.table({"src": src.astype(np.int64), "dst": dst.astype(np.int64), "similarity": sim})

    found = sent.repartition(min(tiles, 2000), "q", "b").groupBy("q", "b").applyInArrow(tile, "src long, dst long, similarity double")
    order = W.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def pairs_above(vectors: DataFrame, threshold: float) -> DataFrame:
    """``src, dst, similarity`` (src < dst) of every pair of ``vectors(id, vec)`` with a cosine above the threshold."""
    base = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    n = max(1, -(-base.count() // BLOCK))
    rows = base.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.select(F.least("own", "other").alias("q"), F.greatest("own", "other").alias("b"), "own", "id", "vec")

    def tile(t: pa.Table) -> pa.Table:
        q, b, own, ids = t["q"][0].as_py(), t["b"][0].as_py(), t["own"].to_numpy(), t["id"].to_numpy()
        x = np.array(t["vec"].combine_chunks().flatten()).reshape(len(ids), -1)
        n = np.linalg.norm(x, axis=1)
        x = x / np.where(n > 0, n, 1)[:, None]
        left, right = np.flatnonzero(own == q), np.flatnonzero(own == b)
        src, dst, sim = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(0, len(left), 256):
            mine = left[i : i + 256]
            s = np.round(x[mine] @ x[right].T, 6)
            near = s > threshold
            if q == b:
                near &= ids[mine][:, None] < ids[right][None, :]
            u, v = np.nonzero(near)
            src.append(np.minimum(ids[mine][u], ids[right][v]))
            dst.append(np.maximum(ids[mine][u], ids[right][v]))
            sim.append(s[u, v])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "similarity": np.concatenate(sim)})

    return rows.groupBy("q", "b").applyInArrow(tile, "src long, dst long, similarity double")


def mutual_ranks(vectors: DataFrame, k: int) -> DataFrame:
    """``src, dst, weight`` (src < dst) of pairs that are in each other's list: mean similarity / (ranks + 2).

    Ranks count from 0 and include a vector's own place in its list.
    """
    e = nearest(vectors, k, with_self=True).where("src <> dst")
    both = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.avg("similarity").alias("similarity"), F.avg("rank").alias("rank"), F.countDistinct("src").alias("n"))
    return both.where("n = 2").select("src", "dst", F.round(F.col("similarity") / (2 * F.col("rank") + 2), 9).alias("weight"))


def edges_within(neighbors: DataFrame, distance: float) -> DataFrame:
    """``source, dest, distance`` of a neighbour list below a distance; source is the neighbour, loops are left out."""
    d = F.round(1.0 - F.col("similarity"), 6)
    return neighbors.where("src <> dst").select(F.col("dst").alias("source"), F.col("src").alias("dest"), d.alias("distance")).where(F.col("distance") < distance)


def attach_noise(neighbors: DataFrame, labels: DataFrame, tau: float = 0.82, least: int = 2, ratio: float = 1.5) -> DataFrame:
    """``id, label`` of each row of ``labels(id, label)``; noise (-1) takes a label its neighbours agree on.

    The candidate is the commonest label among a noise point's neighbours (then the more similar, then the smaller).
    It must have ``least`` neighbours, as many at ``tau`` or above, a mean of ``tau``, and a mean ``ratio`` times that of the second label.
    """
    noise = labels.where("label = -1").select(F.col("id").alias("src"))
    known = labels.where("label <> -1").select(F.col("id").alias("dst"), "label")
    votes = neighbors.join(noise, "src", "left_semi").join(known, "dst").groupBy("src", "label").agg(
        F.count("*").alias("n"), F.round(F.avg("similarity"), 9).alias("mean"), F.sum((F.col("similarity") >= tau).cast("int")).alias("near")
    )
    order = W.partitionBy("src").orderBy(F.desc("n"), F.desc("mean"), "label")
    ranked = votes.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("mean").over(order)).where("k = 1")
    clear = F.col("second").isNull() | (F.col("mean") / (F.col("second") + 1e-8) >= ratio)
    taken = ranked.where(clear & (F.col("n") >= least) & (F.col("near") >= least) & (F.col("mean") >= tau))
    return labels.join(taken.select(F.col("src").alias("id"), F.col("label").alias("got")), "id", "left").select("id", F.coalesce("got", "label").alias("label"))


def centroids(vectors: DataFrame, labels: DataFrame, sample: int | None = None) -> DataFrame:
    """``label, centroid, size`` of unit length; over at most ``sample`` members by hash where given."""
    rows = vectors.join(labels.where("label <> -1"), "id")
    if sample:
        rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id"), "id"))).where(F.col("_k") <= sample)
    parts = rows.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.max("n").alias("size"))
    v = F.transform("v", lambda e: e["x"])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return whole.select("label", F.transform(v, lambda x: x / norm).alias("centroid"), "size")


def merge_candidates(
    vectors: DataFrame, labels: DataFrame, centroid_threshold: float = 0.75, median: float = 0.84, top: float = 0.90, members: int = 20, scratch: Scratch | None = None
) -> DataFrame:
    """``a, b, median_sim, max_sim`` of clusters that are near: by centroid first, then by pairs of sampled members.

    The similarity of every pair of members counts, rounded to millionths. Pairs are multiplied tile by tile and only
    counted: where there are many, in steps of 2 ** STEP millionths first, then one by one in the step that holds the
    middle, so the median is exact and no pair of members becomes a row.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    cent = centroids(vectors, labels)
    close = pairs_above(cent.select(F.col("label").cast("bigint").alias("id"), F.col("centroid").alias("vec")), centroid_threshold)
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    order = W.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    rows = vectors.join(labels.where("label <> -1"), "id").withColumn("_k", F.row_number().over(order)).where((F.col("_k") <= members) & whole)
    rows = scratch.save(rows.select(F.col("label").cast("bigint").alias("label"), "id", F.col("vec").cast("array<double>").alias("vec")), "members")
    size = rows.groupBy("label").agg(F.count("*").alias("n"))
    rows = rows.join(size, "label").select("label", F.pmod(F.xxhash64("id"), _blocks(F.col("n"))).cast("int").alias("block"), "vec")
    pairs = close.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = pairs.join(size.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
    step = F.when(F.col("na") * F.col("nb") <= FEW, 0).otherwise(STEP)
    first = scratch.save(pairs.select("*", F.lit(-UNIT).alias("lo"), F.lit(UNIT).alias("hi"), step.alias("step"), F.lit(0).cast("bigint").alias("under")), "pairs")
    seen = scratch.save(_middles(rows, first), "middles").where(F.col("peak") / F.lit(float(UNIT)) >= top)
    last = F.shiftleft(F.lit(1), STEP) - 1
    rough = seen.where((F.col("step") > 0) & ((F.col("y") + last) / F.lit(float(UNIT)) >= median))
    narrow = rough.select("a", "b", "na", "nb", F.col("x").cast("int").alias("lo"), (F.col("y") + last).cast("int").alias("hi"), F.lit(0).alias("step"), "under")
    fine = _middles(rows, scratch.save(narrow, "pairs")).drop("peak").join(seen.select("a", "b", "peak"), ["a", "b"])
    both = seen.where("step = 0").select("a", "b", "x", "y", "peak").unionByName(fine.select("a", "b", "x", "y", "peak"))
    value = lambda c: F.col(c) / F.lit(float(UNIT))
    out = both.select("a", "b", F.round(0.5 * value("x") + 0.5 * value("y"), 6).alias("median_sim"), value("peak").alias("max_sim"))
    return out.where((F.col("median_sim") >= median) & (F.col("max_sim") >= top))


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _middles(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``x, y, peak, under`` beside ``a, b, na, nb, step``: the steps of the two middle products, the largest product in the range, those below x.

    Rows are ``(label, block, vec)``. Products of the members of a and b are counted in millionths from ``lo`` to ``hi`` by
    steps of ``2 ** step``; ``under`` of them are known to be below ``lo``.
    """
    count = lambda c: _blocks(F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    tiles = pairs.withColumn("i", every("na")).withColumn("j", every("nb"))
    # small pairs share a task's call
    load = tiles.agg(F.count("*"), F.sum(F.col("na") / count("na") + F.col("nb") / count("nb"))).first()
    calls = max(1, min(load[0], round((load[1] or 0) / BLOCK)))
    tiles = tiles.select("a", "b", "i", "j", "na", "nb", "lo", "hi", "step", F.pmod(F.xxhash64("a", "b", "i", "j"), F.lit(calls)).cast("int").alias("t"))

    def side(k: int, label: str, block: str) -> DataFrame:
        own = tiles.withColumn("label", F.col(label)).withColumn("block", F.col(block)).join(rows, ["label", "block"])
        return own.select("t", "a", "b", "i", "j", F.lit(k).alias("side"), "lo", "hi", "step", "vec")

    def tally(t: pa.Table) -> pa.Table:
        x = np.array(t["vec"].combine_chunks().flatten()).reshape(len(t), -1)
        norm = np.linalg.norm(x, axis=1)
        x = x / np.where(norm > 0, norm, 1)[:, None]
        key = np.stack([t[c].to_numpy() for c in ("a", "b", "i", "j", "side")])
        lo, hi, step = (t[c].to_numpy() for c in ("lo", "hi", "step"))
        order = np.lexsort(key[::-1])
        new = np.append(True, (np.diff(key[:4, order], axis=1) != 0).any(axis=0))
        out = {c: [np.zeros(0, np.int64)] for c in ("a", "b", "at", "n", "peak")}
        for own in np.split(order, np.flatnonzero(new)[1:]):
            left, right = own[key[4, own] == 0], own[key[4, own] == 1]
            if not len(left) or not len(right):
                continue
            a, b = key[:2, own[0]]
            low, high, bits = int(lo[own[0]]), int(hi[own[0]]), int(step[own[0]])
            few = len(left) * len(right) <= FEW
            n, peak, base = np.zeros(0 if few else (high - low >> bits) + 1, np.int64), -UNIT, np.ascontiguousarray(x[right].T)
            # a part's products stay in the processor's cache
            part = max(1, (1 << 17) // len(right))
            for i in range(0, len(left), part):
                s = x[left[i : i + part]] @ base
                s *= UNIT
                np.rint(s, out=s)
                peak = max(peak, int(s.max()))
                s = s.ravel() if low <= -UNIT and high >= UNIT else s[(s >= low) & (s <= high)]
                k = s.astype(np.int64)
                k -= low
                k >>= bits
                if not few:
                    n += np.bincount(k, minlength=len(n))
            # few products are one part
            at, n = np.unique(k, return_counts=True) if few else (np.flatnonzero(n), n[n > 0])
            if not len(at):
                continue
            for c, v in (("a", a), ("b", b), ("at", (at << bits) + low), ("n", n), ("peak", peak)):
                out[c].append(np.broadcast_to(v, at.shape))
        return pa.table({c: np.concatenate(v).astype(np.int64) for c, v in out.items()})

    sent = side(0, "a", "i").unionByName(side(1, "b", "j")).repartition(min(calls, 2000), "t")
    found = sent.groupBy("t").applyInArrow(tally, "a long, b long, at long, n long, peak long")
    found = found.groupBy("a", "b", "at").agg(F.sum("n").alias("n"), F.max("peak").alias("peak")).join(pairs, ["a", "b"])
    upto = found.withColumn("upto", F.col("under") + F.sum("n").over(W.partitionBy("a", "b").orderBy("at")))
    products = F.col("na") * F.col("nb")
    holds = lambda r: F.min(F.when(F.col("upto") > r, F.col("at")))
    low, high = F.floor((products - 1) / 2), F.floor(products / 2)
    below = F.max(F.when(F.col("upto") <= low, F.col("upto")).otherwise(F.col("under")))
    return upto.groupBy("a", "b", "na", "nb", "step").agg(holds(low).alias("x"), holds(high).alias("y"), F.max("peak").alias("peak"), below.alias("under"))


def ensemble_labels(rows: DataFrame, purity: float = 0.75, overlap: int = 2, mint: bool = True, least: int = 4, rescue: float = 0.60) -> DataFrame:
    """``id, cluster, cluster_probability, label_source`` from ``rows(id, hdb, snn, probability)``.

    Noise of the first labelling takes the first label that most of its second cluster has (source 1), or a new id if
    its second cluster maps to none and is large (source 2). New ids follow the largest label by size, then by id.
    """
    both = rows.where("hdb <> -1 and snn <> -1").groupBy("snn", "hdb").agg(F.count("*").alias("n"))
    w = W.partitionBy("snn")
    best = both.withColumn("all", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "hdb"))).where("k = 1")
    mapped = best.where((F.col("n") / F.col("all") >= purity) & (F.col("n") >= overlap)).select("snn", F.col("hdb").alias("to"))
    out = rows.join(mapped, "snn", "left")
    rescued = (F.col("hdb") == -1) & F.col("to").isNotNull()
    if mint:
        sizes = rows.where("snn <> -1").groupBy("snn").agg(F.count("*").alias("n")).join(mapped, "snn", "left_anti").where(F.col("n") >= least)
        # the next id is taken after noise has been rescued, which adds no larger label
        top = rows.agg(F.max("hdb").alias("top"))
        ids = sizes.crossJoin(F.broadcast(top)).select("snn", (F.col("top") + F.row_number().over(W.orderBy(F.desc("n"), "snn"))).alias("new"))
        out = out.join(ids, "snn", "left")
    else:
        out = out.withColumn("new", F.lit(None).cast("bigint"))
    minted = (F.col("hdb") == -1) & F.col("to").isNull() & F.col("new").isNotNull()
    label: Column = F.when(rescued, F.col("to")).when(minted, F.col("new")).otherwise(F.col("hdb"))
    source = F.when(rescued, 1).when(minted, 2).otherwise(0)
    prob = F.when(rescued | minted, F.lit(rescue)).otherwise(F.col("probability"))
    return out.select("id", label.cast("bigint").alias("cluster"), prob.alias("cluster_probability"), source.alias("label_source"))
