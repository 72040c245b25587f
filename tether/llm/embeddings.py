"""Near-duplicate vectors: int8 tile products with proven error bounds, full precision where the bound leaves doubt.

Equal vectors are one class. Each unit vector x is s * q + t * r + e: q and r are int8 codes, r of what q leaves, and
only these travel. Classes fall to the nearest of a bounded number of pivots and, within a pivot, by hash into blocks
of about ``block`` vectors. Two blocks can hold a link only if the angle between their pivots is at most the sum of
their radii and of the threshold's angle; other pairs of blocks are never made. In a tile, x.y differs from
s_x s_y q_x.q_y by at most |d_x| + (1 + |d_x|) |d_y|, with d what the first codes miss. Pairs that this leaves possibly
at the threshold are told by both codes, whose error is some 250 times smaller; the few that even these leave in doubt
are computed anew from the full vectors in double precision. A tile returns link counts, a spanning forest of its sure
links and the pairs in doubt, not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.operators.graph import connected_components
from tether.runtime.scratch import Scratch

THRESHOLD = 0.9
BLOCK = 8192
#: Most pivots; they and the angles between them are sent to every task.
PIVOTS = 256
#: Rows of a tile that are multiplied at once.
ROWS = 512
#: Columns of an encoded vector: codes, scale and error, and those of the rest.
CODES = ["q", "s", "e", "r", "t", "f"]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows are first divided by their largest component, so none is too small or too large."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of rows; a row of zeros has codes and error 0."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / np.where(scale > 0, scale, 1.0)[:, None])
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-12) + 1e-15
    return codes.astype(np.int8), scale, error


def encode(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes, scale and error of raw vectors, and the same of what the first codes leave of the unit vectors."""
    u = unit(x)
    q, s, e = quantise(u)
    r, t, f = quantise(u - q * s[:, None])
    return q, s, e, r, t, f


def links_of(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, threshold: float):
    """Yields (i, j, sure) for pairs of encoded vectors whose cosine reaches the threshold or may do so.

    Without b, pairs within ``a`` with i < j.
    """
    same = b is None
    b = a if same else b
    exact = np.float32 if a[0].shape[1] <= 1040 else np.float64  # for sums of products of codes
    qa, qb = a[0].astype(exact), b[0].astype(exact)
    fine_a, fine_b = (x[0] * x[1][:, None] + x[3] * x[4][:, None] for x in (a, b))
    # a little is taken off for the rounding of the products in float32
    least = (threshold - 1e-5 - a[2] - (1 + a[2]) * b[2].max()) / a[1]
    scale = b[1].astype(np.float32)
    for r in range(0, len(qa), ROWS):
        begin = r if same else 0
        rough = qa[r : r + ROWS] @ qb[begin:].T
        rough *= scale[begin:]
        i, j = np.nonzero(rough >= least[r : r + ROWS, None].astype(np.float32))
        i += r
        j += begin
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65536):
            x, y = i[k : k + 65536], j[k : k + 65536]
            cosine = np.einsum("ij,ij->i", fine_a[x], fine_b[y])
            slack = a[5][x] + (1 + a[5][x]) * b[5][y] + 1e-12
            yes = cosine >= threshold - slack
            if yes.any():
                yield x[yes], y[yes], cosine[yes] >= threshold + slack[yes]


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j in ``label``, where every entry points to a smaller or the same one."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label[:] = label[label]


def usable(c: str):
    """Whether a vector has length and only finite components."""
    v = F.col(c)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``rows(vec_id, embedding, ...)``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Vectors of different
    lengths do not link. Equal vectors link with each other; n_links counts rows. A null vec_id is never the smallest
    one. Vectors of any length count, the smallest and the largest included. Other columns are not read; empty input
    gives no rows.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    good = rows.where(usable("v"))
    classes = good.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).where("node is not null")
    classes = scratch.save(classes, "classes")
    total = classes.count()
    wanted = max(1, min(PIVOTS, -(-total // block)))
    chosen = [np.array(r["v"]) for r in classes.orderBy(F.xxhash64("node"), "node").limit(wanted).collect()]
    pivots = [unit(p[None])[0] for p in chosen]
    reach = math.acos(threshold)

    def nearest(batches):
        for batch in batches:
            v = batch.column(2)
            size = np.diff(v.offsets.to_numpy())
            which, angle = np.zeros(len(v), np.int32), np.full(len(v), math.pi)
            parts = [[None] * len(v) for _ in range(6)]
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                fit = [k for k, p in enumerate(pivots) if len(p) == d]
                x = np.array(v.take(pa.array(own)).flatten()).reshape(-1, d)
                if fit:
                    c = unit(x) @ np.array([pivots[k] for k in fit]).T
                    which[own] = np.array(fit, np.int32)[c.argmax(axis=1)]
                    angle[own] = np.arccos(np.clip(c.max(axis=1), -1, 1))
                for part, col in zip(parts, encode(x)):
                    for k, y in zip(own.tolist(), col):
                        part[k] = y.tobytes() if col.ndim == 2 else float(y)
            codes = [pa.array(c, pa.binary() if k % 3 == 0 else pa.float64()) for k, c in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(which), pa.array(angle), *codes], ["node", "n", "pivot", "angle", *CODES])

    kinds = "node long, n long, pivot int, angle double, q binary, s double, e double, r binary, t double, f double"
    near = scratch.save(classes.select("node", "n", "v").mapInArrow(nearest, kinds), "near")
    sizes = {r["pivot"]: r["c"] for r in near.groupBy("pivot").agg(F.count("*").alias("c")).collect()}
    parts = F.create_map(*[F.lit(x) for k, c in sizes.items() for x in (k, -(-c // block))]) if sizes else F.lit(None).cast("map<int,int>")
    placed = near.withColumn("block", F.struct(F.col("pivot"), F.pmod(F.xxhash64("node", F.lit(7)), parts[F.col("pivot")]).cast("int").alias("part")))

    # one row a block, a few thousandths of the vectors, stays distributed
    radius = placed.groupBy("block").agg(F.max("angle").alias("radius"))
    between = [(i, j, float(np.arccos(np.clip(p @ q, -1, 1))) if len(p) == len(q) else 0.0) for i, p in enumerate(pivots) for j, q in enumerate(pivots)]
    between = spark.createDataFrame(between, "p int, q int, apart double")
    x = radius.select(F.col("block").alias("a"), F.col("radius").alias("ra"), F.col("block.pivot").alias("p"))
    y = radius.select(F.col("block").alias("b"), F.col("radius").alias("rb"), F.col("block.pivot").alias("q"))
    tiles = x.join(between, "p").join(y, "q").where((F.col("a") <= F.col("b")) & (F.col("apart") <= F.col("ra") + F.col("rb") + F.lit(reach + 1e-9)))
    tiles = scratch.save(tiles.select("a", "b"), "tiles")
    one = placed.join(tiles, placed["block"] == tiles["a"]).select("a", "b", F.lit(0).alias("side"), "node", "n", *CODES)
    two = placed.join(tiles, placed["block"] == tiles["b"]).where("a <> b").select("a", "b", F.lit(1).alias("side"), "node", "n", *CODES)

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, n, side = (table.column(c).to_numpy() for c in ("node", "n", "side"))
        size = np.array([len(q) for q in table.column("q").to_pylist()])
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        doubt: list[np.ndarray] = []
        two_sided = bool(side.any())

        def codes(at: np.ndarray) -> tuple[np.ndarray, ...]:
            some = table.select(CODES).take(pa.array(at))
            return tuple(np.frombuffer(b"".join(some.column(c).to_pylist()), np.int8).reshape(len(at), -1) if c in "qr" else some.column(c).to_numpy() for c in CODES)

        for d in np.unique(size).tolist():
            left, right = np.flatnonzero((size == d) & (side == 0)), np.flatnonzero((size == d) & (side == 1))
            if two_sided and not (len(left) and len(right)):
                continue
            for i, j, sure in links_of(codes(left), codes(right) if two_sided else None, threshold):
                i, j = left[i], (right if two_sided else left)[j]
                doubt.append(np.stack([node[i[~sure]], node[j[~sure]]]))
                i, j = i[sure], j[sure]
                links += np.bincount(i, n[j], len(node)).astype(np.int64) + np.bincount(j, n[i], len(node)).astype(np.int64)
                hook(label, i, j)
        some = np.flatnonzero(links)
        unsure = np.concatenate(doubt, axis=1) if doubt else np.zeros((2, 0), np.int64)
        return pa.table({"node": np.append(node[some], unsure[0]), "links": np.append(links[some], np.full(unsure.shape[1], -1)), "other": np.append(node[label[some]], unsure[1])})

    def settle(batches):
        for batch in batches:
            a, b = (unit(np.array(batch.column(k).flatten()).reshape(batch.num_rows, -1)) for k in (4, 5)) if batch.num_rows and len(set(np.diff(batch.column(4).offsets.to_numpy()))) == 1 else (None, None)
            if a is not None:
                cosine = np.einsum("ij,ij->i", a, b)
            else:
                cosine = np.array([float(np.dot(*(unit(np.array(v, float)[None])[0] for v in w))) for w in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(cosine >= threshold, pa.bool_())) for c in batch.columns[:4]], ["x", "y", "nx", "ny"])

    schema = "node long, links long, other long"
    found = scratch.save(one.unionByName(two).groupBy("a", "b").applyInArrow(tile, schema), "found")
    # a link in doubt is settled from the full vectors
    full = classes.select("node", "n", "v")
    doubt = found.where("links = -1").select(F.col("node").alias("x"), F.col("other").alias("y"))
    doubt = doubt.join(full.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("v").alias("vx")), "x")
    doubt = doubt.join(full.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("v").alias("vy")), "y")
    settled = scratch.save(doubt.select("x", "y", "nx", "ny", "vx", "vy").mapInArrow(settle, "x long, y long, nx long, ny long"), "settled")
    ends = settled.select("x", F.col("ny").alias("links"), "y").toDF("node", "links", "other").unionByName(settled.select("y", "nx", "x").toDF("node", "links", "other"))
    found_all = found.where("links >= 0").unionByName(ends)
    counts = found_all.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found_all.select(F.col("node").alias("src"), F.col("other").alias("dst")), scratch)
    told = classes.join(counts, "node", "left").join(groups.withColumnRenamed("vertex", "node"), "node", "left")
    told = told.select("v", F.coalesce("component_id", "node").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    told = scratch.save(told, "told")
    scratch.drop(near, tiles, found, settled)
    out = rows.withColumn("v", F.when(usable("v"), F.col("v"))).join(told, "v", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
