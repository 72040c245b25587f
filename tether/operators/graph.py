"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.runtime.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 100) -> DataFrame:
    """Weakly connected components of ``edges(src, dst)`` as ``(vertex, component_id)``, the id being the smallest member.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) as joins and grouped minima, so a hub's
    neighbours never meet in one task. Each round is written to the shared folder. Only vertices with an edge to
    another vertex appear; loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = scratch.save(e.where("u > v").distinct(), "cc")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        scratch.drop(e)
        e, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("vertex"), F.col("v").alias("component_id"))
    return stars.unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component_id")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]
