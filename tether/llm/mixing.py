"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Rates r minimise the relative entropy to one copy of each document, subject to each source's token total and to
r <= cap. The dual solution is r = min(cap, exp(lambda_s * x)) with x the document's size over its source's mean, and
each lambda_s is the root of one increasing function, found by safeguarded Newton steps for all sources at once over
the (source, size) histogram. Rates become whole copies by passing the rounding error on within groups of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tether.runtime.scratch import Scratch

#: Most copies of a document, and most times its size that a source's target may be.
CAP = 3
#: Documents in a rounding group, on average.
GROUP = 256
#: Beyond this exponent a rate is at the cap for every size that matters.
STEEPEST = 1.0e6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """Adds ``target`` to one row a source ``(source, source_size)``: shares of the total by the weights repeated over
    the sources by code point (null last), at most ``cap`` times a source's size, the excess reshared by weight.

    The common level L (target = min(cap * size, L * weight)) is found where the sources, sorted by size / weight,
    stop being at their cap. Sources of size 0 get 0.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    top = F.col("source_size") * F.lit(float(cap))
    s = sources.withColumn("w", w).withColumn("ratio", top / F.col("w"))
    by = W.orderBy("ratio", F.col("source").isNull(), "source")
    every = W.partitionBy()
    before = F.coalesce(F.sum(top).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("level", (F.col("total") - before) / ahead)
    # the first source in this order whose level is below its ratio fixes the level; without one all are capped
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("level")))
    level = F.min(fits).over(every)["level"]
    return s.withColumn("target", F.coalesce(F.least(top, level * F.col("w")), top)).select("source", "source_size", "target")


def solve(histogram: DataFrame, goals: DataFrame, scratch: Scratch, cap: float = CAP, rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """``goals(source, source_size, target)`` with ``lam``: the root of sum(n * size * min(cap, exp(lam * x))) = target.

    ``histogram(source, size, n)`` has no sizes below 1. Newton steps outside the bracket become its middle.
    A target at the cap gets ``STEEPEST``. The bracket starts where every rate is the cap or almost nothing.
    """
    spark = histogram.sparkSession
    mean = F.col("source_size") / F.col("docs")
    docs = histogram.groupBy("source").agg(F.sum("n").alias("docs"))
    state = goals.join(docs.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).where("source_size > 0")
    state = state.select("source", "source_size", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(-STEEPEST).alias("lo"), F.lit(STEEPEST).alias("hi"), (F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))).alias("done"))
    state = scratch.save(state, "dual")
    for _ in range(rounds):
        if state.where("not done").limit(1).count() == 0:
            break
        h = histogram.join(F.broadcast(state.where("not done").select(F.col("source").alias("s2"), "lam", "mean")), F.col("source").eqNullSafe(F.col("s2")))
        x = F.col("size") / F.col("mean")
        e = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        mass = F.col("n") * F.col("size")
        free = e < cap
        sums = h.groupBy(F.col("s2")).agg(F.sum(mass * F.least(e, F.lit(float(cap)))).alias("have"), F.sum(F.when(free, mass * x * e).otherwise(0.0)).alias("slope"))
        gap = F.col("have") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # with an open side, a step beyond the bracket doubles instead of halving the whole range
        inside = (step > lo) & (step < hi) & (F.abs(step - F.col("lam")) <= F.greatest(F.lit(4.0), F.abs(F.col("lam"))))
        wide = F.when(gap < 0, F.when(F.col("hi") >= STEEPEST, F.greatest(F.lit(1.0), F.col("lam") * 2)).otherwise((lo + hi) / 2)).otherwise(
            F.when(F.col("lo") <= -STEEPEST, F.least(F.lit(-1.0), F.col("lam") * 2)).otherwise((lo + hi) / 2)
        )
        settled = F.abs(gap) <= F.col("target") * tol
        s = state.join(F.broadcast(sums), F.col("source").eqNullSafe(F.col("s2")), "left")
        done = F.col("done") | F.coalesce(settled, F.lit(True)) | (F.abs(hi - lo) < 1e-13)
        lam = F.when(F.coalesce(done, F.lit(True)), F.col("lam")).when(inside, step).otherwise(wide)
        new = scratch.save(s.select("source", "source_size", "target", "mean", lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), F.coalesce(done, F.lit(True)).alias("done")), "dual")
        scratch.drop(state)
        state = new
    top = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))
    # rounding makes the rates the same in a rerun that adds in another order
    return state.select("source", "source_size", "target", "mean", F.when(top, F.lit(STEEPEST)).otherwise(F.round("lam", 9)).alias("lam"))


def copies_of(rated: DataFrame, cap: int = CAP, group: int = GROUP) -> DataFrame:
    """``rated(doc_id, size, source, source_docs, rate, ...)`` with ``copies``: whole numbers from 0 to ``cap``.

    Documents fall by a hash of doc_id into groups of about ``group`` documents of one source. Within a group, from
    the largest to the smallest document, the copies are the nearest number to rate * size plus the words still owed,
    so that a group's total ends near its expectation. Documents of size 0 get rate 1, one copy.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / group))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(23)), n)
    item = F.struct((-F.col("size")).alias("neg"), F.xxhash64("doc_id", F.lit(29)).alias("tie"), "doc_id", "size", "rate")
    grouped = rated.groupBy("source", spot.alias("spot")).agg(F.sort_array(F.collect_list(item)).alias("items"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    def step(acc, i):
        owed = acc["owed"] + i["rate"] * i["size"]
        c = F.when(i["size"] == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.floor(owed / i["size"] + 0.5).cast("double"))))
        return F.struct((owed - c * i["size"]).alias("owed"), F.concat(acc["out"], F.array(c.cast("int"))).alias("out"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("out"))
    counted = grouped.withColumn("out", F.aggregate("items", start, step, lambda a: a["out"]))
    flat = counted.select("source", "source_size", "target", F.explode(F.arrays_zip("items", "out")).alias("z"))
    return flat.select(F.col("z.items.doc_id").alias("doc_id"), F.col("z.items.size").alias("size"), "source", "source_size", "target", F.col("z.out").alias("copies"))


def mix(docs: DataFrame, scratch: Scratch | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Copies of each row of ``docs(doc_id, source, text)``: ``doc_id, size, source, source_size, target, copies``.

    One row for each input row, repeated rows and null ids included; other columns are not carried. Null text has
    size 0. Empty input gives no rows. Ties between documents of one size go by a hash of doc_id.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sized = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    # the histogram has at most one row for each size that occurs in a source
    histogram = scratch.save(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    goals = targets(sources.select("source", "source_size"), weights, cap)
    dual = solve(histogram.where("size > 0"), goals, scratch, cap)
    per = goals.join(dual.select(F.col("source").alias("s2"), "mean", "lam"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    per = per.join(sources.select(F.col("source").alias("s3"), "source_docs"), F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    per = scratch.save(per.withColumnRenamed("source", "s4"), "per_source")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))
    # one row a source: as small as the catalogue of sources
    rated = sized.join(F.broadcast(per), F.col("source").eqNullSafe(F.col("s4"))).drop("s4").withColumn("rate", F.coalesce(rate, F.lit(1.0)))
    return copies_of(rated, cap)
