"""Character n-gram TF-IDF as a postings table, and string similarity over it.

Weights are (1 + ln tf) (or tf) times ln((1 + n) / (1 + df)) + 1, each string's row having length 1; n and df count
distinct strings of the corpus. Grams in fewer than ``min_df`` strings are left out before the rows are scaled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tether.functions.text import char_ngrams, squeeze


def counts(strings: DataFrame, by: tuple[str, ...] = (), s: str = "s") -> DataFrame:
    """(by..., s, gram, tf) of distinct strings; grams are taken from the lower-case text with single blanks."""
    clean = F.regexp_replace(F.lower(F.col(s)), r"\s+", " ")
    grams = strings.select(*by, s).distinct().select(*by, s, F.explode(char_ngrams(clean)).alias("gram"))
    return grams.groupBy(*by, s, "gram").agg(F.count("*").alias("tf"))


def idf(strings: DataFrame, by: tuple[str, ...] = (), min_df: int = 2, s: str = "s") -> DataFrame:
    """(by..., gram, df, idf) of a corpus."""
    n = strings.select(*by, s).distinct().groupBy(*by).agg(F.count("*").alias("n"))
    df = counts(strings, by, s).groupBy(*by, "gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    both = df.join(F.broadcast(n), list(by)) if by else df.crossJoin(F.broadcast(n))
    return both.select(*by, "gram", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def postings(strings: DataFrame, by: tuple[str, ...] = (), min_df: int = 2, sublinear: bool = True, s: str = "s", table: DataFrame | None = None) -> DataFrame:
    """(by..., s, gram, df, w) of distinct strings, with a corpus's ``table`` from ``idf`` if given."""
    table = idf(strings, by, min_df, s) if table is None else table
    tf = 1.0 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = counts(strings, by, s).join(table, [*by, "gram"]).withColumn("raw", tf * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*by, s)))
    return raw.select(*by, s, "gram", "df", (F.col("raw") / length).alias("w"))


def pair_similarity(pairs: DataFrame, a: str = "a", b: str = "b", min_df: int = 2, exact_is_one: bool = False, table: DataFrame | None = None, out: str = "similarity") -> DataFrame:
    """``pairs`` with the cosine of two string columns; see ``pair_similarities``."""
    return pair_similarities(pairs, {out: (a, b)}, min_df, exact_is_one, table)


def pair_similarities(pairs: DataFrame, kinds: dict[str, tuple[str, str]], min_df: int = 2, exact_is_one: bool = False, table: DataFrame | None = None) -> DataFrame:
    """``pairs`` with a column for each pair of string columns in ``kinds``: their cosine.

    The corpus of a column is the distinct strings of its two, null being ''. Only distinct pairs are computed. Strings
    without a common gram have 0. With ``exact_is_one`` equal strings that are not empty have 1, also where all their
    grams are too rare to count.
    """
    out = pairs
    for name, (a, b) in kinds.items():
        x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
        distinct = pairs.select(x.alias("_a"), y.alias("_b")).distinct()
        corpus = distinct.select(F.col("_a").alias("s")).union(distinct.select(F.col("_b").alias("s"))).distinct()
        p = postings(corpus, min_df=min_df, table=table)
        left = p.select(F.col("s").alias("_a"), "gram", F.col("w").alias("wa"))
        right = p.select(F.col("s").alias("_b"), "gram", F.col("w").alias("wb"))
        dots = distinct.join(left, "_a").join(right, ["_b", "gram"]).groupBy("_a", "_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("_dot"))
        out = out.withColumn("_a", x).withColumn("_b", y).join(dots, ["_a", "_b"], "left")
        value: Column = F.coalesce("_dot", F.lit(0.0))
        if exact_is_one:
            value = F.when((F.col("_a") == F.col("_b")) & (F.col("_a") != ""), F.lit(1.0)).otherwise(value)
        out = out.withColumn(name, value).drop("_a", "_b", "_dot")
    return out


def similarity_join(strings: DataFrame, threshold: float, min_df: int = 2, strict: bool = True, s: str = "s", table: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) with a < b of the distinct strings whose cosine, to six digits, is above the threshold.

    Candidates come from a prefix filter that loses no pair: with each string's grams in one global order, commonest
    first, two strings above the threshold share a gram past the point where the squared weights so far reach the
    threshold's square. Common grams, whose postings are long, are thus hardly ever joined.
    A corpus's ``table`` from ``idf`` makes the result independent of which other strings are given.
    """
    p = postings(strings, min_df=min_df, s=s, table=table).withColumnRenamed(s, "s")
    order = W.partitionBy("s").orderBy(F.desc("df"), "gram").rowsBetween(W.unboundedPreceding, 0)
    rare = p.withColumn("run", F.sum(F.col("w") * F.col("w")).over(order)).where(F.col("run") >= (threshold - 1e-6) ** 2 - 1e-9)
    x = rare.select("gram", F.col("s").alias("a"))
    y = rare.select("gram", F.col("s").alias("b"))
    candidates = x.join(y, "gram").where("a < b").select("a", "b").distinct()
    wa = p.select(F.col("s").alias("a"), "gram", F.col("w").alias("wa"))
    wb = p.select(F.col("s").alias("b"), "gram", F.col("w").alias("wb"))
    dots = candidates.join(wa, "a").join(wb, ["b", "gram"]).groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity"))
    return dots.where((F.col("similarity") > threshold) if strict else (F.col("similarity") >= threshold))


def both_alike(left: DataFrame, right: DataFrame, names: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``left(a, c, ...)`` and ``right(b, d, ...)`` whose ``a, b`` are in ``names`` and whose ``c, d`` are in ``keys``.

    Neither list is joined in full first: each row of ``left`` with an alike name ``b`` looks either at the rows of
    ``right`` of that name or at the keys alike to its own, whichever are fewer. A name at many addresses thus
    does not make a pair of each two of them.
    """
    held = right.groupBy("b").agg(F.count("*").alias("_held"))
    near = keys.groupBy("c").agg(F.count("*").alias("_near"))
    half = left.join(names, "a").join(held, "b").join(near, "c")
    by_name = half.where("_held <= _near").join(right, "b").join(keys, ["c", "d"])
    by_key = half.where("_held > _near").join(keys, "c").join(right, ["b", "d"])
    return by_name.unionByName(by_key).drop("_held", "_near")
