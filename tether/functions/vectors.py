"""Column expressions over vectors (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def energy(v: Column) -> Column:
    """The squared length."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def l2_normalize(v: Column, epsilon: float = 1e-8) -> Column:
    n = F.sqrt(energy(v)) + F.lit(epsilon)
    return F.transform(v, lambda x: x / n)


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def mean_energies(df: DataFrame, names: list[str]) -> dict[str, float]:
    """The mean squared length of each vector column, 0 without rows."""
    means = df.agg(*[F.coalesce(F.avg(energy(F.col(k))), F.lit(0.0)).alias(k) for k in names]).first()
    return means.asDict()


def balance_streams(df: DataFrame, proportions: dict[str, float], epsilon: float = 1e-8, energies: dict[str, float] | None = None) -> DataFrame:
    """Scales each stream (a vector column) by sqrt(proportion / (mean energy + epsilon)).

    The proportions of the streams present are scaled to sum to 1; a stream that is not named gets none of them.
    The energies are those of ``df`` unless a corpus's are given, which make the result independent of the other rows.
    """
    present = {k: p for k, p in proportions.items() if k in df.columns}
    total = sum(present.values())
    out = df
    if energies is None:
        means = df.agg(*[F.avg(energy(F.col(k))).alias(f"_{k}") for k in present])
        out = df.crossJoin(F.broadcast(means))  # one row
    for k, p in present.items():
        mean = F.col(f"_{k}") if energies is None else F.lit(energies[k])
        out = out.withColumn(k, scale(F.col(k), F.sqrt(F.lit(p / total) / (mean + F.lit(epsilon)))))
    return out.drop(*[f"_{k}" for k in present])
