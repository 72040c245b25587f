"""Joins whose hot keys are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(left: DataFrame, right: DataFrame, on: list[str], total: int) -> DataFrame:
    """left join right on ``on``, where ``right`` has one row a key and the number ``n`` of its rows in ``left``.

    Keys with over a thousandth of all ``total`` rows are fewer than a thousand, so these are broadcast and their rows
    stay where they are; no task of the shuffle gets more than a thousandth of the rows by one key.
    """
    hot = right.where(F.col("n") * 1000 > F.lit(total))
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col("n") * 1000 <= F.lit(total)), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)
