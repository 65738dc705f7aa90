"""Exact ranks within groups, without any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct values of each group (without null ones) with their number n, how many are at or below each (upto), and the group's total.

    Values are counted before the shuffle, then dealt by ranges of (group, value), so a group of any size is spread over tasks. What a range's first
    group has in the ranges before comes from a row for each range and group that begins or ends there.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", *by)
    ranged = ranged.withColumn("_upto", F.sum("n").over(inside.orderBy(value)))
    parts = ranged.groupBy("_part", *by).agg(F.sum("n").alias("_n"))
    # Only a group that is in several ranges has more than one row here.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in ("_part", *by)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return ranged.alias("r").join(parts.alias("q"), cond).select(*[F.col(f"r.{c}") for c in (*by, value)], "n", (F.col("_upto") + F.col("_before")).alias("upto"), "total")


def at_place(value: str, place: Column) -> Column:
    """An aggregate over rows of counted: the value at a place (from 0) of the group's sorted values."""
    return F.min(F.when(F.col("upto") > place, F.col(value)))


def percentile(value: str, p: float) -> Column:
    """An aggregate over rows of counted: the percentile, interpolated between the two values beside its place."""
    at = F.lit(p) * (F.col("total") - 1)
    low, high, part = at_place(value, F.floor(at)), at_place(value, F.ceil(at)), F.max(at - F.floor(at))
    return low * (1 - part) + high * part
