"""Exact quantile rules over a column, by group: none of them is an approximation, none interpolates.

Ranks come from counts of distinct values (pre-aggregated before the shuffle), so a group's rows never meet in one task;
only its distinct values are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, upto, total): rows of each value, of all up to it and of the group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(value)
    return counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))


def _at(hist: DataFrame, by: list[str], value: str, place, name: str) -> DataFrame:
    """The value at a zero-based place of the ordered rows."""
    return hist.filter((F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))).groupBy(*by).agg(F.min(value).alias(name))


def floor_index(df: DataFrame, by: list[str], value: str, num: int, den: int, name: str) -> DataFrame:
    """sorted[(n - 1) * num div den]."""
    return _at(histogram(df, by, value), by, value, F.floor((F.col("total") - 1) * num / den), name)


def nearest_rank(df: DataFrame, by: list[str], value: str, percent: int, name: str) -> DataFrame:
    """sorted[max(0, ceil(n * percent / 100) - 1)]."""
    return _at(histogram(df, by, value), by, value, F.greatest(F.lit(0), F.ceil(F.col("total") * percent / 100) - 1), name)


def weighted_nearest_rank(df: DataFrame, by: list[str], value: str, weight: str, num: int, den: int, name: str) -> DataFrame:
    """The least value whose cumulative weight reaches max(1, ceil(total * num / den))."""
    counts = df.groupBy(*by, value).agg(F.sum(weight).alias("n"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return upto.filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * num / den))).groupBy(*by).agg(F.min(value).alias(name))


def buckets(df: DataFrame, by: list[str], value: str, count: int = 16) -> DataFrame:
    """(by, bucket, value): sorted[min(n - 1, bucket * n div count)] for each bucket."""
    hist = histogram(df, by, value)
    each = hist.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    place = F.least(F.col("total") - 1, F.floor(F.col("bucket") * F.col("total") / count))
    return each.filter((F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))).select(*by, "bucket", value)
