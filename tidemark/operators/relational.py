"""Relational extension: the shapes of joins, groupings and windows that need more than one built-in call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the plan limits groups before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def interval_join(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points and the ranges [start, end) that hold them: equi-joined on key and time bins, so that no key meets all of itself."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(r, [*key, "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its key at or before it; union and a running last value, no pairs."""
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    l_kind = left.select(F.struct("*").alias("l")).schema["l"].dataType
    a = left.select(*key, at, F.lit(1).alias("_o"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind).alias("_v"))
    b = right.select(*key, at, F.lit(0).alias("_o"), F.lit(None).cast(l_kind).alias("_l"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*key).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_o = 1")
    return rows.select("_l.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def salted_join(big: DataFrame, small: DataFrame, key: list[str], salts: int = 8) -> DataFrame:
    """Inner join whose hot keys are spread over salts: big's rows take one, small's rows all."""
    b = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*key, "_salt"]).drop("_salt")


def sessionise(events: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """(by, start, end, n) of runs of events with gaps of at most gap."""
    w = Window.partitionBy(by).orderBy(at)
    rows = events.withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "_s").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_s")
