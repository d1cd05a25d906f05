"""The clamped log clock: a running maximum over a whole log without one task for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def running_max(log: DataFrame, order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """log with the largest value so far. Rows are windowed in spans of order; a span's start comes from the spans before it.

    order is an integer that is dense enough for spans of span numbers to hold few rows. Spans are windowed in spans of
    their own, so the one window over everything has a row for each span * span numbers.
    """
    rows = log.withColumn("_span", F.floor(F.col(order) / span))
    tops = rows.groupBy("_span").agg(F.max(value).alias("_top")).withColumn("_wide", F.floor(F.col("_span") / span))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    wide = tops.groupBy("_wide").agg(F.max("_top").alias("_most")).select("_wide", F.max("_most").over(before.orderBy("_wide")).alias("_from"))
    near = F.max("_top").over(before.partitionBy("_wide").orderBy("_span"))
    tops = tops.withColumn("_near", near).join(wide, "_wide").select("_span", F.greatest("_near", "_from").alias("_before"))
    inside = F.max(value).over(Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(tops, "_span").withColumn(name, F.greatest(inside, F.col("_before"))).drop("_span", "_before")
