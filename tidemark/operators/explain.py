"""What surrounds a failure: the operations that witness it, their interval, and the trace events inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Event kinds that say something about a cluster's course.
TELLING = ("RoleChange", "Commit", "Apply", "ConfChange", "SnapshotInstall", "Fault")
MOST_OPERATIONS, MOST_EVENTS = 16, 128


def witnesses(history: DataFrame, ids: DataFrame | None = None, most: int = MOST_OPERATIONS) -> DataFrame:
    """The operations whose id is in ids(id); where there are none, the first ones of the history by place (ord)."""
    first = history.orderBy("ord").limit(most)
    if ids is None:
        return first
    named = history.join(ids.select("id").distinct(), "id", "left_semi")
    none = ids.limit(1).agg((F.count("*") == 0).alias("_none"))
    return named.unionByName(first.join(F.broadcast(none), F.col("_none")).drop("_none"))  # one row on the right


def bounds(operations: DataFrame) -> DataFrame:
    """(first, last): the earliest invocation and the latest completion; the former for both if none completed."""
    return operations.agg(F.coalesce(F.min("invoke"), F.lit(0)).alias("first"), F.max("complete").alias("last")).select("first", F.coalesce("last", "first").alias("last"))


def window_events(trace: DataFrame, operations: DataFrame, time: str = "time_ns", kinds: tuple[str, ...] | None = TELLING) -> DataFrame:
    """Events of some kinds within the interval of the operations, its ends included."""
    rows = trace if kinds is None else trace.filter(F.col("kind").isin(*kinds))
    return rows.join(F.broadcast(bounds(operations)), F.col(time).between(F.col("first"), F.col("last"))).drop("first", "last")  # one row


def explain(anomalies: DataFrame, history: DataFrame, trace: DataFrame, ids: DataFrame | None = None, time: str = "time_ns") -> DataFrame:
    """(part, at, text) of a failure: the anomaly, its operations, the events around them, and the nodes that these name.

    The anomaly is the first of anomalies(class, operation_ids, predicate) by class and ids that is classified. At most
    MOST_EVENTS events are shown, by seq; the summary counts all. It is evidence to read, not a claim about a cause.
    """
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("open"))
    chosen = anomalies.orderBy(F.col("class") == "unclassified", "class", "operation_ids").limit(1)
    head = chosen.select(F.lit("anomaly").alias("part"), F.lit(0).cast("bigint").alias("at"), F.concat_ws(" ", "class", "predicate").alias("text"))
    ops = witnesses(history, ids)
    rows = ops.select(F.lit("operation").alias("part"), F.col("id").alias("at"), F.format_string("client %s seq %s %s..%s %s %s", F.col("client"), F.col("sequence"), F.col("invoke"), show("complete"), F.col("kind"), F.col("outcome")).alias("text"))
    inside = window_events(trace, ops, time)
    shown = inside.orderBy("seq").limit(MOST_EVENTS).select(F.lit("event").alias("part"), F.col("seq").alias("at"), F.format_string("%s node %s %s", F.col(time), F.coalesce(F.col("node").cast("string"), F.lit("-")), F.col("kind")).alias("text"))
    nodes = F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda n: n.cast("string")), ",")
    summary = inside.agg(F.count("*").alias("n"), nodes.alias("nodes")).select(F.lit("summary").alias("part"), F.lit(0).cast("bigint").alias("at"), F.format_string("%d events of nodes %s", F.col("n"), F.col("nodes")).alias("text"))
    return head.unionByName(rows).unionByName(shown).unionByName(summary)
