"""Event traces: invariants, filters, statistics, difference, n-gram coverage, beacons, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEACONS = ("signup", "purchase", "error", "view", "click", "timeout")


def positions(trace: DataFrame, order: list, by: list[str] | None = None, span: int = 1 << 16) -> DataFrame:
    """trace with pos, each event's place in its run (by) by the order columns, the first of which is a number.

    Places come from counts of spans of that number and a window inside a span, so no task holds a whole trace.
    """
    by = by or []
    rows = trace.withColumn("_span", F.floor(F.col(order[0]) / span))
    counts = rows.groupBy(*by, "_span").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    starts = counts.select(*by, "_span", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_span").orderBy(*order)
    return rows.join(starts, [*by, "_span"]).withColumn("pos", F.col("_start") + F.row_number().over(inside) - 1).drop("_span", "_start")


def invariants(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Neighbouring events whose seq doesn't follow by one or whose time goes back; rows (name, at, detail).

    pos is an event's place in the trace as it was read: without it the place by seq, where only gaps can be seen.
    Neighbours are found by an equi-join on the place, not by a window over a trace.
    """
    by = by or []
    rows = trace if "pos" in trace.columns else positions(trace, ["seq"], by)
    left = rows.select(*by, F.col("pos"), F.col("seq").alias("a"), F.col("time_us").alias("ta"))
    right = rows.select(*by, (F.col("pos") - 1).alias("pos"), F.col("seq").alias("b"), F.col("time_us").alias("tb"))
    pairs = left.join(right, [*by, "pos"])
    order = pairs.filter("b <> a + 1").select(*by, F.lit("trace_sequence").alias("name"), F.col("pos").alias("at"), F.format_string("%d followed by %d", "a", "b").alias("detail"))
    time = pairs.filter("tb < ta").select(*by, F.lit("trace_time_order").alias("name"), F.col("pos").alias("at"), F.format_string("%dus followed by %dus", "ta", "tb").alias("detail"))
    return order.unionByName(time)


def select(trace: DataFrame, node: int | None = None, kinds: list[str] | None = None, since: int | None = None, until: int | None = None, grep: str | None = None) -> DataFrame:
    """Events that pass every given filter; since and until include their ends, grep is a part of the payload."""
    out = trace
    if node is not None:
        out = out.filter(F.col("node") == node)
    if kinds is not None:
        out = out.filter(F.col("kind").isin(*kinds))
    if since is not None:
        out = out.filter(F.col("time_us") >= since)
    if until is not None:
        out = out.filter(F.col("time_us") <= until)
    return out if grep is None else out.filter(F.col("payload").contains(grep))


def stats(trace: DataFrame) -> DataFrame:
    """(dimension, value, n) by kind and by node in one pass over the rows; an event without a node counts under '-'."""
    node = F.coalesce(F.col("node").cast("string"), F.lit("-"))
    sides = F.array(F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")), F.struct(F.lit("node").alias("dimension"), node.alias("value")))
    return trace.select(F.explode(sides).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def busiest(trace: DataFrame) -> DataFrame:
    """The instant with most events; of several the latest."""
    return trace.groupBy("time_us").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("time_us")).limit(1)


def tail(trace: DataFrame, n: int, most_bytes: int = 8 << 20) -> DataFrame:
    """The last n events, fewer where their payloads pass most_bytes. The window runs over at most n rows."""
    last = trace.orderBy(F.desc("seq")).limit(n)
    held = F.sum(F.octet_length("payload")).over(Window.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("_held", held).filter(F.col("_held") <= most_bytes).drop("_held")


def page(trace: DataFrame, cursor: int, limit: int, most_bytes: int) -> DataFrame:
    """Up to limit events from a cursor on, cut before the payloads pass most_bytes."""
    rows = trace.filter(F.col("seq") >= cursor).orderBy("seq").limit(limit)
    held = F.sum(F.octet_length("payload")).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("held", held).filter(F.col("held") <= most_bytes)


def first_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pos, field, left, right) of the first place at which two traces differ; no row for equal ones."""
    fields = ["time_us", "node", "kind", "payload"]
    x = a.select("pos", F.struct(*fields).alias("x"))
    y = b.select("pos", F.struct(*fields).alias("y"))
    both = x.join(y, "pos", "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    field = F.when(F.col("x").isNull() | F.col("y").isNull(), "length")
    left, right = F.when(F.col("x").isNull(), F.lit(None)), F.when(F.col("y").isNull(), F.lit(None))
    for f in fields:
        differs = ~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}"))
        field = field.when(differs, f)
        left = left.when(differs, F.col(f"x.{f}").cast("string"))
        right = right.when(differs, F.col(f"y.{f}").cast("string"))
    return both.select("pos", field.alias("field"), left.alias("left_value"), right.alias("right_value")).orderBy("pos").limit(1)


def ngrams(trace: DataFrame, widths: tuple[int, ...] = (1, 2, 3), by: list[str] | None = None) -> DataFrame:
    """(by, gram, first_at, n): distinct runs of kinds of each width. Neighbours come by joins on the place."""
    by = by or []
    rows = trace.select(*by, F.col("seq").alias("at"), "kind")
    out = rows.select(*by, "at", F.col("kind").alias("gram"))
    parts, grown = [out] if 1 in widths else [], out
    for n in range(2, max(widths) + 1):
        grown = grown.join(rows.select(*by, (F.col("at") - (n - 1)).alias("at"), F.col("kind").alias("_k")), [*by, "at"]).select(*by, "at", F.concat_ws(">", "gram", "_k").alias("gram"))
        if n in widths:
            parts.append(grown)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*by, "gram").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))


def novelty(coverage: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, new_grams): runs that are the first with some gram of coverage(run, gram)."""
    return coverage.groupBy("gram").agg(F.min(run).alias(run)).groupBy(run).agg(F.count("*").alias("new_grams"))


def beacons(trace: DataFrame, names: tuple[str, ...] = BEACONS) -> DataFrame:
    """(beacon, hits) for each name, 0 included: one aggregate row, unpivoted."""
    one = trace.agg(*[F.count_if(F.col("kind") == n).alias(n) for n in names])
    return one.unpivot([], list(names), "beacon", "hits")


def missing_beacons(trace: DataFrame, names: tuple[str, ...] = BEACONS) -> DataFrame:
    return beacons(trace, names).filter("hits = 0").select("beacon")


def diagram_rows(trace: DataFrame, lanes: int = 32, events: int = 500) -> DataFrame:
    """What a sequence diagram shows: the first events of the lanes with the smallest node ids."""
    kept = trace.select("node").distinct().orderBy("node").limit(lanes)
    return trace.join(F.broadcast(kept), "node").orderBy("seq").limit(events).select("seq", "time_us", "node", "kind")


def diagram_svg(rows: DataFrame) -> str:
    """Sequence diagram of diagram_rows (at most 500 rows)."""
    data = rows.orderBy("seq").collect()
    lanes = {n: i for i, n in enumerate(sorted({r["node"] for r in data}))}
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{120 * len(lanes) + 40}" height="{20 * len(data) + 60}">']
    lines += [f'<text x="{120 * i + 40}" y="20">node {n}</text>' for n, i in lanes.items()]
    for y, r in enumerate(data):
        label = str(r["kind"]).replace("&", "&amp;").replace("<", "&lt;")
        lines.append(f'<text x="{120 * lanes[r["node"]] + 40}" y="{20 * y + 50}">{label}</text>')
    return "\n".join([*lines, "</svg>"])
