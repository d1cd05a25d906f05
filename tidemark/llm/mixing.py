"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut in each source.

Every row gets a 64-bit hash key; a source's rows are ordered by it. The key space is divided into equal ranges, so
(source, range) groups are even however large a source is. Sums per range give each range's offset within its source,
a window inside a range gives the rest: no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, prefix_sums, table

#: Rows of one (source, range) group that the number of ranges is chosen for.
ROWS_A_RANGE = 20_000


def _ranges(rows: int) -> int:
    return max(6, (rows // ROWS_A_RANGE).bit_length())


def _unsigned(key):
    """Signed numbers in the order of key's bits read as unsigned, the order of the ranges."""
    return key.bitwiseXOR(F.lit(-(2**63)))


def _key(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most_epochs: float) -> DataFrame:
    """sizes(src, source, source_size) with a target for each: share of the sum by weight, at most most_epochs of a source.

    Weights go round the sources in code-point order, null last. What a cap cuts off is shared again by weight; the
    final level is the largest of the levels met when sources are capped in order of size by weight. One row a source, of
    which there may be very many.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = prefix_sums(sizes.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], {"_rank": "_one"})
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", most_epochs * F.col("source_size")).withColumn("_order", F.col("_cap") / F.col("weight"))
    capped = prefix_sums(ranked, ["_order", "_rank"], {"_cap_before": "_cap", "_weight_before": "weight"})
    whole = sizes.agg(F.sum("source_size").alias("_sum")).join(ranked.agg(F.sum("weight").alias("_heavy")), F.lit(True))
    left, heavy = F.lit(float(share)) * F.col("_sum") - F.col("_cap_before"), F.col("_heavy") - F.col("_weight_before")
    level = capped.join(F.broadcast(whole), F.lit(True)).agg(F.max(left / heavy).alias("_level"))  # one row each
    out = ranked.join(F.broadcast(level), F.lit(True)).withColumn("target", F.least(F.col("_level") * F.col("weight"), F.col("_cap")))
    return out.drop("_one", "_rank", "_cap", "_order", "_level")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Rows (doc_id, source, key, size, source_size, weight, target, epochs, taken): the words that the mix takes of each document.

    size counts words; a null text has 0. A source's budget is its rounded target: whole epochs first, then documents
    in key order up to the budget, the last one in part, so the taken words of a source equal its budget. Documents
    without words take 0. Null doc_id or source are ordinary values. Repeated rows are separate rows; equal rows tie and
    share out the same takes in any order. An empty table gives an empty result. Other columns of docs are ignored.
    Reruns agree: the key depends on the row alone.
    """
    key = _key(seed)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("_key"))
    rows = table(rows.withColumn("src", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source"))), "mix-keys")
    bits = _ranges(rows.count())
    rows = rows.withColumn("_range", F.shiftrightunsigned(F.col("_key"), 64 - bits))

    sums = rows.groupBy("src", "_range").agg(F.first("source").alias("source"), F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("_before", F.coalesce(before, F.lit(0))).select("src", "_range", "_before")
    targets = source_targets(sums.groupBy("src").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")), share, weights, most_epochs)
    offsets = offsets.join(targets.drop("source"), "src")

    inside = Window.partitionBy("src", "_range").orderBy(_unsigned(F.col("_key")), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["src", "_range"]).withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("_at")))
    return placed.select("doc_id", "source", F.col("_key").alias("key"), "size", "source_size", "weight", "target", epochs.cast("int").alias("epochs"), taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix as documents: each one once for every epoch that takes any of its words, text whole, columns those of docs.

    A source's takes are whole epochs and the documents up to a key, so documents meet one row for their source, not
    their own takes. The document at the cut comes whole, with any equal rows: a source exceeds its budget by that.
    """
    takes = mix(docs, seed=seed, **options)
    last = F.max(F.when(F.col("taken") > F.col("epochs") * F.col("size"), _unsigned(F.col("key"))))
    cuts = table(takes.groupBy(F.col("source").alias("_source")).agg(F.first("epochs").alias("_epochs"), F.max("size").alias("_some"), last.alias("_last")), "mix-cuts")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) > 0
    # keys are compared as the bit patterns that the ranges are cut from: unsigned
    below = F.coalesce(_unsigned(_key(seed)) <= F.col("_last"), F.lit(False))
    copies = F.when(words, F.col("_epochs") + F.when(below, 1).otherwise(0)).otherwise(0)
    joined = docs.join(cuts, F.col("source").cast("string").eqNullSafe(F.col("_source")))
    return joined.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
