"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, table


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges(a, b): root is the smallest node reachable.

    Each round gives a node the smallest root among its own and its neighbours' and then the root of that root, so paths
    shorten by powers of two; rounds end when nothing changes. Grouping combines before it shuffles, so a node with very
    many edges is no heavier than others; every round is a written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = table(both, "edges", release_shuffles=False)
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    roots = table(roots, "roots", release_shuffles=False)  # later ones have the root before as well
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = roots.select("node", "root").join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        far = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = table(new.join(far, "next", "left").select("node", F.col("root").alias("old"), F.least("next", F.coalesce("far", "next")).alias("root")), "roots", release_shuffles=False)
        changed = new.filter("root <> old").limit(1).count()
        drop(roots)
        if not changed:
            drop(both)
            return new.select("node", "root")
        roots = new
