"""Connected components of a large edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideledger.session import stage


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Link a node's neighbours to the smallest of them and itself: all larger ones (``both``) or all smaller ones."""
    if both:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if both:
        linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge; root is the smallest node of its component.

    Alternates large and small stars until nothing changes; the number of rounds grows with the logarithm of the nodes.
    Each round writes its edges to the shared folder, so lineage stays short. A hub is summed before the shuffle and its
    rows are joined with one row, which AQE splits. Null ends, loops and repeated edges are ignored.
    """
    current = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        current = stage(_stars(_stars(current, True), False))
        # The sum of the edges' hashes tells whether the set has changed.
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
