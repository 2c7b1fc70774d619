"""Connected components by alternating large-star and small-star steps over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import remove, stored_at


def _steps(edges: DataFrame) -> tuple[DataFrame, str]:
    """One large-star and one small-star step on edges (u, v); minima are combined before they are shuffled.

    The folder is that of the table between the two.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down, between = stored_at(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "stars")
    smallest = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    small = down.join(smallest, down.u == smallest.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(smallest.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), between


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) but the roots; the root is the smallest node.

    Self-edges, repeated edges and either direction are fine; no edges give no rows.  Every round is
    written to the shared folder and the one before it removed; the number of rounds grows with the logarithm of
    the longest path.
    """
    current, path = stored_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if seen == mark or not seen[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        steps, between = _steps(current)
        current, new = stored_at(steps, "edges")
        remove(path)
        remove(between)
        path = new
