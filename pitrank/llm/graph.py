"""Connected components over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


#: Edges of a partition that is written between two steps.
ROWS = 500_000


def near_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the least node within one link, and that node's own; nodes of one root are connected."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    first = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    second = first.select(F.col("u").alias("m"), F.col("m").alias("further"))
    return first.join(second, "m").select(F.col("u").alias("node"), F.col("further").alias("root"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the least node reachable, for every node of an edge (a node without one is its own).

    Alternates a large-star and a small-star step: every node links its greater neighbours to its least
    neighbour, then its lesser ones, until nothing changes.  An edge is only ever moved, so the edge set
    never grows; each step is one hash aggregation and one join on the node.
    """
    current = cut_lineage(edges.where(F.col(a) != F.col(b))
                          .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before: tuple | None = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
        current = cut_lineage(small.coalesce(max(16, before[0] // ROWS)) if before else small)
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
