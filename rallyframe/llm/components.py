"""Connected components of a link table by alternating large-star and small-star joins.

Every step is a grouped minimum (pre-aggregated before its shuffle) and a join of links with such minima. The minima are
written first, so that both sides of a join are plain shuffles and a hub's links are split by Spark's skew handling; each
round is written to the shared scratch folder, and rounds end when every link leads straight to a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.plans.scratch import stash, unstash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each linked id with the smallest id it reaches. links: pairs of longs; nulls and self-links are left out."""
    edges = stash(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        # a fixed point: nothing has two smaller neighbours, and nothing with a smaller neighbour has a larger one
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups > 0 and low = 0)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = stash(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        lower = stash(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stash(small.where("u <> v").distinct(), "links")
        unstash(edges, least, large, lower)
        edges = after
