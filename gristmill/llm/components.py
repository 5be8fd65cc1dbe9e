"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) between nodes of any ordered type: node, root, the least node of its component, for
    every node that has a link to another.

    Each step is an aggregation and a join over the links that are left, staged in the shared folder;
    the number of rounds grows with the logarithm of the longest chain.
    """
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    edges = staged(links.where(F.col("a") != F.col("b")).select(*pair).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(least).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
