"""Connected components of links, by alternating stars over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``links`` (a, b: two bigint nodes).

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; rounds
    needed grow with the logarithm of the longest chain. A node with very many links is only ever a join key
    whose other side has one row, which adaptive execution may split.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), F.first("high")).alias("least"))
        large = both.join(least, "high").filter("low > high").select(F.col("low").alias("high"), F.col("least").alias("low"))
        large = large.filter("high <> low").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(
            F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("least").alias("low")
        )
        own = least.select("high", F.col("least").alias("low"))
        edges = cut_lineage(small.unionByName(own).filter("high <> low").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    stars = edges.groupBy("high").agg(F.min("low").alias("component")).withColumnRenamed("high", "node")
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return stars.unionByName(roots)
