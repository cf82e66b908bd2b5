"""Connected components of undirected links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.util import checkpointed


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: columns a, b (long). Returns node, component (the smallest node reachable) for every node
    that has a link to another; loops and repeated links don't matter.

    Alternates two steps until the links form stars: every node hands its larger neighbours, then its smaller
    ones, to the smallest node it sees. Nodes' minima are aggregated before the shuffle; each round is cut
    off by a checkpoint in the shared folder. The rounds grow with the logarithm of the nodes."""
    links = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        tags = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top"))
        tags = tags.unionAll(links.select(F.col("b"), F.lit(0), F.lit(1)))
        unfinished = tags.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or (up = 1 and top = 1)")
        if unfinished.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select("b", "b").distinct())
        both = links.unionAll(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(moved.unionAll(small_least.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components have not settled in {rounds} rounds")
