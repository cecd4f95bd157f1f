"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.session import materialised


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (links, either way round) -> ``node``, ``root``: the smallest node reachable, for every node with a link.

    Large-star and small-star steps alternate until nothing changes; each is a minimum per node, combined map-side, and a
    join on the node that Spark splits where a node has very many links. Every step is written to the shared folder.
    An empty input gives an empty result; links of a node to itself and repeated links change nothing.
    """
    now = materialised(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialised(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialised(rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
