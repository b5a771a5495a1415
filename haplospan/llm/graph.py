"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, of every node in links (u, v).

    Large-star and small-star steps alternate until nothing moves: each node's larger, then smaller neighbours
    are linked with its smallest neighbour.  Only tables of links are joined; none is ever collected.  The smallest neighbours are
    written before they are joined, so that Spark can split the partition of a node with very many neighbours.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "larger")
        least_of_large = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least_of_large, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least_of_large.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "links")
        discard(before, least, large, least_of_large)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
