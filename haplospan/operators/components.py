"""Connected components and coarse graphs, by contraction.

In a round every node draws a number, points to the neighbour of the smallest draw if that is below its own, and goes on to where that one
points.  Nodes of one goal become one node of the next, smaller graph.  Draws are hashes of names, so equal input gives equal graphs; on any
graph each component with a link loses nodes in every round, on chains more than half of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut as checkpoint
from ..storage import dealt


def contracted(links: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Where the nodes of a graph go, and the links of the next graph.

    links: u, v, rest (a length), one row for each pair, u <> v.  Goals: node, goal, away (the length of the way there, at most two links).
    """

    def draw(of: str) -> Column:
        return F.struct(F.xxhash64(F.lit(level), F.col(of)).alias("drawn"), F.col(of).alias("name"))

    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "rest"))
    best = both.groupBy("u").agg(F.min_by(F.struct("v", "rest"), draw("v")).alias("b"))
    below = draw("u") > draw("b.v")
    first = best.select(F.col("u").alias("node"), F.when(below, F.col("b.v")).otherwise(F.col("u")).alias("to"), F.when(below, F.col("b.rest")).otherwise(F.lit(0.0)).alias("way"))
    first = checkpoint(first)
    second = first.select(F.col("node").alias("to"), F.col("to").alias("goal"), F.col("way").alias("more"))
    goals = checkpoint(first.join(dealt(second), "to").select("node", "goal", (F.col("way") + F.col("more")).alias("away")))
    a, b = (goals.select(F.col("node").alias(side), F.col("goal").alias(f"_{side}"), F.col("away").alias(f"_w{side}")) for side in "uv")
    moved = links.join(dealt(a), "u").join(dealt(b), "v").where("_u <> _v")
    pair = moved.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"), (F.col("rest") + F.col("_wu") + F.col("_wv")).alias("rest"))
    return goals, checkpoint(pair.groupBy("u", "v").agg(F.min("rest").alias("rest")))


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest name reachable, of every node in links (u, v)."""
    pairs = links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    graph, goals = checkpoint(pairs.withColumn("rest", F.lit(0.0))), []
    while not graph.isEmpty():
        step, graph = contracted(graph, len(goals))
        goals.append(step)
    if not goals:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    last = goals.pop().select("node", F.col("goal").alias("end"))
    while goals:  # back to the nodes of the graph before: what is left over there has found its end
        later = last.select(F.col("node").alias("goal"), "end")
        last = checkpoint(goals.pop().join(dealt(later), "goal", "left").select("node", F.coalesce("end", "goal").alias("end")))
    roots = last.groupBy("end").agg(F.min("node").alias("root"))
    return last.join(dealt(roots), "end").select("node", "root")
