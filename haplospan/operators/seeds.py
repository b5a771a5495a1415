"""Linear seeds: first places of nodes along x, each behind the ends of what leads to it.

Nodes stand in the order of their names, as numbers if all are, else by alphabet.  A node starts an edge's length after the farthest end of its upstream
nodes that stand before it; without any, after the node before it (which also counts where the first upstream node stands later).  Nodes of one start go below each other.

Each start depends on starts before it, so the order is walked by ranges of RANGE rows: a task walks one range, with the ends that lead into it
from ranges before as columns, and hands on one number.  Memory is that of a range; heights are a numbering by start afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, numbered, passing

RANGE = 100_000
#: Starts are alike if they are in hundredths.
HUNDREDTHS = 100.0


def in_order(nodes: DataFrame) -> DataFrame:
    """nodes (node_id, name, drawn) with their number: by name as a number if all names are whole numbers, else as text."""
    whole = F.col("name").try_cast("int")
    numeric = nodes.where(whole.isNull()).isEmpty()
    keyed = nodes.withColumn("_key", whole if numeric else F.col("name"))
    return cut(numbered(keyed, "_key", "node_id").drop("_key"))


def walk(edge_length: float, end: float):
    """Starts and ends of the rows of one range, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["number"])
        last, ends, out = end, {}, []
        for r in rows:
            for up in sorted(r["upstream"] or (), key=lambda u: u["place"]):
                at = ends.get(up["number"], up["end"])
                if at is not None:
                    last = at if up["place"] == 0 else max(last, at)
            start = last + edge_length
            last = ends[r["number"]] = start + r["drawn"]
            out.append((r["number"], start, last))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["number", "x0", "x1"])

    return run


def linear_seeds(nodes: DataFrame, edges: DataFrame, edge_length: float, size: int = RANGE) -> DataFrame:
    """node_id, x0, x1, y.  nodes: node_id, name, drawn (length); edges: edge_no, from_id, to_id."""
    spark = nodes.sparkSession
    order = in_order(nodes.select("node_id", "name", F.col("drawn").cast("double").alias("drawn")))
    a, b = order.select(F.col("node_id").alias("from_id"), F.col("number").alias("up")), order.select(F.col("node_id").alias("to_id"), "number")
    links = edges.join(a, "from_id").join(b, "to_id").groupBy("number", "up").agg(F.min("edge_no").alias("edge_no"))
    first = F.min("edge_no").over(Window.partitionBy("number"))
    links = cut(links.select("number", "up", F.when(F.col("edge_no") == first, 0).otherwise(1).alias("place")))
    folder, end = passing(spark, "seeds"), 0.0
    schema = "number long, x0 double, x1 double"
    spark.createDataFrame([], schema).write.parquet(folder)
    for low in range(0, order.count(), size):
        here = F.col("number").between(low, low + size - 1)
        done = spark.read.schema(schema).parquet(folder).select(F.col("number").alias("up"), F.col("x1").alias("end"))
        into = links.where(here & (F.col("up") < F.col("number"))).join(done, "up", "left")
        into = into.groupBy("number").agg(F.collect_list(F.struct("place", F.col("up").alias("number"), "end")).alias("upstream"))
        rows = order.where(here).select("number", "drawn").join(into, "number", "left").coalesce(1)
        walked = cut(rows.mapInArrow(walk(edge_length, end), schema))
        walked.write.mode("append").parquet(folder)
        end = walked.agg(F.max_by("x1", "number")).first()[0]
    starts = order.select("node_id", "number").join(spark.read.schema(schema).parquet(folder), "number")
    below = F.row_number().over(Window.partitionBy((F.col("x0") * HUNDREDTHS).cast("long")).orderBy("number")) - 1
    return starts.select("node_id", "x0", "x1", (below * F.lit(float(edge_length))).alias("y"))
