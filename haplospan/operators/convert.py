"""From GFA records to a graph of nodes and edges: one node for each segment, whatever strands name it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import edge_key, sm_samples
from ..sources.gfa import tag_number, tag_text
from ..storage import partitions


def canonical_strands(links: DataFrame, steps: DataFrame) -> DataFrame:
    """segment, strand of the first claim: links in order (source, then target), then P steps, then W steps."""
    claims = (
        links.select(F.lit(0).alias("phase"), "rec_no", F.lit(0).alias("at"), F.col("source").alias("segment"), F.col("source_strand").alias("strand"))
        .unionByName(links.select(F.lit(0).alias("phase"), "rec_no", F.lit(1).alias("at"), F.col("target").alias("segment"), F.col("target_strand").alias("strand")))
        .unionByName(steps.select((F.col("phase") + 1).alias("phase"), "rec_no", F.col("step_no").alias("at"), "segment", "strand"))
    )
    # dealt by segment first: a first claim is no number, so a task would sort all that it has read before it could sum it up
    return claims.repartition(partitions(links.sparkSession), "segment").groupBy("segment").agg(F.min_by("strand", F.struct("phase", "rec_no", "at")).alias("strand"))


def traversals(steps: DataFrame) -> DataFrame:
    """How often the steps visit each segment."""
    return steps.groupBy("segment").agg(F.count(F.lit(1)).alias("traversals"))


def depth(tags: Column, count: Column) -> Column:
    """The first depth tag that is there, if it is a positive number; else the traversals, at least 1."""
    held = [F.when(F.map_contains_key(tags, k), F.struct(tag_number(tags, k).alias("n"))) for k in ("dp", "RC", "FC", "KC")]
    tagged = F.coalesce(*held)["n"]
    return F.when(tagged > 0, tagged).otherwise(F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)).cast("double"))


def nodes(segments: DataFrame, links: DataFrame, steps: DataFrame) -> DataFrame:
    """rec_no, node_id, name, length, depth, sn, so, sr of every segment, and the samples that its SM tag names (null without)."""
    strands, counts = canonical_strands(links, steps), traversals(steps)
    joined = segments.join(strands, segments["id"] == strands["segment"], "left").drop("segment").join(counts, F.col("id") == counts["segment"], "left")
    return joined.select("rec_no", F.concat("id", F.coalesce("strand", F.lit("+"))).alias("node_id"), F.col("id").alias("name"), "length", depth(F.col("tags"), F.col("traversals")).alias("depth"), "sn", "so", "sr", sm_samples(tag_text(F.col("tags"), "SM")).alias("samples"))


def edges(links: DataFrame, strands: DataFrame, steps: DataFrame) -> DataFrame:
    """edge_no (order of the links), from_id, to_id and path_ids (names of the paths along it in first-seen order, null if none).

    Ends that no segment declares keep the strand of their first claim.
    """
    by = strands.select("segment", F.concat("segment", "strand").alias("node"))
    a, b = by.select(F.col("segment").alias("source"), F.col("node").alias("from_id")), by.select(F.col("segment").alias("target"), F.col("node").alias("to_id"))
    placed = links.join(a, "source").join(b, "target").select(F.col("rec_no").alias("edge_no"), "from_id", "to_id").withColumn("key", edge_key(F.col("from_id"), F.col("to_id")))
    own = steps.join(by, "segment").select("phase", "rec_no", "full_name", "step_no", "node")
    following = F.lead("node").over(Window.partitionBy("phase", "rec_no").orderBy("step_no"))
    pairs = own.withColumn("next", following).where("next is not null").withColumn("key", edge_key(F.col("node"), F.col("next")))
    keys = placed.select("key").distinct()
    pairs = pairs.join(keys.hint("shuffle_hash"), "key", "left_semi")  # what is no edge has no names; dealt by key, as the groups need it
    seen = pairs.groupBy("key", "full_name").agg(F.min(F.struct("phase", "rec_no", "step_no")).alias("at"))
    names = seen.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "full_name"))), lambda x: x["full_name"]).alias("path_ids"))
    return placed.join(names, "key", "left").select("edge_no", "from_id", "to_id", "path_ids")


def summary(nodes_: DataFrame, edges_: DataFrame, records: DataFrame) -> DataFrame:
    n, e, p = (x.agg(F.count(F.lit(1)).alias(name)) for x, name in ((nodes_, "nodes"), (edges_, "edges"), (records, "paths")))
    return n.join(e, F.lit(True)).join(p, F.lit(True))  # one row each
