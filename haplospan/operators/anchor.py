"""Coordinates from paths: every path is walked once, each segment takes its first visit on the reference path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import partitions


def segment_lengths(segments: DataFrame) -> DataFrame:
    """segment and length; of records with one id the last counts, so that steps do not multiply."""
    last = F.max_by("length", "rec_no") if "rec_no" in segments.columns else F.last("length")
    return segments.groupBy(F.col("id").alias("segment")).agg(last.alias("length"))


def visits(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """phase, rec_no, step_no, name, sample, segment, strand, start of every step.

    A path is walked forward whatever its strands, from its own start, by records rather than names; unknown segments have no length.
    """
    walked = steps.join(segment_lengths(segments), "segment", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    before = F.sum("length").over(Window.partitionBy("phase", "rec_no").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1))
    return walked.select("phase", "rec_no", "step_no", "full_name", "name", "sample", "segment", "strand", "length", (F.col("start") + F.coalesce(before, F.lit(0))).alias("at"))


def origins(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """phase, rec_no, name, sample, start, length of each path record."""
    return (
        steps.join(segment_lengths(segments), "segment", "left")
        .groupBy("phase", "rec_no")
        .agg(F.first("name").alias("name"), F.first("sample").alias("sample"), F.first("start").alias("start"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("length"))
    )


def reference_path(records: DataFrame, preferred: str | None = None) -> str | None:
    """Name of the first record whose sample or name is the preferred one, else of the first record."""
    match = F.lit(False) if preferred is None else (F.col("sample") == preferred) | (F.col("name") == preferred)
    row = records.agg(F.min_by("name", F.struct(~match, "phase", "rec_no")).alias("name")).first()
    return row["name"]


def anchored(visit_table: DataFrame, reference: str) -> DataFrame:
    """segment, sn, so, sr and strand by the first visit of a record with the reference's name, else the first of all.

    Rank is 0 on the reference, else 1.
    """
    first = F.struct((F.col("name") != reference).cast("int").alias("other"), "phase", "rec_no", "step_no")
    of = visit_table.repartition(partitions(visit_table.sparkSession), "segment")  # else a task sorts all that it has read
    picked = of.groupBy("segment").agg(F.min_by(F.struct("name", "at", "strand"), first).alias("v"))
    return picked.select("segment", F.col("v.name").alias("sn"), F.col("v.at").alias("so"), F.when(F.col("v.name") == reference, 0).otherwise(1).cast("long").alias("sr"), F.col("v.strand").alias("strand"))


def carriage(visit_table: DataFrame) -> DataFrame:
    """segment and its samples, sorted."""
    once = visit_table.select("segment", "sample").distinct()  # plain rows, so partial sums; sets would be sorted by task as read
    return once.groupBy("segment").agg(F.array_sort(F.collect_set("sample")).alias("samples"))


def depth_windows(visit_table: DataFrame, width: int = 500) -> DataFrame:
    """name, window start, and depth weighted by bp: tiles of each path against the visits of its segments by all paths."""
    depth = visit_table.groupBy("segment").agg(F.count(F.lit(1)).alias("depth"))
    spans = visit_table.where("length > 0").join(depth, "segment").select("name", "at", (F.col("at") + F.col("length")).alias("stop"), "depth")
    first, last = F.floor(F.col("at") / width), F.floor((F.col("stop") - 1) / width)
    tiles = spans.select("name", "at", "stop", "depth", F.explode(F.sequence(first, last)).alias("tile"))
    overlap = F.least("stop", (F.col("tile") + 1) * width) - F.greatest("at", F.col("tile") * width)
    return tiles.groupBy("name", "tile").agg(F.sum(overlap).cast("long").alias("bp"), F.sum(overlap * F.col("depth")).cast("long").alias("bp_depth")).select("name", (F.col("tile") * width).cast("long").alias("start"), "bp", "bp_depth")


def is_anchored(nodes: DataFrame) -> bool:
    """Whether any node states coordinates."""
    return not nodes.where("sn is not null").limit(1).isEmpty()


def anchored_nodes(nodes: DataFrame, visit_table: DataFrame, reference: str) -> DataFrame:
    """nodes with sn, so, sr and samples from the visits of paths; a node that no path visits stays as it is.  nodes: name, sn, so, sr, samples."""
    picked = anchored(visit_table, reference).join(carriage(visit_table), "segment")
    picked = picked.select(F.col("segment").alias("name"), *[F.col(c).alias(f"_{c}") for c in ("sn", "so", "sr", "samples")])
    found = nodes.join(picked, "name", "left")
    return found.select(*[F.when(F.col("_sn").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("sn", "so", "sr", "samples") else F.col(c) for c in nodes.columns])


def preferred_path(chosen: str | None, assembly: str | None) -> str | None:
    """An explicit choice wins, else the assembly that the region names."""
    return chosen or assembly


def anchor_graph(nodes: DataFrame, steps: DataFrame, segments: DataFrame, preferred: str | None = None) -> DataFrame:
    """Coordinates stated by tags win; else they are derived from paths; a graph with neither stays as it is."""
    if is_anchored(nodes):
        return nodes
    reference = reference_path(steps.select("phase", "rec_no", "name", "sample"), preferred)
    return nodes if reference is None else anchored_nodes(nodes, visits(steps, segments), reference)
