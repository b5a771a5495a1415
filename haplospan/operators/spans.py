"""Where nodes lie on the reference, and which edges skip some of it.

nodes: node_id, name, length, sn, so, sr; edges: edge_no, from_id, to_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut as checkpoint

MAX_HOPS = 4
MIN_DELETION_BP = 1
BIN = 1 << 12


def is_backbone() -> Column:
    return F.coalesce(F.col("sr") == 0, F.lit(False))


def is_off_reference() -> Column:
    return F.coalesce(F.col("sr") > 0, F.lit(False))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions: node, other."""
    return edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other")).unionByName(edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("other")))


def backbone_span(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_backbone()).agg((F.max(F.col("so") + F.col("length")) - F.min("so")).cast("long").alias("span"))


def reference_spans(nodes: DataFrame, edges: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """node_id, start, end: its own interval for a backbone node, else the interval between the flanks that a walk of up to `hops` reaches.

    Backbone nodes end the walk.  All nodes walk at once: (origin, node) pairs, without those seen.  A node that reaches no flank is left out.
    """
    backbone = nodes.where(is_backbone()).select("node_id", "so", (F.col("so") + F.col("length")).alias("stop"))
    near = checkpoint(neighbours(edges).distinct())
    others = nodes.where(~is_backbone()).select(F.col("node_id").alias("origin"))
    frontier = others.select("origin", F.col("origin").alias("node"))
    seen, reached = frontier, None
    for _ in range(hops):
        step = frontier.join(near, "node").select("origin", F.col("other").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti")
        step = checkpoint(step.join(backbone.select(F.col("node_id").alias("node"), "so", "stop"), "node", "left"))
        flanks = step.where("so is not null").select("origin", "so", "stop")
        reached = flanks if reached is None else reached.unionByName(flanks)
        frontier = step.where("so is null").select("origin", "node")
        seen = seen.unionByName(step.select("origin", "node"))
    low, high = F.min("stop"), F.max("so")
    flanked = reached.groupBy("origin").agg(F.least(low, high).alias("start"), F.greatest(low, high).alias("end")).select(F.col("origin").alias("node_id"), "start", "end")
    return backbone.select("node_id", F.col("so").alias("start"), F.col("stop").alias("end")).unionByName(flanked)


def midpoints(spans: DataFrame) -> DataFrame:
    return spans.select("node_id", ((F.col("start") + F.col("end")) / 2).alias("midpoint"))


def deletion_edges(nodes: DataFrame, edges: DataFrame, least: int = MIN_DELETION_BP) -> DataFrame:
    """edge_no, from_id, to_id, ref, start, end, bp of the edges between backbone nodes of one sequence with a gap between."""
    b = nodes.where(is_backbone()).select("node_id", "sn", "so", "length")

    def end(prefix: str) -> DataFrame:
        return b.select(*[F.col(c).alias(f"{prefix}_{c}") for c in b.columns])

    both = edges.join(end("f"), F.col("from_id") == F.col("f_node_id")).join(end("t"), F.col("to_id") == F.col("t_node_id")).where("f_sn = t_sn")
    forward = F.col("f_so") <= F.col("t_so")
    start = F.when(forward, F.col("f_so") + F.col("f_length")).otherwise(F.col("t_so") + F.col("t_length"))
    stop = F.when(forward, F.col("t_so")).otherwise(F.col("f_so"))
    return both.select("edge_no", "from_id", "to_id", F.col("f_sn").alias("ref"), start.alias("start"), stop.alias("end"), (stop - start).alias("bp")).where(F.col("bp") >= least)


def bypassed(deletions: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_no and the backbone nodes wholly inside the deletion, by start; a range join by bins."""
    b = nodes.where(is_backbone()).select(F.col("sn").alias("ref"), F.col("so").alias("_so"), (F.col("so") + F.col("length")).alias("_stop"), F.col("node_id").alias("_id")).withColumn("_bin", F.floor(F.col("_so") / BIN))
    d = deletions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))))
    inside = d.join(b, ["ref", "_bin"]).where("_so >= start and _so < end and _stop <= end")
    return inside.groupBy("edge_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_so", "_id"))), lambda x: x["_id"]).alias("bypassed"))


def hovered(points: DataFrame, nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """points: point_id, ref, at, name.  node_id by name (the last such node), else the first backbone node over the place; both ends count."""
    ordered = nodes.select("node_id", "name", "rec_no", "sn", "so", "length", "sr")
    by_name = points.join(ordered.select("name", "rec_no", "node_id"), "name").groupBy("point_id").agg(F.max_by("node_id", "rec_no").alias("_named"))
    b = ordered.where(is_backbone()).select(F.col("sn").alias("ref"), "so", "length", "rec_no", "node_id").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("so") / BIN), F.floor((F.col("so") + F.col("length")) / BIN))))
    over = points.withColumn("_bin", F.floor(F.col("at") / BIN)).join(b, ["ref", "_bin"]).where("at between so and so + length")
    by_place = over.groupBy("point_id").agg(F.min_by("node_id", "rec_no").alias("_placed"))
    found = points.select("point_id").join(by_name, "point_id", "left").join(by_place, "point_id", "left")
    return found.select("point_id", F.coalesce("_named", "_placed").alias("node_id")).join(spans, "node_id", "left").select("point_id", "node_id", "start", "end")


def launch_targets(nodes: DataFrame, spans: DataFrame, assemblies: DataFrame, region: tuple[str, str] | None = None, least: int = 1000) -> DataFrame:
    """node_id, kind (own or reference), assembly, ref, start, end padded to `least` bp.  assemblies: sample, assembly.

    region: assembly and ref of the region that the graph was cut for; without one no node has a place on a reference.
    """
    from ..functions.naming import pansn_contig, pansn_sample

    own = nodes.where("sn is not null").select("node_id", F.lit("own").alias("kind"), pansn_sample(F.col("sn")).alias("sample"), pansn_contig(F.col("sn")).alias("ref"), F.col("so").alias("start"), (F.col("so") + F.col("length")).alias("end"))
    named = own.join(assemblies, "sample").select("node_id", "kind", "assembly", "ref", "start", "end")
    if region is None:
        return padded(named, least)
    on = spans.select("node_id", F.lit("reference").alias("kind"), F.lit(region[0]).alias("assembly"), F.lit(region[1]).alias("ref"), "start", "end")
    return padded(named.unionByName(on), least)


def padded(places: DataFrame, least: int = 1000) -> DataFrame:
    """Intervals shorter than `least` widened on both sides; starts stay at 0 or above."""
    short = F.greatest(F.lit(least) - (F.col("end") - F.col("start")), F.lit(0))
    half = F.ceil(short / 2)
    return places.withColumns({"start": F.greatest(F.col("start") - half, F.lit(0)).cast("long"), "end": (F.col("end") + half).cast("long")})


def contributors(nodes: DataFrame, max_gap: int | None = None) -> DataFrame:
    """sample, ref, start, end, rank, node_count: for each sample and sequence the widest run of nodes with no gap over max_gap.

    Ties go to the earliest run; node_count counts all its nodes, rank is the lowest.
    """
    from ..functions.naming import pansn_contig, pansn_sample

    placed = nodes.where("sn is not null").select(pansn_sample(F.col("sn")).alias("sample"), pansn_contig(F.col("sn")).alias("ref"), F.col("so").alias("start"), (F.col("so") + F.col("length")).alias("end"), F.col("sr").alias("rank"))
    order = Window.partitionBy("sample", "ref").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.lit(0) if max_gap is None else F.when(F.col("start") - far > max_gap, 1).otherwise(0)
    islands = placed.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("sample", "ref", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    widest = F.struct((F.col("end") - F.col("start")).alias("w"), (-F.col("start")).alias("s"))
    return runs.groupBy("sample", "ref").agg(F.max_by("start", widest).alias("start"), F.max_by("end", widest).alias("end"), F.min("rank").alias("rank"), F.sum("n").cast("long").alias("node_count"))


def resolve_contributors(found: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Contributors of known assemblies, under the assembly's name.  assemblies: sample, assembly."""
    return found.join(assemblies, "sample").select(F.col("assembly").alias("sample"), "ref", "start", "end", "rank", "node_count")


def with_reference_region(found: DataFrame, assembly: str, ref: str, start: int, end: int) -> DataFrame:
    """The region takes the place of the contributor of rank 0."""
    zero = F.col("rank") == 0
    return found.withColumns({"sample": F.when(zero, F.lit(assembly)).otherwise(F.col("sample")), "ref": F.when(zero, F.lit(ref)).otherwise(F.col("ref")), "start": F.when(zero, F.lit(start)).otherwise(F.col("start")), "end": F.when(zero, F.lit(end)).otherwise(F.col("end"))})


def highlights(spans: DataFrame, ref: str, assembly: str) -> DataFrame:
    """node_id and its span restated in the names of the region that the graph was cut from."""
    return spans.select("node_id", F.lit(ref).alias("ref"), F.lit(assembly).alias("assembly"), "start", "end")


def in_hover_region(points: DataFrame, ref: str, start: int, end: int) -> DataFrame:
    """Points (ref, at) on the region's sequence, both ends included."""
    return points.where((F.col("ref") == ref) & F.col("at").between(start, end))


def node_details(nodes: DataFrame, spans: DataFrame, carriage: DataFrame | None = None, region: tuple[str, str] | None = None) -> DataFrame:
    """What is said of a node: node_id, name, length, depth, rank, stable_name, contributing_assembly, carried_by, and ref, assembly, start and end if there is a region (ref, assembly).

    carriage: segment and samples.
    """
    from ..functions.naming import pansn_sample

    found = nodes if carriage is None else nodes.join(carriage.select(F.col("segment").alias("name"), F.array_join("samples", ", ").alias("carried_by")), "name", "left")
    if carriage is None:
        found = found.withColumn("carried_by", F.lit(None).cast("string"))
    own = ["node_id", "name", "length", "depth", F.col("sr").alias("rank"), F.col("sn").alias("stable_name"), pansn_sample(F.col("sn")).alias("contributing_assembly"), "carried_by"]
    if region is None:
        return found.select(*own)
    on = highlights(spans, *region)
    return found.select(*own).join(on, "node_id", "left")


def contributor_order(found: DataFrame) -> DataFrame:
    """Contributors with the reference first, then by name."""
    return found.orderBy(F.col("rank") != 0, F.collate(F.col("sample"), "UNICODE"), "ref")
