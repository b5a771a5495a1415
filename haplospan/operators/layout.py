"""Layouts along the reference: x in reference bp, y in rows of fixed pitch; and lengths for free layouts.

Positions: node_id, x0, x1, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import pansn_sample
from ..storage import cut as checkpoint
from .alleles import project
from .cut import MAX_NODES, check_nodes
from .spans import backbone_span, is_backbone, is_off_reference, neighbours

# Row pitch in pixels, least drawn share of the span, drawn lengths.
ROW = 20
LEAST_SHARE = 0.015
MEAN_LENGTH, LEAST_TOTAL, LEAST_LENGTH, EDGE_LENGTH, SEGMENT_LENGTH = 40, 500, 5, 5, 20
PRECISION = 1000


def reference_width(nodes: DataFrame, region: tuple[int, int] | None) -> float:
    """Width of the region, if it has any; else of the backbone."""
    if region and region[1] > region[0]:
        return float(region[1] - region[0])
    return float(backbone_span(nodes).first()["span"] or 0)


def rank_rows(nodes: DataFrame) -> DataFrame:
    """sr and row: the ranks present, in order, without gaps."""
    ranks = nodes.where("sr is not null").select("sr").distinct()
    return ranks.withColumn("row", (F.dense_rank().over(Window.orderBy("sr")) - 1).cast("long"))  # one row for each rank


def sample_rows(nodes: DataFrame) -> DataFrame:
    """sample and row, from 1: by off-reference bp contributed, then name as people sort names."""
    carried = nodes.where(is_off_reference()).groupBy(pansn_sample(F.col("sn")).alias("sample")).agg(F.sum("length").alias("bp"))
    return carried.select("sample", F.row_number().over(Window.orderBy(F.desc("bp"), F.collate(F.col("sample"), "UNICODE"), "sample")).cast("long").alias("row"))  # one row for each sample


def rank_labels(rows: DataFrame) -> DataFrame:
    return rows.select(F.when(F.col("sr") == 0, F.lit("Reference (rank 0)")).otherwise(F.concat(F.lit("Rank "), F.col("sr").cast("string"))).alias("label"), (F.col("row") * ROW).alias("y"))


def sample_labels(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    first = nodes.where(is_backbone()).agg(F.min_by(pansn_sample(F.col("sn")), "rec_no").alias("label")).select("label", F.lit(0).cast("long").alias("y"))
    return first.unionByName(rows.select(F.col("sample").alias("label"), (F.col("row") * ROW).alias("y")))


def placed_alleles(alleles: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """node_id, x0, x1 of the members of alleles with an interval: offsets scaled so that the longest path fills it, or the least width."""
    drawn = F.greatest(F.col("ref_span").cast("double"), F.lit(least))
    of = alleles.select("run", "start", drawn.alias("drawn"), "path_length", F.size("nodes").alias("n"))
    scale = F.when(F.col("path_length") > 0, F.col("drawn") / F.col("path_length")).otherwise(F.lit(0.0))
    both = members.join(of, "run").withColumn("scale", scale)
    even = F.col("drawn") / F.col("n")

    def at(bp: Column, step: Column) -> Column:
        return F.col("start") + F.when(F.col("scale") > 0, bp * F.col("scale")).otherwise(step * even)

    return both.select("node_id", at(F.col("offset"), F.col("at")).alias("x0"), at(F.col("offset") + F.col("length"), F.col("at") + 1).alias("x1"))


def chained(placed: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Adds the nodes reached from placed ones, breadth first, each `least` wide from the end of the node that reaches it first.

    placed: node_id, x0, x1, key (array of long, the order of placing).  So a node stands by the nearest placed one (the first of several, by
    key), as many widths on as there are links between.  Chains of nodes with two neighbours count as one link of their length.
    """
    near = placed.select("node_id")
    arcs = edges.where("from_id <> to_id").select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    arcs = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    for side in "uv":
        arcs = arcs.join(near.select(F.col("node_id").alias(side), F.lit(True).alias(f"placed_{side}")), side, "left")
    arcs = checkpoint(arcs.where("placed_u is null or placed_v is null"))  # only what is not placed yet can be reached
    if arcs.isEmpty():
        return placed
    inner = arcs.where("placed_u is null").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).where("n = 2").select("u", "a", "b")
    ends = checkpoint(chain_ends(arcs.select("u", "v"), checkpoint(inner)))

    heads = ends.join(inner.select("u"), "u", "left_anti").where("end <> u").groupBy("u", "end").agg(F.min("length").alias("length"))
    heads = checkpoint(heads.join(near.select(F.col("node_id").alias("end")), "end", "left_anti"))
    best = F.struct("links", "key", "x1")
    known = frontier = checkpoint(placed.select(F.col("node_id").alias("u"), F.struct(F.lit(0).cast("long").alias("links"), "key", "x1").alias("way")))
    while True:  # as many rounds as junctions of a shortest way
        step = frontier.join(heads, "u").select(F.col("end").alias("u"), (F.col("way.links") + F.col("length")).alias("links"), "way.key", "way.x1").groupBy("u").agg(F.min(best).alias("way"))
        before = known.select("u", F.col("way").alias("was"))
        frontier = checkpoint(step.join(before, "u", "left").where("was is null or way < was").select("u", "way"))
        if frontier.isEmpty():
            break
        known = checkpoint(known.join(frontier.select("u"), "u", "left_anti").unionByName(frontier))
    reached = known.select(F.col("u").alias("end"), "way")
    inside = ends.join(inner.select("u"), "u", "left_semi").join(reached, "end").select("u", (F.col("way.links") + F.col("length")).alias("links"), "way.key", "way.x1").groupBy("u").agg(F.min(best).alias("way"))
    new = known.join(near.select(F.col("node_id").alias("u")), "u", "left_anti").unionByName(inside)
    x0 = F.col("way.x1") + (F.col("way.links") - 1) * F.lit(least)
    return placed.unionByName(new.select(F.col("u").alias("node_id"), x0.alias("x0"), (x0 + F.lit(least)).alias("x1"), F.col("way.key").alias("key")))


def chain_ends(arcs: DataFrame, inner: DataFrame) -> DataFrame:
    """Where each arc (u, v) leads to if it is followed through inner nodes: u, v, end and length in links.

    inner: u, and a and b, its two neighbours.  By pointer jumping: rounds grow with the logarithm of the longest chain.  Circles lead nowhere.
    """
    way = inner.select(F.col("u").alias("v"), "a", "b")
    first = arcs.join(way, "v", "left").select("u", "v", F.coalesce(F.when(F.col("a").isNotNull(), F.col("v")), F.col("u")).alias("pu"), F.when(F.col("a").isNull(), F.col("v")).when(F.col("a") == F.col("u"), F.col("b")).otherwise(F.col("a")).alias("pv"), F.when(F.col("a").isNull(), 0).otherwise(1).cast("long").alias("length"))
    table = checkpoint(first)
    closed, moving = table.where("length = 0"), table.where("length > 0")
    for _ in range(2 * (table.count() + 1).bit_length()):
        to = table.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("qu"), F.col("pv").alias("qv"), F.col("length").alias("more"))
        step = checkpoint(moving.join(to, ["pu", "pv"]).select("u", "v", F.col("qu").alias("pu"), F.col("qv").alias("pv"), (F.col("length") + F.col("more")).alias("length"), (F.col("more") == 0).alias("done")))
        closed = closed.unionByName(step.where("done").drop("done"))
        moving = step.where("not done").drop("done")
        if moving.isEmpty():
            break
        table = closed.unionByName(moving)
    return closed.select("u", "v", F.col("pv").alias("end"), (F.col("length") + 1).alias("length"))


def positions(nodes: DataFrame, edges: DataFrame, region: tuple[int, int] | None = None) -> DataFrame:
    """node_id, x0, x1 of all nodes that either row layout places."""
    least = reference_width(nodes, region) * LEAST_SHARE
    alleles, members, _ = project(nodes, edges)
    backbone = nodes.where(is_backbone()).select("node_id", F.col("so").cast("double").alias("x0"), (F.col("so") + F.col("length")).cast("double").alias("x1"), F.array(F.lit(0).cast("long"), "rec_no").alias("key"))
    order = members.join(alleles.select("run", "start", "sample"), "run").join(nodes.select("node_id", "rec_no"), "node_id")
    off = placed_alleles(alleles, members, least).join(order.select("node_id", F.array(F.lit(1).cast("long"), F.col("start"), "at").alias("key")), "node_id")
    return chained(backbone.unionByName(off), edges, least).select("node_id", "x0", "x1")


def anchored_layout(nodes: DataFrame, edges: DataFrame, region: tuple[int, int] | None = None) -> DataFrame:
    """Rows by rank; nodes without a rank go with rank 1, unknown ranks below all."""
    rows = rank_rows(nodes)
    count = rows.count()
    at = positions(nodes, edges, region).join(nodes.select("node_id", F.coalesce("sr", F.lit(1)).alias("sr")), "node_id").join(rows, "sr", "left")
    return at.select("node_id", "x0", "x1", (F.coalesce("row", F.lit(count)) * ROW).cast("long").alias("y"))


def sample_row_layout(nodes: DataFrame, edges: DataFrame, region: tuple[int, int] | None = None) -> DataFrame:
    """The backbone on row 0, a row for each contributing sample, and a spare row for nodes without a coordinate."""
    rows = sample_rows(nodes)
    spare = rows.count() + 1
    at = positions(nodes, edges, region).join(nodes.select("node_id", "sr", pansn_sample(F.col("sn")).alias("sample")), "node_id").join(rows, "sample", "left")
    return at.select("node_id", "x0", "x1", (F.when(F.col("sr") == 0, 0).otherwise(F.coalesce("row", F.lit(spare))) * ROW).cast("long").alias("y"))


MODES = ("anchored", "sample-rows", "force")


def available_modes(nodes: DataFrame) -> list[str]:
    """Anchored needs a backbone; sample rows need off-reference nodes too; force is always there."""
    has = nodes.agg(F.max(is_backbone()).alias("b"), F.max(is_off_reference()).alias("o")).first()
    return [m for m, there in zip(MODES, (has["b"], has["b"] and has["o"], True), strict=True) if there]


def lay_out(nodes: DataFrame, edges: DataFrame, mode: str = "force", region: tuple[int, int] | None = None, limit: int | None = MAX_NODES) -> DataFrame:
    """Dispatch; a mode that is not available, or not known, falls back to the force layout, ``auto`` prefers anchored.

    A graph of more nodes than the limit is refused before anything is laid out, as no one could read its drawing; None lifts it.
    """
    if limit is not None:
        check_nodes(nodes, limit)
    there = available_modes(nodes)
    if mode == "auto":
        mode = there[0]
    if mode in there and mode != "force":
        return {"anchored": anchored_layout, "sample-rows": sample_row_layout}[mode](nodes, edges, region)
    from .force import force_layout

    return force_layout(nodes, edges)


def layout_bounds(positions: DataFrame, region: tuple[int, int] | None = None) -> DataFrame:
    """min_x, min_y, w, h of the drawing; on layouts along the reference x is the region's, if it has any width."""
    left, right = F.least(F.min("x0"), F.min("x1")), F.greatest(F.max("x0"), F.max("x1"))
    if region and region[1] > region[0]:
        left, right = F.lit(float(region[0])), F.lit(float(region[1]))
    return positions.agg(left.alias("min_x"), F.min("y").cast("double").alias("min_y"), (right - left).alias("w"), (F.max("y") - F.min("y")).cast("double").alias("h"))


def row_bounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """min_y and h of the anchored layout of all nodes.

    Backbone nodes and those beside them are placed in any case.  Where their rows reach as far as the rows of all nodes, no other node can change the bounds; else
    the nodes are laid out.
    """
    rows = rank_rows(nodes)
    row = F.coalesce("row", F.lit(rows.count())) * ROW
    ranked = nodes.select("node_id", is_backbone().alias("sure"), F.coalesce("sr", F.lit(1)).alias("sr")).join(F.broadcast(rows), "sr", "left").select("node_id", "sure", row.alias("y"))
    near = neighbours(edges).join(nodes.where(is_backbone()).select("node_id"), F.col("other") == F.col("node_id"), "left_semi").select(F.col("node").alias("node_id"))
    reach = [F.min("y").cast("double").alias("min_y"), (F.max("y") - F.min("y")).cast("double").alias("h")]
    sure = ranked.where("sure").unionByName(ranked.where("not sure").join(near, "node_id", "left_semi")).agg(*reach).first()
    if sure["h"] is None or sure != ranked.agg(*reach).first():
        return layout_bounds(anchored_layout(nodes, edges)).select("min_y", "h")
    return nodes.sparkSession.createDataFrame([sure], "min_y double, h double")


def pane_height(bounds: DataFrame, width: float, least: float, most: float, padding: float, pixel_rows: bool) -> DataFrame:
    """Height of a pane that fits the drawing: its rows where these are pixels, else its aspect; between the least and the most."""
    ceiling = max(least, most)
    usable = width - 2 * padding
    wanted = F.col("h") + 2 * padding if pixel_rows else F.col("h") * usable / F.col("w") + 2 * padding
    fits = F.lit(True) if pixel_rows else (F.col("w") > 0) & F.lit(usable > 0)
    return bounds.select(F.when(fits, F.least(F.lit(float(ceiling)), F.greatest(F.lit(float(least)), wanted))).otherwise(F.lit(float(ceiling))).alias("height"))


def in_view(positions: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Positions of nodes whose box meets the view; edges count."""
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    return positions.where((high >= min_x) & (low <= max_x) & (F.col("y") >= min_y) & (F.col("y") <= max_y))


def path_slots(steps: DataFrame) -> DataFrame:
    """segment and the numbers of the different path records that visit it, in order; numbers go by record order."""
    from ..storage import numbered

    records = numbered(steps.select("phase", "rec_no").distinct(), "phase", "rec_no", name="slot")
    visits = steps.select("segment", "phase", "rec_no").distinct().join(records, ["phase", "rec_no"])
    return visits.groupBy("segment").agg(F.array_sort(F.collect_list("slot")).alias("slots"))


def drawn_scale(nodes: DataFrame, least: float = LEAST_LENGTH, spread: str = "auto") -> DataFrame:
    """node_length_per_megabase, minimum_node_length, edge_length, node_segment_length.

    The least length is that of the spread, if it states a larger one; lengths of a spread that is not proportional are drawn as they are, 1,000 to a unit.
    """
    power, effect, floor = SPREADS.get(spread, SPREADS["auto"])
    least = max(least, floor)
    if (power, effect) != (1.0, 1.0):
        return nodes.sparkSession.range(1).select(F.lit(1_000_000 / PRECISION).alias("node_length_per_megabase"), F.lit(float(max(LEAST_LENGTH, least))).alias("minimum_node_length"), F.lit(EDGE_LENGTH).cast("long").alias("edge_length"), F.lit(SEGMENT_LENGTH).cast("long").alias("node_segment_length"))
    total = nodes.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bp"), F.count(F.lit(1)).alias("n"))
    target = F.greatest(F.col("n") * MEAN_LENGTH, F.lit(LEAST_TOTAL))
    return total.select(
        F.when(F.col("bp") > 0, target / (F.col("bp") / 1_000_000)).otherwise(F.lit(10_000.0)).alias("node_length_per_megabase"),
        F.lit(float(max(LEAST_LENGTH, least))).alias("minimum_node_length"),
        F.lit(EDGE_LENGTH).cast("long").alias("edge_length"),
        F.lit(SEGMENT_LENGTH).cast("long").alias("node_segment_length"),
    )


# Named spreads of lengths as (power, effect, least length).
SPREADS = {"auto": (1.0, 1.0, 0.0), "open": (1.0, 1.0, 2.5 * MEAN_LENGTH), "wide": (1.0, 1.0, 10.0 * MEAN_LENGTH), "compress": (0.5, 0.5, 0.0)}


def drawn_lengths(nodes: DataFrame, spread: str = "auto") -> DataFrame:
    """node_id and the length for the free layout: bp where the law is proportional, else drawn units times 1,000, rounded."""
    power, effect, _ = SPREADS.get(spread, SPREADS["auto"])
    if (power, effect) == (1.0, 1.0):
        return nodes.select("node_id", F.col("length").cast("long").alias("length"))
    mean = nodes.agg(F.avg("length").alias("mean_bp"), F.count(F.lit(1)).alias("n"))
    with_mean = nodes.join(mean, F.lit(True))  # one row
    drawn_mean = F.greatest(F.col("n") * MEAN_LENGTH, F.lit(LEAST_TOTAL)) / F.col("n")
    drawn = F.when(F.col("mean_bp") <= 0, drawn_mean).otherwise(F.greatest(drawn_mean * ((F.pow(F.col("length") / F.col("mean_bp"), F.lit(power)) - 1) * effect + 1), F.lit(float(LEAST_LENGTH))))
    return with_mean.select("node_id", F.floor(drawn * PRECISION + 0.5).cast("long").alias("length"))
