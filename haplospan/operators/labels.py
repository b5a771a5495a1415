"""Labels of a drawing: what deletions and nodes say, where, and which of them keep clear of each other.

A view is the screen: scale_x, scale_y (pixels for a unit of each axis), left, top (where the origin lies), width, height.  Candidates
come in one order: deletion edges, then alleles that delete, then nodes, each the most bases first (ties by edge, run, record).  A candidate is
kept if its box shows on the screen and overlaps neither a reserved box nor one kept before it.

Placement runs in rounds over cells of the screen.  A box that is the first in all cells that it touches has nothing before it to yield to, so it
stays; those that it overlaps go.  The first of each cell and the boxes that stay are bounded by the screen, whatever the graph; the
candidates stay distributed.  A round settles at least the first open candidate, so rounds are at most as many as cells.

Defined cases: nodes without points or length and edges without curve have no candidate; places that are null or no number are off the
screen; repeated rows give one label; empty tables give none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import format_bp
from ..storage import cut
from .curves import midpoint
from .edges import curve_boxes

# Fixed values, in pixels: metrics of a label's text and box, the least arc that has a label, the gap before a label beside its arc.
CHAR, PADDING, LINE, GAP = 5.7, 6.0, 13.0, 3.0
HALF_HEIGHT = (LINE + GAP) / 2
OVERHANG = 2.0
LEAST_ARC = 26.0
LEADER_GAP = 8.0
# Fixed values, in pixels: metrics of the labels of rows.
ROW_LEFT, ROW_CHAR, ROW_PADDING, ROW_HALF = 6.0, 6.2, 8.0, 8.0

CELL_X, CELL_Y = 64.0, 16.0
BOX = ("left", "right", "top", "bottom")
LEADER = ("arc_x", "arc_y", "label_x", "label_y")
LABEL = ("key", "kind", "text", "x", "y", *LEADER)


class View(NamedTuple):
    scale_x: float
    scale_y: float
    left: float
    top: float
    width: float
    height: float


def code_units(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def half_width(text: Column) -> Column:
    return (code_units(text) * CHAR + PADDING + GAP) / 2


def slid(value: Column, low: Column, high: Column) -> Column:
    """A value moved into a range; as it is where the range is empty."""
    return F.when(high < low, value).otherwise(F.least(F.greatest(value, low), high))


def row_label_boxes(rows: DataFrame, view: View) -> DataFrame:
    """label and the box that the label of a row takes; rows: label, y."""
    y = F.col("y") * view.scale_y + view.top
    right = ROW_LEFT + code_units(F.col("label")) * ROW_CHAR + ROW_PADDING + GAP
    return rows.select("label", F.lit(ROW_LEFT).alias("left"), right.alias("right"), (y - ROW_HALF - GAP / 2).alias("top"), (y + ROW_HALF + GAP / 2).alias("bottom"))


def shown(boxes: DataFrame, view: View) -> DataFrame:
    return boxes.where((F.col("right") > 0) & (F.col("left") < view.width) & (F.col("bottom") > 0) & (F.col("top") < view.height))


def finished(rows: DataFrame, kind: str, turn: int, tie: Column) -> DataFrame:
    """Candidates as they are placed: order, label columns, box; rows: key, text, bp, x, y, half and maybe the ends of a leader."""
    leader = [(F.col(n) if n in rows.columns else F.lit(None)).cast("double").alias(n) for n in LEADER]
    x, y, half = F.col("x"), F.col("y"), F.col("half")
    order = F.struct(F.lit(turn).alias("turn"), (-F.col("bp")).cast("double").alias("bp"), tie.cast("string").alias("by"), F.col("key"))
    box = [(x - half).alias("left"), (x + half).alias("right"), (y - HALF_HEIGHT).alias("top"), (y + HALF_HEIGHT).alias("bottom")]
    return rows.select(order.alias("order"), "key", F.lit(kind).alias("kind"), "text", "x", "y", *leader, *box)


def padded(number: Column) -> Column:
    """A number of a record as text that sorts alike."""
    return F.lpad(number.cast("string"), 20, "0")


def deletion_candidates(deletions: DataFrame, curves: DataFrame, view: View) -> DataFrame:
    """Labels of deletion edges.  deletions: edge_no, bp; curves: edge_no, curves (in units of the layout).

    A label wider than twice its arc stands beside it, where the arc bows to, with a leader from the arc to the box, and inside the screen.
    """
    drawn = cut(curve_boxes(curves.where(F.size("curves") > 0)).join(deletions.select("edge_no", "bp"), "edge_no"))  # short tables; without these cuts the compiled code of all steps is too long
    half = half_width(F.col("text"))
    middle = midpoint(F.get("curves", F.floor(F.size("curves") / 2).cast("int")))
    first, last = F.get("curves", F.lit(0)), F.get("curves", F.size("curves") - 1)
    extent = F.greatest((F.col("max_x") - F.col("min_x")) * view.scale_x, (F.col("max_y") - F.col("min_y")) * view.scale_y)
    found = drawn.select(
        "edge_no", "bp", F.concat(format_bp(F.col("bp")), F.lit(" deletion")).alias("text"), extent.alias("extent"),
        (middle["x"] * view.scale_x + view.left).alias("arc_x"), (middle["y"] * view.scale_y + view.top).alias("arc_y"),
        ((middle["x"] - (first["x0"] + last["x3"]) / 2) * view.scale_x).alias("dx"), ((middle["y"] - (first["y0"] + last["y3"]) / 2) * view.scale_y).alias("dy"),
    ).where(F.col("extent") >= LEAST_ARC)
    found = cut(found)
    found = found.withColumns({"half": half, "far": F.hypot("dx", "dy"), "inside": F.col("extent") >= half * 2 / OVERHANG})
    found = found.withColumns({"ux": F.coalesce(F.try_divide("dx", "far"), F.lit(0.0)), "uy": F.coalesce(F.try_divide("dy", "far"), F.lit(-1.0))})
    found = found.withColumn("by", F.abs("ux") * F.col("half") + F.abs("uy") * HALF_HEIGHT + LEADER_GAP)
    beside_x = slid(F.col("arc_x") + F.col("ux") * F.col("by"), F.col("half"), F.lit(view.width) - F.col("half"))
    beside_y = slid(F.col("arc_y") + F.col("uy") * F.col("by"), F.lit(HALF_HEIGHT), F.lit(view.height - HALF_HEIGHT))
    found = found.withColumns({"x": F.when(F.col("inside"), F.col("arc_x")).otherwise(beside_x), "y": F.when(F.col("inside"), F.col("arc_y")).otherwise(beside_y)})
    found = cut(found.drop("ux", "uy", "by", "far", "dx", "dy", "extent"))
    away = F.hypot(F.col("x") - F.col("arc_x"), F.col("y") - F.col("arc_y"))
    found = found.withColumns({"tx": F.try_divide(F.col("x") - F.col("arc_x"), away), "ty": F.try_divide(F.col("y") - F.col("arc_y"), away)})
    stop = F.least(F.try_divide("half", F.abs("tx")), F.try_divide(F.lit(HALF_HEIGHT), F.abs("ty")))  # the nearer side of the box
    tied = ~F.col("inside") & F.col("tx").isNotNull()
    ends = {"label_x": F.col("x") - F.col("tx") * stop, "label_y": F.col("y") - F.col("ty") * stop}
    found = found.withColumn("key", F.concat(F.lit("del:"), F.col("edge_no").cast("string"))).withColumns(ends)
    return finished(found.withColumns({n: F.when(tied, F.col(n)) for n in LEADER}), "deletion", 0, padded(F.col("edge_no")))


def allele_candidates(runs: DataFrame, drawn: DataFrame, view: View) -> tuple[DataFrame, DataFrame]:
    """Labels of alleles that delete, in the middle of what shows of them, and the nodes (node_id) that are not to be labelled for that.

    runs: run, nodes, bp; drawn: node_id, points.
    """
    of = runs.select("run", "bp", F.explode("nodes").alias("node_id")).distinct()
    xs, ys = F.col("points.x"), F.col("points.y")
    spread = drawn.where(F.size("points") > 0).select("node_id", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    all_of = of.join(spread, "node_id").groupBy("run", "bp").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    seen = all_of.select(
        "run", "bp", F.concat(format_bp(F.col("bp")), F.lit(" deletion")).alias("text"),
        F.greatest(F.col("x0") * view.scale_x + view.left, F.lit(0.0)).alias("a"), F.least(F.col("x1") * view.scale_x + view.left, F.lit(float(view.width))).alias("b"),
        F.greatest(F.col("y0") * view.scale_y + view.top, F.lit(0.0)).alias("c"), F.least(F.col("y1") * view.scale_y + view.top, F.lit(float(view.height))).alias("d"),
    ).where("b >= a AND d >= c").withColumn("half", half_width(F.col("text")))
    fit = seen.where(F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c")) >= F.col("half") * 2 / OVERHANG)
    x = slid((F.col("a") + F.col("b")) / 2, F.col("half"), F.lit(view.width) - F.col("half"))
    y = slid((F.col("c") + F.col("d")) / 2, F.lit(HALF_HEIGHT), F.lit(view.height - HALF_HEIGHT))
    placed = fit.select("run", "bp", "text", "half", x.alias("x"), y.alias("y")).withColumn("key", F.concat(F.lit("alleledel:"), F.col("run").cast("string")))
    barred = of.join(fit.select("run"), "run", "left_semi").select("node_id").distinct()
    return finished(placed, "deletion", 1, F.col("run")), barred


def node_candidates(nodes: DataFrame, drawn: DataFrame, view: View, barred: DataFrame | None = None) -> DataFrame:
    """Labels of the nodes that are drawn at least half as long as their length's text.  nodes: node_id, rec_no, length; drawn: node_id, points."""
    p = F.col("points")
    ahead = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.size(p)), lambda a, b: F.hypot((b["x"] - a["x"]) * view.scale_x, (b["y"] - a["y"]) * view.scale_y))
    middle = F.get(p, F.floor(F.size(p) / 2).cast("int"))
    placed = drawn.where(F.size(p) > 0).select(
        "node_id", F.aggregate(ahead, F.lit(0.0), lambda total, step: total + step).alias("drawn"),
        (middle["x"] * view.scale_x + view.left).alias("x"), (middle["y"] * view.scale_y + view.top).alias("y"),
    ).where((F.col("y") + HALF_HEIGHT > 0) & (F.col("y") - HALF_HEIGHT < view.height))
    named = nodes.where(F.col("length").isNotNull()).select("node_id", "rec_no", F.col("length").alias("bp"), format_bp(F.col("length")).alias("text"))
    found = placed.join(named, "node_id").withColumn("half", half_width(F.col("text"))).where(F.col("drawn") >= F.col("half") * 2 / OVERHANG)
    if barred is not None:
        found = found.join(barred, "node_id", "left_anti")
    return finished(found.withColumn("key", F.concat(F.lit("node:"), F.col("node_id"))), "node", 2, padded(F.col("rec_no")))


def celled(boxes: DataFrame) -> DataFrame:
    """One row for each cell that a box touches, with the number of them."""

    def cells(low: str, high: str, size: float) -> Column:
        return F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))

    wide, high = cells("left", "right", CELL_X), cells("top", "bottom", CELL_Y)
    return boxes.withColumn("n_cells", F.size(wide) * F.size(high)).withColumn("cx", F.explode(wide)).withColumn("cy", F.explode(high))


def without(candidates: DataFrame, boxes: DataFrame, bounded: bool) -> DataFrame:
    """The candidates that overlap none of the boxes; bounded says that there are no more boxes than the screen has room for."""
    other = celled(boxes.select(*[F.col(n).alias(n) for n in BOX])).select("cx", "cy", *[F.col(n).alias(f"_{n}") for n in BOX])
    meet = (F.col("left") < F.col("_right")) & (F.col("_left") < F.col("right")) & (F.col("top") < F.col("_bottom")) & (F.col("_top") < F.col("bottom"))
    hit = celled(candidates.select("key", *BOX)).join(F.broadcast(other) if bounded else other, ["cx", "cy"]).where(meet).select("key").distinct()
    return candidates.join(hit, "key", "left_anti")


def place(candidates: DataFrame, view: View, reserved: DataFrame | None = None) -> DataFrame:
    """The label columns of the candidates that stay; reserved: boxes that are taken already."""
    rest = [n for n in (*LABEL, *BOX) if n != "key"]
    one = shown(candidates, view).groupBy("key").agg(F.min(F.struct("order", *rest)).alias("f"))  # one row for each key
    left = one.select("key", "f.*")
    if reserved is not None:
        left = without(left, reserved, False)
    left = cut(left)
    kept = left.limit(0).select(*LABEL)
    while not left.isEmpty():
        firsts = celled(left).groupBy("cx", "cy").agg(F.min_by(F.struct("key", "n_cells", *rest), "order").alias("f"))
        count = firsts.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        staying = cut(count.where(F.col("n") == F.col("f.n_cells")).select("f.*"))
        kept = kept.unionByName(staying.select(*LABEL))
        left = cut(without(left, staying, True))
    return kept


def graph_labels(nodes: DataFrame, drawn: DataFrame, view: View, deletions: DataFrame, curves: DataFrame, runs: DataFrame | None = None, reserved: DataFrame | None = None) -> DataFrame:
    """All labels of a drawing: key, kind, text, x, y and the ends of a leader (null without one), in pixels."""
    found, barred = deletion_candidates(deletions, curves, view), None
    if runs is not None:
        runs = cut(runs)  # read twice
        more, barred = allele_candidates(runs, drawn, view)
        found = found.unionByName(more)
    return place(found.unionByName(node_candidates(nodes, drawn, view, barred)), view, reserved)
