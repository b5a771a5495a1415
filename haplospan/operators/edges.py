"""Edges of a drawing: curves between drawn nodes, arcs around what a deletion skips, ribbons of paths, hits of points.

drawn: node_id and points, an array of structs x, y along the node.  Where the axes differ (rows in pixels, x in bases), lengths are
taken with y in units of x: ``scale_y / scale_x`` of them for each unit of y.  Nodes without points, and edges of such nodes, have no curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, dealt, spread
from .curves import NAMES, SAMPLES, bounds, curve, moved, point

# Reach of control points, clearance of arcs, size of loops, distance of ribbons, radius of a hit, cell without any box.
TANGENT_SHARE, MOST_TANGENT = 0.5, 80.0
APEX_SHARE, CLEARANCE, ALONG_SHARE = 0.75, 1.15, 0.35
LOOP = 50.0
RIBBON_SPACING = 3.0
EDGE_RADIUS = 10.0
EMPTY_CELL = 50.0


def polylines(positions: DataFrame) -> DataFrame:
    """node_id and points of the nodes of a row layout (node_id, x0, x1, y)."""

    def at(x: str) -> Column:
        return F.struct(F.col(x).cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    return positions.select("node_id", F.array(at("x0"), at("x1")).alias("points"))


def in_x_units(drawn: DataFrame, ratio: float) -> DataFrame:
    points = F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), (p["y"].cast("double") * ratio).alias("y")))
    return drawn.where(F.size("points") > 0).select("node_id", points.alias("points"))


def joined(edges: DataFrame, drawn: DataFrame) -> DataFrame:
    """The edges with the points of both nodes, as a and b."""
    a = drawn.select(F.col("node_id").alias("from_id"), F.col("points").alias("a"))
    b = drawn.select(F.col("node_id").alias("to_id"), F.col("points").alias("b"))
    return edges.join(a, "from_id").join(b, "to_id")


def attached(ends: DataFrame) -> DataFrame:
    """Adds loop, f and t (points where the edge leaves and enters) and f_in and t_in (the next points inside the nodes, null without one).

    Each node is joined at the end nearer to the other's extent in x; on a tie from its last point to the other's first, as in a loop.
    """

    def gap(point: Column, other: Column) -> Column:
        xs = F.transform(other, lambda p: p["x"])
        return F.greatest(F.lit(0.0), F.array_min(xs) - point["x"], point["x"] - F.array_max(xs))

    def sides(points: Column, other: Column) -> tuple[Column, Column]:
        return gap(F.get(points, F.lit(0)), other), gap(F.get(points, F.size(points) - 1), other)

    a, b = F.col("a"), F.col("b")
    (a_first, a_last), (b_first, b_last) = sides(a, b), sides(b, a)
    at_last = ends.withColumns({"loop": F.col("from_id") == F.col("to_id")}).withColumns({"f_last": F.col("loop") | (a_last <= a_first), "t_last": ~F.col("loop") & (b_last < b_first)})

    def pick(points: Column, last: str, inside: int) -> Column:
        return F.get(points, F.when(F.col(last), F.size(points) - 1 - inside).otherwise(F.lit(inside)))

    return at_last.withColumns({"f": pick(a, "f_last", 0), "t": pick(b, "t_last", 0), "f_in": pick(a, "f_last", 1), "t_in": pick(b, "t_last", 1)}).drop("a", "b", "f_last", "t_last")


def unit(dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """Length and direction; the direction of no length is null."""
    length = F.hypot(dx, dy)
    return length, F.try_divide(dx, length), F.try_divide(dy, length)


def bows(ends: DataFrame, bypassed: DataFrame, drawn: DataFrame) -> DataFrame:
    """edge_no and bulge: how far to which side of its chord an arc passes to enclose the nodes that it skips.

    Partial aggregates over the points, so that a deletion of very many nodes is no list.  The farthest point decides the side, the first on ties.
    """
    run = bypassed.select("edge_no", F.posexplode("bypassed").alias("place", "node_id")).join(drawn, "node_id")
    points = run.select("edge_no", "place", F.posexplode("points").alias("at", "p"))
    dx, dy = F.col("t.x") - F.col("f.x"), F.col("t.y") - F.col("f.y")
    _, ux, uy = unit(dx, dy)
    chords = ends.select("edge_no", F.col("f.x").alias("fx"), F.col("f.y").alias("fy"), F.coalesce(ux, F.lit(1.0)).alias("ux"), F.coalesce(uy, F.lit(0.0)).alias("uy"))
    x, y = F.col("p.x") - F.col("fx"), F.col("p.y") - F.col("fy")
    off = points.join(dealt(chords), "edge_no").select("edge_no", "place", "at", (y * F.col("ux") - x * F.col("uy")).alias("off"), (x * F.col("ux") + y * F.col("uy")).alias("along"))
    far = F.max_by("off", F.struct(F.abs("off"), -F.col("place"), -F.col("at")))
    found = off.groupBy("edge_no").agg(far.alias("reach"), (F.max("along") - F.min("along")).alias("span"))
    size = F.greatest(F.abs("reach") * CLEARANCE / APEX_SHARE, F.col("span") * ALONG_SHARE)
    return found.select("edge_no", F.when(F.col("reach") < 0, -size).otherwise(size).alias("bulge"))


def edge_curves(edges: DataFrame, drawn: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, bypassed: DataFrame | None = None) -> DataFrame:
    """edge_no and curves: one cubic for an edge, two for a loop.  edges: edge_no, from_id, to_id.

    Controls follow the direction of their nodes, at most as far as the other end lies that way.  bypassed (edge_no and an array of node
    ids): these edges bow around the named nodes.
    """
    ratio = scale_y / scale_x
    flat = in_x_units(drawn, ratio)
    ends = attached(joined(edges.select("edge_no", "from_id", "to_id"), flat))
    if bypassed is None:
        ends = ends.withColumn("bulge", F.lit(0.0))
    else:
        ends = spread(cut(ends), "edge_no")  # read twice; sorted with all that is said of an edge
        ends = ends.join(dealt(bows(ends, bypassed, flat)), "edge_no", "left").withColumn("bulge", F.coalesce("bulge", F.lit(0.0)))
    fx, fy, tx, ty = F.col("f.x"), F.col("f.y"), F.col("t.x"), F.col("t.y")
    dist, ux, uy = unit(tx - fx, ty - fy)
    ux, uy = F.coalesce(ux, F.lit(0.0)), F.coalesce(uy, F.lit(0.0))

    def control(at: str, inside: str, other: str) -> tuple[Column, Column]:
        """The end of the tangent outward from the node; a node of one point has the direction of the chord."""
        toward = [F.col(f"{other}.{c}") - F.col(f"{at}.{c}") for c in "xy"]
        _, vx, vy = unit(*[F.coalesce(F.col(f"{at}.{c}") - F.col(f"{inside}.{c}"), w) for c, w in zip("xy", toward, strict=True)])
        vx, vy = F.coalesce(vx, F.lit(0.0)), F.coalesce(vy, F.lit(0.0))
        reach = F.greatest(F.lit(0.0), F.least(dist * TANGENT_SHARE, F.lit(MOST_TANGENT), (toward[0] * vx + toward[1] * vy) * TANGENT_SHARE))
        return F.col(f"{at}.x") + vx * reach, F.col(f"{at}.y") + vy * reach

    (ax, ay), (bx, by) = control("f", "f_in", "t"), control("t", "t_in", "f")
    bulge = F.col("bulge")
    open_x, open_y = ux * F.abs(bulge), uy * F.abs(bulge)
    single = curve(fx, fy, ax - uy * bulge - open_x, ay + ux * bulge - open_y, bx - uy * bulge + open_x, by + ux * bulge + open_y, tx, ty)

    size = min(LOOP, LOOP * scale_x)
    _, vx, vy = unit(fx - F.col("f_in.x"), fy - F.col("f_in.y"))
    vx, vy = F.coalesce(vx, F.lit(1.0)) * size, F.coalesce(vy, F.lit(0.0)) * size
    mx, my = (fx + tx) / 2 - vy, (fy + ty) / 2 + vx
    there = curve(fx, fy, fx + vx, fy + vy, fx + vx - vy, fy + vy + vx, mx, my)
    back = curve(mx, my, tx - vx - vy, ty - vy + vx, tx - vx, ty - vy, tx, ty)
    made = F.when(F.col("loop"), F.array(there, back)).otherwise(F.array(single))
    return ends.select("edge_no", F.transform(made, lambda c: stretched(c, 1 / ratio)).alias("curves"))


def stretched(of: Column, ratio: float) -> Column:
    """A curve with its y multiplied."""
    return curve(*[of[n] * ratio if n[0] == "y" else of[n] for n in NAMES])


def ribbon_offsets(edges: DataFrame, drawn: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, spacing: float = RIBBON_SPACING) -> DataFrame:
    """edge_no and offsets (x, y): the shift of the ribbon of each of an edge's paths, across the edge as drawn.

    edges: edge_no, from_id, to_id, path_ids.  An edge without extent takes the direction of its first node, else of its second, else of x.
    """
    ratio = scale_y / scale_x
    count = F.coalesce(F.size("path_ids"), F.lit(0))
    ends = joined(edges.select("edge_no", "from_id", "to_id", F.greatest(count, F.lit(0)).alias("paths")), in_x_units(drawn, ratio))

    def first(points: str) -> Column:
        return F.get(points, F.lit(0))

    def last(points: str) -> Column:
        return F.get(points, F.size(points) - 1)

    ways = [unit(q["x"] - p["x"], q["y"] - p["y"])[1:] for p, q in ((last("a"), first("b")), (first("a"), last("a")), (first("b"), last("b")))]
    dx, dy = F.coalesce(*[w[0] for w in ways], F.lit(1.0)), F.coalesce(*[w[1] for w in ways], F.lit(0.0))
    along = ends.select("edge_no", "paths", dx.alias("dx"), dy.alias("dy"))

    def offset(k: Column) -> Column:
        far = (k - (F.col("paths") - 1) / 2) * spacing
        return F.struct((-F.col("dy") * far).alias("x"), (F.col("dx") * far / ratio).alias("y"))

    numbers = F.when(F.col("paths") > 0, F.sequence(F.lit(0), F.col("paths") - 1)).otherwise(F.array().cast("array<int>"))
    return along.select("edge_no", F.transform(numbers, offset).alias("offsets"))


def ribbons(curves: DataFrame, offsets: DataFrame) -> DataFrame:
    """edge_no, path_no and curves of every path's ribbon."""
    each = offsets.select("edge_no", F.posexplode("offsets").alias("path_no", "by"))
    shifted = F.transform("curves", lambda c: moved(c, F.col("by")["x"], F.col("by")["y"]))
    return curves.join(each, "edge_no").select("edge_no", "path_no", shifted.alias("curves"))


def curve_boxes(curves: DataFrame) -> DataFrame:
    """The rows with min_x, min_y, max_x, max_y of all their curves."""
    boxes = F.transform("curves", bounds)

    def side(name: str) -> Column:
        return F.transform(boxes, lambda b: b[name])

    ends = {f"{name}_{c}": pick(side(f"{name}_{c}")) for name, pick in (("min", F.array_min), ("max", F.array_max)) for c in "xy"}
    return curves.withColumns(ends)


def cell_size(boxes: DataFrame) -> DataFrame:
    """One row, cell_x and cell_y: the mean extent of the boxes (at least 1); for y, where no box has any, the distance of their rows, else as x."""
    wide, high = F.sum(F.col("max_x") - F.col("min_x")), F.sum(F.col("max_y") - F.col("min_y"))
    found = boxes.agg(F.count(F.lit(1)).alias("n"), wide.alias("wide"), high.alias("high"), F.count_distinct("min_y").alias("rows"), (F.max("min_y") - F.min("min_y")).alias("spread"))
    x = F.when(F.col("n") > 0, F.greatest(F.lit(1.0), F.try_divide(F.col("wide"), F.col("n")))).otherwise(F.lit(EMPTY_CELL))
    y = F.when(F.col("high") > 0, F.greatest(F.lit(1.0), F.try_divide(F.col("high"), F.col("n")))).when(F.col("rows") > 1, F.try_divide(F.col("spread"), F.col("rows") - 1)).otherwise(x)
    return found.select(x.alias("cell_x"), y.alias("cell_y"))


def edges_in_view(curves: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """The curves of which the box of all control points meets the view; borders count.  Such a box holds its curve, so what is seen is never left out."""
    boxes = curve_boxes(curves)
    seen = (F.col("max_x") >= min_x) & (F.col("min_x") <= max_x) & (F.col("max_y") >= min_y) & (F.col("min_y") <= max_y)
    return boxes.where(seen).select(*curves.columns)


def nearest_edges(points: DataFrame, curves: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, radius: float = EDGE_RADIUS) -> DataFrame:
    """points: point_id, px, py.  point_id, edge_no and distance of the nearest edge within the radius (pixels, not on it), the least number on ties.

    curves: edge_no, curves, also the ribbons' (several rows of one edge).  The distance is that of the nearest sample of a curve, so samples meet points
    by the cells of a grid as wide as the radius, of which a point asks nine: work grows with curves and points, however far curves reach.  Of samples on one spot
    the least number stands for all.
    """
    ratio, reach = scale_y / scale_x, radius / scale_x
    side = reach * (1 + 1e-6)  # wider than what is asked by more than rounding

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / side)

    each = curves.select("edge_no", F.explode("curves").alias("c")).select("edge_no", stretched(F.col("c"), ratio).alias("c"))
    each = each.select("edge_no", "c", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES))).alias("k"))
    spots = each.select("edge_no", point(F.col("c"), F.col("k") / float(SAMPLES)).alias("at")).select("edge_no", "at.x", "at.y").withColumns({"cx": cell("x"), "cy": cell("y")})
    spots = spots.repartition("cx", "cy").groupBy("cx", "cy", "x", "y").agg(F.min("edge_no").alias("edge_no"))  # dealt once, as the join needs them
    asking = points.select("point_id", "px", (F.col("py") * ratio).alias("py"))
    for axis in "xy":
        asking = asking.withColumn(f"c{axis}", F.explode(F.sequence(cell(f"p{axis}") - 1, cell(f"p{axis}") + 1)))
    near = spots.join(dealt(asking), ["cx", "cy"]).select("point_id", "edge_no", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("distance"))
    best = F.min(F.struct("distance", "edge_no")).alias("b")
    return near.where(F.col("distance") < reach).groupBy("point_id").agg(best).select("point_id", "b.edge_no", "b.distance")
