"""A grid of levels: boxes meet points by cell, and the nearest drawn node to each of a table of points.

A box goes to the first level whose cells are larger than itself in both directions, so it touches four cells at most, whatever its size; a point
asks one cell of each level that holds a box.  Cells of level 0 have a given size, those of each further level twice that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_of(width: Column, height: Column, cell_x: Column, cell_y: Column) -> Column:
    times = F.greatest(width / cell_x, height / cell_y)
    return F.when(times < 1, 0).otherwise(F.floor(F.log2(times)) + 1).cast("int")


def leveled(boxes: DataFrame, cell_x: Column, cell_y: Column) -> DataFrame:
    """The boxes (min_x, min_y, max_x, max_y) with level, cx and cy of each cell that they touch: at most four rows for each."""
    sized = boxes.withColumn("level", level_of(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), cell_x, cell_y))
    for axis, cell in (("x", cell_x), ("y", cell_y)):
        wide = cell * F.pow(F.lit(2.0), F.col("level"))
        sized = sized.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(F.col(f"min_{axis}") / wide), F.floor(F.col(f"max_{axis}") / wide))))
    return sized


def asked(points: DataFrame, levels: list[int], cell_x: Column, cell_y: Column) -> DataFrame:
    """The points (px, py) with level, cx and cy of the cell that they ask on each level."""
    each = points.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    wide = F.pow(F.lit(2.0), F.col("level"))
    return each.withColumns({"cx": F.floor(F.col("px") / (cell_x * wide)), "cy": F.floor(F.col("py") / (cell_y * wide))})


def met(points: DataFrame, boxes: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """Every point (point_id, px, py) with every box that holds it, borders included, once for each pair."""
    x, y = F.lit(float(cell_x)), F.lit(float(cell_y))
    held = leveled(boxes, x, y)
    levels = sorted(r[0] for r in held.select("level").distinct().collect())  # levels are logarithms of sizes
    inside = F.col("px").between(F.col("min_x"), F.col("max_x")) & F.col("py").between(F.col("min_y"), F.col("max_y"))
    return asked(points, levels, x, y).join(held, ["level", "cx", "cy"]).where(inside).drop("level", "cx", "cy")


def nearest_nodes(points: DataFrame, positions: DataFrame, radius: float, cell_x: float, cell_y: float) -> DataFrame:
    """points: point_id, px, py.  The nearest node within the radius (not on it), the smallest id on ties."""
    low, high, y = F.least("x0", "x1"), F.greatest("x0", "x1"), F.col("y")
    boxes = positions.select("node_id", "x0", "x1", "y", (low - radius).alias("min_x"), (high + radius).alias("max_x"), (y - radius).alias("min_y"), (y + radius).alias("max_y"))
    near = met(points.select("point_id", "px", "py"), boxes, max(cell_x, 2 * radius), max(cell_y, 2 * radius))
    dx = F.greatest(low - F.col("px"), F.col("px") - high, F.lit(0.0))
    near = near.withColumn("distance", F.hypot(dx, y - F.col("py"))).where(F.col("distance") < radius)
    best = Window.partitionBy("point_id").orderBy("distance", "node_id")
    return near.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("point_id", "node_id", "distance")
