"""Cubic curves as structs of eight doubles: x0, y0, x1, y1, x2, y2, x3, y3 (start, two controls, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")


#: Least share of a joint's normal along its sides (fixed value).
MITRE = 0.1
#: Steps along a curve at which its distance from a point is taken.
SAMPLES = 20


def curve(*values: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(values, NAMES, strict=True)])


def point(of: Column, t: Column) -> Column:
    """Struct of x and y at t."""
    s = F.lit(1.0) - t

    def along(axis: str) -> Column:
        return of[f"{axis}0"] * s * s * s + of[f"{axis}1"] * s * s * t * 3 + of[f"{axis}2"] * s * t * t * 3 + of[f"{axis}3"] * t * t * t

    return F.struct(along("x").alias("x"), along("y").alias("y"))


def midpoint(of: Column) -> Column:
    return point(of, F.lit(0.5))


def bounds(of: Column) -> Column:
    """The box of the control points, which holds the curve."""
    xs, ys = [of[f"x{k}"] for k in range(4)], [of[f"y{k}"] for k in range(4)]
    return F.struct(F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y"))


def moved(of: Column, dx: Column, dy: Column) -> Column:
    return curve(*[of[n] + (dx if n[0] == "x" else dy) for n in NAMES])


def part(of: Column, a: Column, b: Column) -> Column:
    """The curve between parameters a and b."""
    third = (b - a) / 3

    def slope(axis: str, t: Column) -> Column:
        s = F.lit(1.0) - t
        p = [of[f"{axis}{k}"] for k in range(4)]
        return (p[1] - p[0]) * s * s * 3 + (p[2] - p[1]) * s * t * 6 + (p[3] - p[2]) * t * t * 3

    start, end = point(of, a), point(of, b)
    first = [start[c] + slope(c, a) * third for c in "xy"]
    second = [end[c] - slope(c, b) * third for c in "xy"]
    return curve(start["x"], start["y"], *first, *second, end["x"], end["y"])


def distance(of: Column, x: Column, y: Column, steps: int = SAMPLES) -> Column:
    """The least distance of a point from samples along the curve."""

    def at(k: Column) -> Column:
        p = point(of, k / float(steps))
        return F.hypot(p["x"] - x, p["y"] - y)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(steps)), at))


def dashes(of: Column, count: int) -> Column:
    """Every other part of an odd number of equal parts, at least three."""
    n = max(3, count | 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1), F.lit(2)), lambda k: part(of, k / float(n), (k + 1) / float(n)))


def normals(points: Column, ratio: float = 1.0) -> Column:
    """A unit normal (x, y) for each of the points of a line, mitred where it bends, so that a stroke keeps its width.

    ratio: units of x for a unit of y.  Bends so sharp that the mitre would be longer than ten have none; points without extent around them
    have no normal, which is 0.
    """

    def of(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], (b["y"] - a["y"]) * ratio
        size = F.hypot(dx, dy)
        return F.when(size > 0, F.struct((-dy / size).alias("x"), (dx / size).alias("y")))

    n = F.size(points)
    sides = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), of)
    none = F.array(F.lit(None).cast("struct<x:double,y:double>"))

    def joint(a: Column, b: Column) -> Column:
        mx, my = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2
        dot = a["x"] * mx + a["y"] * my
        by = F.when(dot > MITRE, dot).otherwise(F.lit(1.0))
        both = F.struct((mx / by).alias("x"), (my / by).alias("y"))
        return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))

    return F.zip_with(F.concat(none, sides), F.concat(sides, none), joint)


def shifted(points: Column, by: float | Column, ratio: float = 1.0) -> Column:
    """The line moved sideways along its normals, `by` in units of x."""
    return F.zip_with(points, normals(points, ratio), lambda p, n: F.struct((p["x"] + n["x"] * by).alias("x"), (p["y"] + n["y"] * by / ratio).alias("y")))


def end_angle(of: Column, ratio: float = 1.0) -> Column:
    """The angle in which a curve ends, as drawn: from its last control to its end, or along its chord where these are one."""
    dx, dy = of["x3"] - of["x2"], (of["y3"] - of["y2"]) * ratio
    chord = F.atan2((of["y3"] - of["y0"]) * ratio, of["x3"] - of["x0"])
    return F.when(F.hypot(dx, dy) > 0, F.atan2(dy, dx)).otherwise(chord)
