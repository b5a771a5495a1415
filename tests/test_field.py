"""Rounds of the force layout by parts, against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haplospan.operators import field, force

UNIT, PUSH, K = 1024, 0.06, 20.0
POINTS, SPRINGS = "component long, pid long, x long, y long", "u long, v long, rest double"


def whole(force):
    return math.floor(force + 0.5)


def pushed(dx, dy, n):
    size = dx * dx + dy * dy + (K * UNIT) * (K * UNIT) / 25
    share = n * (PUSH * (K * UNIT) ** 3) / (size * math.sqrt(size))
    return whole(dx * share), whole(dy * share)


def plain_round(points, springs, limit, levels):
    side = 2 * K * UNIT
    at = {p: (c, math.floor(x / side), math.floor(y / side)) for c, p, x, y in points}
    pyramid = []
    for level in range(levels):
        cells = {}
        for c, p, x, y in points:
            cell = cells.setdefault((c, at[p][1] >> level, at[p][2] >> level), [0, 0, 0])
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + x, cell[2] + y
        pyramid.append(cells)
    place = {p: (x, y) for _, p, x, y in points}
    pull, count = {p: [0, 0] for p in place}, dict.fromkeys(place, 0)
    for u, v, rest in springs:
        dx, dy = place[v][0] - place[u][0], place[v][1] - place[u][1]
        size = math.hypot(dx, dy) + 1
        px, py = whole(dx * ((size - rest * UNIT) / size)), whole(dy * ((size - rest * UNIT) / size))
        for end, sign in ((u, 1), (v, -1)):
            pull[end][0] += sign * px
            pull[end][1] += sign * py
            count[end] += 1
    out = []
    for c, p, x, y in points:
        fx = fy = 0
        for level, cells in enumerate(pyramid):
            tx, ty = at[p][1] >> level, at[p][2] >> level
            for (of, cx, cy), (n, sx, sy) in cells.items():
                near = abs(cx - tx) <= 1 and abs(cy - ty) <= 1
                if of != c or (level and near) or abs((cx >> 1) - (tx >> 1)) > 1 or abs((cy >> 1) - (ty >> 1)) > 1:
                    continue
                if near:
                    own = (cx, cy) == (tx, ty)
                    n, sx, sy = n - own, sx - own * x, sy - own * y
                    add = pushed(x - sx / n, y - sy / n, n) if n else (0, 0)
                else:
                    wide = side * 2.0**level
                    add = pushed((tx + 0.5) * wide - sx / n, (ty + 0.5) * wide - sy / n, n)
                fx, fy = fx + add[0], fy + add[1]
        mx, my = (pull[p][0] / count[p] if count[p] else 0.0) + fx, (pull[p][1] / count[p] if count[p] else 0.0) + fy
        size = math.hypot(mx, my)
        short = limit * UNIT / size if size > limit * UNIT else 1.0
        out.append((c, p, x + whole(mx * short), y + whole(my * short)))
    return out


def drawn(seed):
    """Components as a long walk, a heap, a hub with leaves in one place, a point alone."""
    draw, points, springs = random.Random(seed), [], []
    x = y = 0.0
    for p in range(120):
        points.append((0, p, round(x * UNIT), round(y * UNIT)))
        x, y = x + draw.uniform(-10, 180), y + draw.uniform(-60, 60)
        springs += [(p, p + 1, 20.0)] * (p < 119) + [(p, p + 37, 33.5)] * (p % 9 == 0 and p < 80)
    points += [(500, p, draw.randrange(-40000, 40000), draw.randrange(-40000, 40000)) for p in range(500, 560)]
    springs += [(p, draw.randrange(p + 1, 561) if p < 559 else 559, 12.25) for p in range(500, 559)]
    springs = [(u, min(v, 559) if u >= 500 else v, rest) for u, v, rest in springs]
    points += [(700, 700, 5, 5), *[(700, p, 7000, 0) for p in range(701, 731)], (900, 900, -(10**9), 10**9)]
    springs += [(700, p, 10.0) for p in range(701, 731)]
    return points, sorted(set(springs))


@pytest.mark.parametrize("size", [10**6, 60, 9])
def test_rounds_against_a_loop(spark, size):
    points, springs = drawn(4)
    limits, levels = [45.0, 30.0, 20.0, 15.0, 10.0, 6.0, 3.0, 1.5], 17
    want = points
    for limit in limits:
        want = plain_round(want, springs, limit, levels)
    p, s = spark.createDataFrame(points, POINTS).repartition(3), spark.createDataFrame(springs, SPRINGS).repartition(2)
    got = field.rounds(p, s, limits, lambda parts: field.Setting(UNIT, PUSH, K, levels, parts), size)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rounds_without_springs_or_points(spark):
    def setting(parts):
        return field.Setting(UNIT, PUSH, K, 3, parts)

    none = spark.createDataFrame([], SPRINGS)
    assert field.rounds(spark.createDataFrame([], POINTS), none, [1.0], setting).count() == 0
    points = [(c, p, 3000 * p, -p) for p in range(12) for c in [p % 2]]
    for size in (100, 3):
        got = field.rounds(spark.createDataFrame(points, POINTS), none, [1.0], setting, size)
        assert sorted(map(tuple, got.collect())) == sorted(plain_round(points, [], 1.0, 3))


def test_rounds_of_a_level_are_few_jobs(spark):
    """Before, each round was two tables in storage and joins by cell, which took minutes for a million points."""
    n = 3000
    points = spark.range(n).select(F.lit(0).cast("long").alias("component"), F.col("id").alias("pid"), (F.col("id") * 9000).alias("x"), (F.col("id") % 7 * 5000).alias("y"))
    springs = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(10.0).alias("rest"))
    context = spark.sparkContext
    context.setJobGroup("rounds", "rounds of a level")
    try:
        assert force.relaxed(points, springs, 5).count() == n
        assert len(context.statusTracker().getJobIdsForGroup("rounds")) < 20
    finally:
        context.setJobGroup("tests", "")
