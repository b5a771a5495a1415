"""Curves, loops, ribbons and hits on small drawings; hits against all pairs."""

import math
import random

from pyspark.sql import functions as F

from haplospan import storage
from haplospan.operators import edges, spatial

POINTS = "node_id string, points array<struct<x: double, y: double>>"
EDGE = "edge_no long, from_id string, to_id string"


def drawing(spark):
    nodes = [("a", [(0.0, 0.0), (10.0, 0.0)]), ("b", [(40.0, 20.0), (90.0, 20.0)]), ("c", [(100.0, 0.0)]), ("d", [(30.0, 5.0), (20.0, 5.0)]), ("e", [])]
    links = [(1, "a", "b"), (2, "a", "a"), (3, "b", "c"), (4, "c", "c"), (5, "b", "d"), (6, "a", "e"), (7, "a", "none")]
    return spark.createDataFrame(nodes, POINTS), spark.createDataFrame(links, EDGE)


def values(row):
    return [tuple(c) for c in row["curves"]]


def test_curves(spark):
    drawn, links = drawing(spark)
    found = {r["edge_no"]: values(r) for r in edges.edge_curves(links, drawn).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    reach = min(math.hypot(30, 20) / 2, 80, 15)
    assert found[1] == [(10, 0, 10 + reach, 0, 40 - reach, 20, 40, 20)]
    assert found[2] == [(10, 0, 60, 0, 60, 50, 5, 50), (5, 50, -50, 50, -50, 0, 0, 0)]
    assert len(found[4]) == 2 and found[4][0][:2] == (100, 0)
    assert found[3][0][:2] == (90, 20) and found[3][0][6:] == (100, 0)
    assert found[5][0][:2] == (40, 20) and found[5][0][6:] == (30, 5)  # the ends that face each other


def test_arc_encloses_what_it_skips(spark):
    drawn = spark.createDataFrame([("a", [(0.0, 0.0), (10.0, 0.0)]), ("b", [(20.0, 0.0), (30.0, 0.0)]), ("m", [(12.0, -40.0), (18.0, -40.0)])], POINTS)
    links = spark.createDataFrame([(1, "a", "b")], EDGE)
    skips = spark.createDataFrame([(1, ["m"])], "edge_no long, bypassed array<string>")
    curve = values(edges.edge_curves(links, drawn, bypassed=skips).first())[0]
    apex = (curve[1] + 3 * curve[3] + 3 * curve[5] + curve[7]) / 8
    assert apex < -40
    none = edges.edge_curves(links, drawn, bypassed=skips.limit(0)).first()
    assert values(none) == values(edges.edge_curves(links, drawn).first())


def test_ribbons(spark):
    drawn, links = drawing(spark)
    paths = links.withColumn("path_ids", F.when(F.col("edge_no") == 1, F.array(F.lit("p"), F.lit("q"))))
    offsets = edges.ribbon_offsets(paths, drawn)
    found = {r["edge_no"]: [tuple(o) for o in r["offsets"]] for r in offsets.collect()}
    (x1, y1), (x2, y2) = found.pop(1)
    assert math.isclose(math.hypot(x2 - x1, y2 - y1), 3) and math.isclose((x2 - x1) * 30 + (y2 - y1) * 20, 0, abs_tol=1e-9)
    assert all(o == [] for o in found.values())
    assert edges.ribbons(edges.edge_curves(links, drawn), offsets).count() == 2


def test_nearest_edge_is_that_of_all_pairs(spark):
    drawn, links = drawing(spark)
    curves = edges.edge_curves(links, drawn, 1.0, 2.0)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(-60, 130, 7) for y in range(-20, 70, 6))]
    got = {r["point_id"]: (r["edge_no"], r["distance"]) for r in edges.nearest_edges(spark.createDataFrame(spots, "point_id long, px double, py double"), curves, 1.0, 2.0).collect()}
    lines = [(r["edge_no"], values(r)) for r in curves.collect()]
    for i, x, y in spots:
        best = None
        for no, cs in sorted(lines):
            for c in cs:
                for k in range(21):
                    t, s = k / 20, 1 - k / 20
                    at = [c[j] * s**3 + 3 * c[j + 2] * s * s * t + 3 * c[j + 4] * s * t * t + c[j + 6] * t**3 for j in (0, 1)]
                    far = math.hypot(at[0] - x, (at[1] - y) * 2)
                    if far < 10 and (best is None or far < best[1] - 1e-9):
                        best = (no, far)
        assert (i in got) == (best is not None)
        if best:
            assert math.isclose(got[i][1], best[1], abs_tol=1e-9)


def test_long_curves_meet_no_points_far_from_them(spark, capsys):
    """Each box holds all points, and hardly any sample is near one."""
    n = 300
    drawn = spark.range(n).selectExpr("concat('a', id) AS node_id", "array(named_struct('x', -1e6 - id * 40, 'y', 0.0), named_struct('x', -1e6 - id * 40 + 1, 'y', 0.0)) AS points").unionByName(
        spark.range(n).selectExpr("concat('b', id) AS node_id", "array(named_struct('x', 1e6 + id * 40, 'y', 100.0), named_struct('x', 1e6 + id * 40 + 1, 'y', 100.0)) AS points"))
    curves = edges.edge_curves(spark.range(n).selectExpr("id AS edge_no", "concat('a', id) AS from_id", "concat('b', id) AS to_id"), drawn)
    points = spark.range(n).selectExpr("id AS point_id", "id * 7.0 AS px", "50.0 AS py").unionByName(spark.createDataFrame([(n, -1e6 - 79.0, 3.0), (n + 1, 1e6, 100.0)], "point_id long, px double, py double"))
    found = edges.nearest_edges(points, curves)
    assert sorted((r["point_id"], r["edge_no"]) for r in found.where("point_id >= 300").collect()) == [(n, 2), (n + 1, 0)]
    found.explain("formatted")
    assert "min_x" not in capsys.readouterr().out  # no pairs of points and boxes


def test_cells(spark):
    schema = "min_x double, min_y double, max_x double, max_y double"
    assert tuple(edges.cell_size(spark.createDataFrame([], schema)).first()) == (50.0, 50.0)
    assert tuple(edges.cell_size(spark.createDataFrame([(0.0, 0.0, 10.0, 0.0), (0.0, 20.0, 30.0, 20.0), (0.0, 60.0, 20.0, 60.0)], schema)).first()) == (20.0, 30.0)
    assert edges.nearest_edges(spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, px double, py double"), edges.edge_curves(drawing(spark)[1].limit(0), drawing(spark)[0])).count() == 0


def test_a_grid_of_levels_holds_any_boxes_four_times_at_most(spark):
    draw = random.Random(4)
    rows = [(0, -1e6, -1e6, 1e6, 1e6), (1, 5.0, 5.0, 5.0, 5.0), (2, -3.0, 2.0, 4e5, 2.0)]
    for k in range(3, 800):
        x, y, w, h = draw.uniform(-2000, 2000), draw.uniform(-50, 50), draw.choice([0, 1, 10, 1000, 5000]) * draw.random(), draw.choice([0, 1, 40]) * draw.random()
        rows.append((k, x, y, x + w, y + h))
    boxes = spark.createDataFrame(rows, "box int, min_x double, min_y double, max_x double, max_y double")
    held = spatial.leveled(boxes, F.lit(8.0), F.lit(2.0))
    assert held.groupBy("box").count().agg(F.max("count")).first()[0] <= 4 and held.select("box").distinct().count() == len(rows)
    points = [(k, draw.uniform(-2100, 2100), draw.uniform(-60, 60)) for k in range(300)] + [(300, 5.0, 5.0), (301, -1e6, 1e6)]
    got = spatial.met(spark.createDataFrame(points, "point_id int, px double, py double"), boxes, 8.0, 2.0)
    assert sorted((r["point_id"], r["box"]) for r in got.collect()) == sorted((p, b) for p, x, y in points for b, x0, y0, x1, y1 in rows if x0 <= x <= x1 and y0 <= y <= y1)


def test_view_keeps_edges_that_cross_it(spark):
    curves = spark.createDataFrame([(1, [(0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 100.0, 0.0)]), (2, [(0.0, 50.0, 0.0, 50.0, 9.0, 60.0, 9.0, 60.0)]), (3, [(0.0, 90.0, 0.0, -90.0, 1.0, -90.0, 1.0, 90.0)])], "edge_no int, curves array<struct<x0:double,y0:double,x1:double,y1:double,x2:double,y2:double,x3:double,y3:double>>")
    assert [r["edge_no"] for r in edges.edges_in_view(curves, 40, -5, 60, 5).collect()] == [1]
    assert sorted(r["edge_no"] for r in edges.edges_in_view(curves, -5, -50, 5, 55).collect()) == [1, 2, 3]


def test_tasks_of_arcs_grow_with_the_edges(spark, monkeypatch):
    """What is sorted by edge has so many rows in a task, whatever the session's number of partitions."""
    drawn = spark.range(101).select(F.concat(F.lit("n"), "id").alias("node_id"), F.array(*[F.struct((F.col("id") * 10.0 + k).alias("x"), (F.col("id") % 3 * 1.0).alias("y")) for k in (0, 5)]).alias("points"))
    links = spark.range(100).select(F.col("id").alias("edge_no"), F.concat(F.lit("n"), "id").alias("from_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("to_id"))
    skipped = links.select("edge_no", F.array(F.concat(F.lit("n"), (F.col("edge_no") + 7) % 101)).alias("bypassed"))
    want = sorted(edges.edge_curves(links, drawn, 2.0, 1.0, skipped).collect())
    monkeypatch.setattr(storage, "ROWS", 5)
    got = edges.edge_curves(links, drawn, 2.0, 1.0, skipped)
    assert got.rdd.getNumPartitions() >= 20 and sorted(got.collect()) == want
