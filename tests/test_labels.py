"""Labels on small drawings, against the rules applied one candidate after the other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haplospan.operators import labels

POINTS = "node_id string, points array<struct<x: double, y: double>>"
NODES = "node_id string, rec_no long, length long"
CURVES = "edge_no long, curves array<struct<x0: double, y0: double, x1: double, y1: double, x2: double, y2: double, x3: double, y3: double>>"
VIEW = labels.View(2.0, 1.0, -30.0, 10.0, 600.0, 240.0)


def half(text):
    return (len(text) * 5.7 + 9) / 2


def words(bp):
    return f"{bp} bp" if bp < 1000 else f"{round(bp / 1000, 1):g} kb"


def box(x, y, text):
    return (x - half(text), x + half(text), y - 8, y + 8)


def clear(a, b):
    return not (a[0] < b[1] and b[0] < a[1] and a[2] < b[3] and b[2] < a[3])


def greedy(candidates, taken):
    kept = []
    for key, x, y, text in candidates:
        b = box(x, y, text)
        if b[1] > 0 and b[0] < VIEW.width and b[3] > 0 and b[2] < VIEW.height and all(clear(b, o) for o in taken):
            taken = [*taken, b]
            kept.append(key)
    return sorted(kept)


def drawing(seed, count):
    rng = random.Random(seed)
    nodes, drawn = [], []
    for k in range(count):
        x, y, length = rng.uniform(-50, 350), rng.uniform(-30, 250), rng.choice([1, 17, 94, 1500, 20_000])
        nodes.append((f"n{k}", k, length))
        drawn.append((f"n{k}", [(x, y), (x + rng.uniform(0, 40), y), (x + 50, y + rng.uniform(0, 9))][: rng.choice([1, 2, 3])]))
    return nodes, drawn


@pytest.mark.parametrize("seed,count", [(1, 150), (2, 400)])
def test_nodes_and_rows(spark, seed, count):
    nodes, drawn = drawing(seed, count)
    runs = [("r1", ["n0", "n1", "none"], 5200), ("r2", ["n2"], 40), ("r3", [], 7), ("r4", ["none"], 9)]
    rows = spark.createDataFrame([("Reference (rank 0)", 0), ("Rank 1", 100)], "label string, y long")
    taken = [tuple(r)[1:] for r in labels.row_label_boxes(rows, VIEW).collect()]
    assert taken[0] == (6.0, 6 + 18 * 6.2 + 11, 0.5, 19.5)
    at, barred, candidates = dict(drawn), set(), []
    for run, of, bp in sorted(runs, key=lambda r: -r[2]):
        spots = [p for n in of for p in at.get(n, [])]
        if not spots:
            continue
        a, b = max(min(p[0] for p in spots) * 2 - 30, 0), min(max(p[0] for p in spots) * 2 - 30, 600)
        c, d = max(min(p[1] for p in spots) + 10, 0), min(max(p[1] for p in spots) + 10, 240)
        text = words(bp) + " deletion"
        if b >= a and d >= c and max(b - a, d - c) >= half(text):
            barred |= set(of)
            candidates.append((f"alleledel:{run}", min(max((a + b) / 2, half(text)), 600 - half(text)), min(max((c + d) / 2, 8), 232), text))
    for name, _, length in sorted(nodes, key=lambda n: (-n[2], n[1])):
        p = at[name]
        if name not in barred and sum(math.hypot((q[0] - o[0]) * 2, q[1] - o[1]) for o, q in zip(p, p[1:])) >= half(words(length)):
            m = p[len(p) // 2]
            candidates.append((f"node:{name}", m[0] * 2 - 30, m[1] + 10, words(length)))
    frame, shapes = spark.createDataFrame(nodes, NODES), spark.createDataFrame(drawn, POINTS)
    none = spark.createDataFrame([], CURVES)
    got = labels.graph_labels(frame.union(frame.limit(5)), shapes, VIEW, none.select("edge_no", F.lit(1).alias("bp")), none, spark.createDataFrame(runs, "run string, nodes array<string>, bp long"), labels.row_label_boxes(rows, VIEW))
    assert sorted(r["key"] for r in got.collect()) == greedy(candidates, taken)


def test_deletions(spark):
    wide, small, dot = [(0.0, 100.0, 50.0, 40.0, 150.0, 40.0, 200.0, 100.0)], [(220.0, 100.0, 225.0, 80.0, 235.0, 80.0, 240.0, 100.0)], [(10.0, 10.0, 11.0, 11.0, 12.0, 11.0, 13.0, 10.0)]
    curves = spark.createDataFrame([(1, wide), (2, small), (3, dot), (4, []), (5, small)], CURVES)
    deletions = spark.createDataFrame([(1, 94_200), (2, 55), (3, 7), (4, 9), (6, 1)], "edge_no long, bp long")
    found = {r["key"]: r for r in labels.deletion_candidates(deletions, curves, VIEW).collect()}
    assert sorted(found) == ["del:1", "del:2"]
    assert (found["del:1"]["text"], found["del:1"]["x"], found["del:1"]["y"], found["del:1"]["arc_x"]) == ("94.2 kb deletion", 170.0, 65.0, None)
    beside = found["del:2"]  # 40 pixels of arc, 89 of text: above it, with a leader to the lower side of the box
    assert (beside["x"], beside["arc_x"], beside["arc_y"], beside["label_x"]) == (430.0, 430.0, 95.0, 430.0)
    assert math.isclose(beside["y"], 95 - 8 - 8) and math.isclose(beside["label_y"], 95 - 8)
    assert labels.graph_labels(spark.createDataFrame([], NODES), spark.createDataFrame([], POINTS), VIEW, deletions, curves).count() == 2


def test_slid_into_the_screen(spark):
    curves = spark.createDataFrame([(1, [(0.0, -12.0, 5.0, -25.0, 10.0, -25.0, 20.0, -12.0)])], CURVES)
    row = labels.deletion_candidates(spark.createDataFrame([(1, 100)], "edge_no long, bp long"), curves, VIEW).first()
    assert row["y"] == 8 and row["x"] >= half("100 bp deletion")
    assert row["left"] - 1e-9 <= row["label_x"] <= row["right"] + 1e-9 and row["top"] - 1e-9 <= row["label_y"] <= row["bottom"] + 1e-9
