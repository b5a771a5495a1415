"""Linear seeds, normals of lines, ends of curves, and the ancestry table, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haplospan.operators import curves, force, seeds
from haplospan.sources import ancestry


def plain_seeds(nodes, edges, edge_length):
    numeric = all(n.lstrip("-").isdigit() for _, n, _ in nodes)
    order = sorted(nodes, key=lambda r: (int(r[1]) if numeric else r[1], r[0]))
    up = {}
    for _, a, b in sorted(edges):
        if a not in up.setdefault(b, []):
            up[b].append(a)
    known = {n for n, _, _ in nodes}
    at, used, last = {}, set(), 0.0
    for n, _, drawn in order:
        for j, u in enumerate(x for x in up.get(n, ()) if x in known):
            if u in at:
                last = at[u][1] if j == 0 else max(last, at[u][1])
        x, y = last + edge_length, 0.0
        while (int(x * 100), int(y * 100)) in used:
            y += edge_length
        used.add((int(x * 100), int(y * 100)))
        at[n] = (x, x + drawn, y)
        last = x + drawn
    return at


@pytest.mark.parametrize(("kind", "size"), [("numeric", 1000), ("numeric", 40), ("text", 40)])
def test_seeds_against_a_loop(spark, kind, size):
    draw = random.Random(7)
    names = [str(k) if kind == "numeric" else f"n{k}" for k in range(200)]
    nodes = [(f"{n}+", n, float(draw.choice([5, 8, 40]))) for n in names]
    edges = [(k, f"{draw.choice(names)}+", f"{draw.choice(names)}+") for k in range(260)] + [(900, "0+" if kind == "numeric" else "n0+", "none+")]
    got = seeds.linear_seeds(spark.createDataFrame(nodes, "node_id string, name string, drawn double"), spark.createDataFrame(edges, "edge_no long, from_id string, to_id string"), 5.0, size).collect()
    assert {r["node_id"]: (r["x0"], r["x1"], r["y"]) for r in got} == plain_seeds(nodes, edges, 5.0)


def test_a_linear_layout_keeps_its_direction(spark):
    nodes = spark.createDataFrame([(f"{k}", f"{k}", 100) for k in range(30)], "node_id string, name string, length int")
    edges = spark.createDataFrame([(k, f"{k}", f"{k + 1}") for k in range(29)], "edge_no long, from_id string, to_id string")
    rows = sorted(force.force_layout(nodes, edges, quality=0, linear=True).collect(), key=lambda r: int(r["node_id"]))
    middle = [(r["x0"] + r["x1"]) / 2 for r in rows]
    assert middle == sorted(middle) or middle == sorted(middle, reverse=True)


def plain_normals(points, ratio):
    sides = []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy = bx - ax, (by - ay) * ratio
        size = math.hypot(dx, dy)
        sides.append((-dy / size, dx / size) if size else None)
    out = []
    for k in range(len(points)):
        near = [s for s in (sides[k - 1] if k else None, sides[k] if k < len(sides) else None) if s]
        if len(near) == 2:
            (ax, ay), (bx, by) = near
            mx, my = (ax + bx) / 2, (ay + by) / 2
            dot = ax * mx + ay * my
            out.append((mx / dot, my / dot) if dot > 0.1 else (mx, my))
        else:
            out.append(near[0] if near else (0.0, 0.0))
    return out


def test_normals_of_lines(spark):
    draw = random.Random(3)
    lines = [[(0.0, 0.0)], [(1.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (5.0, 0.0), (0.0, 0.001)], [(0.0, 0.0), (0.0, 0.0), (3.0, 4.0), (3.0, 4.0)]]
    lines += [[(draw.uniform(0, 9), draw.uniform(0, 9)) for _ in range(draw.randrange(2, 7))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, points array<struct<x:double,y:double>>")
    for k, n, s in rows.select("k", curves.normals(F.col("points"), 2.0), curves.shifted(F.col("points"), 1.5, 2.0)).collect():
        want = plain_normals(lines[k], 2.0)
        assert [tuple(x) for x in n] == [pytest.approx(w) for w in want]
        assert [tuple(x) for x in s] == [pytest.approx((x + a * 1.5, y + b * 1.5 / 2.0)) for (x, y), (a, b) in zip(lines[k], want, strict=True)]


def test_ends_of_curves(spark):
    kind = "struct<" + ",".join(f"{n}:double" for n in curves.NAMES) + ">"
    rows = spark.createDataFrame([((0.0, 0.0, 1.0, 0.0, 2.0, 1.0, 3.0, 3.0),), ((0.0, 0.0, 1.0, 0.0, 3.0, 3.0, 3.0, 3.0),)], f"c {kind}")
    assert [r[0] for r in rows.select(curves.end_angle(F.col("c"), 2.0)).collect()] == [pytest.approx(math.atan2(4, 1)), pytest.approx(math.atan2(6, 3))]


def plain_spread(order, featured, count):
    chosen = [s for s in dict.fromkeys(order) if s in featured]
    rest = [s for s in dict.fromkeys(order) if s not in featured]
    need, last, out = count - len(chosen), 0, list(chosen)
    taken = 0
    for number, s in enumerate(rest, 1):
        if need > 0 and int(number / (len(rest) / need)) != last and taken < need:
            out.append(s)
            taken += 1
            last = int(number / (len(rest) / need))
    return sorted(out)


def test_ancestry_table(spark, tmp_path):
    samples = [f"HG{k:03d}" for k in range(23)]
    text = "sample_id,haplotype,assembly,location\r\n" + "".join(f"{s},{h},asm,s3://b/{s}.{h},more\r\n" for s in samples for h in (1, 2)) + "short,1\r\n\r\n"
    (tmp_path / "index.csv").write_text(text, newline="")
    index = ancestry.read_index(spark, str(tmp_path / "index.csv"))
    assert index.count() == 47 and index.where("sample = 'short'").first()["location"] is None
    for count in (2, 3, 7, 10, 60):
        got = sorted(r["sample"] for r in ancestry.spread_samples(index, ["HG003", "HG020", "gone"], count).collect())
        assert got == plain_spread([*samples, "short"], {"HG003", "HG020"}, count)
    rows = spark.createDataFrame([("s3://b/HG003.2,more", c, s, s + 5, "n", "0", "9,9,9") for c in ("chr1", "chr2") for s in (70, 10)], "location string, chrom string, start long, end long, name string, score string, itemRgb string")
    table = ancestry.projected(index, ancestry.spread_samples(index, ["HG003"], 1), rows, "chr1")
    ancestry.write_bed(table, str(tmp_path / "out"))
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["#" + "\t".join(ancestry.COLUMNS), "chr1\t10\t15\tn\t0\t.\t10\t15\t9,9,9\tHG003.h2", "chr1\t70\t75\tn\t0\t.\t70\t75\t9,9,9\tHG003.h2"]
