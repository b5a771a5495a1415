"""Operators that work in rounds: components, chained placement, sums along an order."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from haplospan import storage
from haplospan.operators import components, layout


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        if a != b:
            root[b] = a
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    pairs = [(f"n{draw.randrange(300)}", f"n{draw.randrange(300)}") for _ in range(180)] + [("hub", f"leaf{k}") for k in range(60)] + [("self", "self")]
    got = components.components(spark.createDataFrame(pairs, "u string, v string")).collect()
    want = {k: v for k, v in plain_components(pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert dict(map(tuple, got)) == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([("a", "a")], "u string, v string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(3000).select(F.format_string("n%05d", "id").alias("u"), F.format_string("n%05d", F.col("id") + 1).alias("v"))
    got = components.components(links)
    assert got.select("root").distinct().collect() == [("n00000",)] and got.count() == 3001


def plain_chained(placed, pairs, least):
    """Breadth first from all placed nodes at once: by links, then by the key of the placed node."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    best = {n: (0, key, x1) for n, _, x1, key in placed}
    level = dict(best)
    while level:
        nxt = {}
        for n, (d, key, x1) in level.items():
            for o in near.get(n, ()):
                if o not in best:
                    nxt[o] = min(nxt.get(o, (d + 1, key, x1)), (d + 1, key, x1))
        best |= nxt
        level = nxt
    out = {n: (x0, x1) for n, x0, x1, _ in placed}
    return out | {n: (x1 + (d - 1) * least, x1 + d * least) for n, (d, _, x1) in best.items() if n not in out}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chained_placement_against_a_search(spark, seed):
    draw = random.Random(seed)
    n = 400
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(n) if draw.random() < 0.9]
    pairs += [(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(25)] + [("n5", "n5"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")] + pairs[:5]
    placed = [(f"n{k}", float(k), float(k + 3), [draw.randrange(2), k]) for k in draw.sample(range(n), 12)]
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_no long, from_id string, to_id string")
    frame = spark.createDataFrame(placed, "node_id string, x0 double, x1 double, key array<long>")
    got = layout.chained(frame, edges, 2.5).collect()
    assert {r["node_id"]: (r["x0"], r["x1"]) for r in got} == plain_chained(placed, pairs, 2.5)
    assert len({r["node_id"] for r in got}) == len(got)


def test_a_chain_of_100000_in_few_rounds(spark, monkeypatch):
    n, calls = 100_000, []
    keep = layout.checkpoint
    monkeypatch.setattr(layout, "checkpoint", lambda df: calls.append(1) or keep(df))
    edges = spark.range(n).select(F.col("id").alias("edge_no"), F.concat(F.lit("n"), "id").alias("from_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("to_id"))
    placed = spark.createDataFrame([("n0", 0.0, 1.0, [0, 0])], "node_id string, x0 double, x1 double, key array<long>")
    got = layout.chained(placed, edges, 2.0)
    number = F.substring("node_id", 2, 9).cast("long")
    assert got.where(F.col("x0") == F.when(number == 0, 0.0).otherwise(1 + 2.0 * (number - 1))).count() == n + 1
    assert len(calls) < 30


def test_running_sums(spark):
    rows = spark.range(2000).select(F.col("id"), (F.xxhash64("id") % 7).alias("turn"), (F.col("id") % 11).alias("size"))
    got = storage.running(rows, "turn", "id", of="size").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r["turn"], r["id"])):
        assert r["before"] == total
        total += r["size"]
    assert len(got) == 2000 and storage.running(rows.limit(0), "turn", "id", of="size").count() == 0
