"""Work that grows with the tables is dealt to all tasks, and goes neither through the driver nor through sorts of all that a task has read."""

import pytest
from pyspark.sql import functions as F

from haplospan import storage
from haplospan.operators import anchor, components, convert, force
from haplospan.plans import fixtures as fx
from haplospan.sources import beds, gfa

SF = "/root/testdata/sf0.001"


def plan(capsys, df):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture
def links(spark):
    return spark.createDataFrame([(1, "a", "+", "b", "-"), (2, "b", "+", "c", "+")], "rec_no long, source string, source_strand string, target string, target_strand string")


@pytest.fixture
def steps(spark):
    return spark.createDataFrame([(0, 1, "p", "p", "s", 0, k, x, "+") for k, x in enumerate("abda")], "phase int, rec_no long, full_name string, name string, sample string, start long, step_no int, segment string, strand string")


def test_seg_is_what_its_sql_says(spark):
    kept = fx.kept(spark, SF, "seg", lambda: fx.derived_seg(spark, SF))
    fx.tables(spark, SF)
    told = spark.sql(f"WITH {fx.SEG.strip()} SELECT * FROM seg").select(kept.columns)
    assert kept.count() == told.count() > 0 and kept.exceptAll(told).isEmpty()


def test_records_are_written_once_and_in_order(spark, capsys):
    fx.tables(spark, SF)
    told = spark.sql(f"WITH {fx.STEPS.strip()} SELECT phase, rec_no, name, sample, start, step_no, segment, strand FROM steps")
    got = fx.steps(spark, SF)
    assert got.count() == told.count() and got.select(told.columns).exceptAll(told).isEmpty()
    shown = plan(capsys, fx.derived_text(spark, SF))
    assert "Window" not in shown and "Aggregate" not in shown and "Exchange" not in shown  # lines from records as they are


def test_tasks_that_collect_steps_grow_with_the_rows(spark, capsys, monkeypatch):
    """Whatever the session's number of partitions, no task collects more rows than it sorts without spilling; the shuffled rows hold no names."""
    kept = fx.records(spark, SF)
    monkeypatch.setattr(storage, "MOST", 200)
    made = fx.derived_records(spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert made.rdd.getNumPartitions() >= rows // 200 and made.exceptAll(kept).isEmpty() and made.count() == kept.count()
    assert "concat" not in plan(capsys, made).split("REPARTITION_BY_NUM", 1)[1].split("Scan", 1)[0]


def test_segment_lines_are_dealt_before_their_tags_are_read(spark):
    lines = spark.range(50).coalesce(1).selectExpr("id AS rec_no", "concat('S\t', id, '\t*\tLN:i:', id) AS line")
    found = gfa.segments(lines)
    assert found.rdd.getNumPartitions() == 4 and found.agg(F.sum("length")).first()[0] == sum(range(50))


def test_first_claims_and_edge_names(spark, capsys, links, steps):
    strands = convert.canonical_strands(links, steps)
    assert sorted(map(tuple, strands.collect())) == [("a", "+"), ("b", "-"), ("c", "+"), ("d", "+")]
    assert "REPARTITION_BY_NUM" in plan(capsys, strands)
    found = convert.edges(links, strands, steps)
    assert sorted((r["edge_no"], r["path_ids"]) for r in found.collect()) == [(1, ["p"]), (2, None)]
    assert "LeftSemi" in plan(capsys, found)  # steps along no edge are named nowhere


def test_visits_are_dealt_by_segment(spark, capsys, steps):
    walked = anchor.visits(steps, spark.createDataFrame([("a", 5), ("b", 7)], "id string, length int"))
    picked = anchor.anchored(walked, "p")
    assert sorted((r["segment"], r["so"]) for r in picked.collect()) == [("a", 0), ("b", 5), ("d", 12)]
    assert "REPARTITION_BY_NUM" in plan(capsys, picked)
    assert {r["segment"]: r["samples"] for r in anchor.carriage(walked).collect()} == {"a": ["s"], "b": ["s"], "d": ["s"]}


def test_tables_of_the_graph_are_not_sent_through_the_driver(spark, capsys, links):
    segs = spark.createDataFrame([(x, 5, "r", 10 * k, 0, "") for k, x in enumerate("abc")], "id string, length long, sn string, so long, sr long, tags_text string")
    assert "Broadcast" not in plan(capsys, beds.index_tables(segs, links)[1])
    springs = spark.createDataFrame([(k, k + 1, 20.0) for k in range(9)], "u long, v long, rest double")
    asked = []
    kept, components.checkpoint = components.checkpoint, lambda df: (asked.append(plan(capsys, df)), kept(df))[1]
    kept_force, force.checkpoint = force.checkpoint, components.checkpoint
    try:
        components.contracted(springs, 0)
        places = spark.createDataFrame([("c", k, 20480 * k, 0) for k in range(10)], "component string, pid long, x long, y long")
        assert force.relaxed(places, springs, 1).count() == 10
    finally:
        components.checkpoint, force.checkpoint = kept, kept_force
    assert len(asked) >= 5 and not any("Broadcast" in x for x in asked)
