"""GFA files: order over several files, strict records, copies of one id, and small cases of parsing."""

import pytest
from pyspark.sql import functions as F

from haplospan.functions import naming
from haplospan.operators import anchor, convert, spans
from haplospan.sources import beds, gfa


def test_files_of_any_size_keep_their_order(spark, tmp_path):
    sizes, lines = {"a.gfa": 1, "b.gfa": 4000, "c.gfa": 20, "d.gfa": 0, "e.gfa": 300}, []
    for name, n in sizes.items():
        own = [f"S\t{name[0]}{k}\t{'ACGT' * (k % 9)}" for k in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in own))
        lines += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("8k", before):  # also where a file is many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = gfa.read_lines(spark, str(tmp_path)).orderBy("rec_no").collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [r["rec_no"] for r in got] == list(range(len(lines))) and [r["line"] for r in got] == lines
    assert gfa.read_lines(spark, str(tmp_path / "d.gfa")).count() == 0


def test_first_claims_follow_the_order_of_files(spark, tmp_path):
    parts = {"1.gfa": "S\ts1\tACGT\nL\ts1\t-\ts2\t+\t0M\n", "2.gfa": "S\ts2\tAC\nL\ts2\t-\ts1\t+\t0M\n" + "S\tx\tA\n" * 500, "3.gfa": "P\tp\ts1+,s2-\t*\n"}
    for name, text in parts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "whole.txt").write_text("".join(parts[k] for k in sorted(parts)))
    made = []
    for path in ([str(tmp_path / n) for n in parts], str(tmp_path / "whole.txt")):
        g = gfa.load(spark, path)
        steps = gfa.exploded(gfa.records(g.paths, g.walks))
        made.append(sorted(map(tuple, convert.nodes(g.segments, g.links, steps).select("rec_no", "node_id", "length").collect())))
    assert made[0] == made[1] and {n for _, n, _ in made[0]} >= {"s1-", "s2+"}


@pytest.mark.parametrize("bad", ["P\tp", "W\tsm\t1\tc\t*\t*", "L\ts1\t+\ts2", "S\ts1", "E\te\ts1+"])
def test_malformed_records_end_the_job(spark, tmp_path, bad):
    (tmp_path / "a.gfa").write_text("H\tVN:Z:1.0\nS\ts1\tACGT\n" + bad + "\n")
    with pytest.raises(Exception, match=r"malformed record 2 of .*a\.gfa"):
        [t.collect() for t in gfa.load(spark, str(tmp_path / "a.gfa"))]


def test_the_last_of_equal_ids_counts(spark):
    segments = spark.createDataFrame([(0, "a", 4), (1, "b", 3), (2, "a", 2)], "rec_no long, id string, length long")
    steps = spark.createDataFrame([(0, 0, "p", "p", "p", 0, k, s, "+") for k, s in enumerate("aba")], "phase int, rec_no long, full_name string, name string, sample string, start long, step_no int, segment string, strand string")
    assert [(r["step_no"], r["at"]) for r in anchor.visits(steps, segments).orderBy("step_no").collect()] == [(0, 0), (1, 2), (2, 5)]
    assert anchor.origins(steps, segments).first()["length"] == 7


def test_small_cases(spark, tmp_path):
    rows = spark.createDataFrame([("0x10",), (" 12 ",), ("",), ("x",)], "t string").select(naming.number(F.col("t"))).collect()
    assert [r[0] for r in rows] == [16.0, 12.0, 0.0, None]
    names = spark.createDataFrame([("a\U0001f600b",), ("plain",)], "n string").select("n", naming.hue_of(F.col("n"))).collect()
    for name, hue in names:
        h = 0
        raw = name.encode("utf-16-be")
        for unit in (int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)):
            low = (h & 0xFFFFFFFF) << 5 & 0xFFFFFFFF
            h = unit + ((low - (1 << 32) if low >= 1 << 31 else low) - h)
        assert hue == abs(int(__import__("math").fmod(h, 360)))
    (tmp_path / "q.bed").write_text('"odd\t1\t2\ts1\t0\t\nplain\t3\t4\ts2\t1\t\n')
    assert [r["ref"] for r in beds.read_bed(spark, str(tmp_path / "q.bed"), beds.SEGMENTS).collect()] == ['"odd', "plain"]
    segs = gfa.segments(spark.createDataFrame([(0, "S\ts\t*\tLN:i:3\tSM:Z:K12.1, Sakai.1,")], "rec_no long, line string"))
    none = spark.createDataFrame([], "rec_no long, source string, source_strand string, target string, target_strand string")
    steps = spark.createDataFrame([], "phase int, rec_no long, step_no int, segment string, strand string")
    assert convert.nodes(segs, none, steps).first()["samples"] == ["K12.1", "Sakai.1"]


def test_no_reference_place_without_a_region(spark):
    nodes = spark.createDataFrame([("n1", 4, "K12#1#chr", 10, 0)], "node_id string, length long, sn string, so long, sr long")
    at = spark.createDataFrame([("n1", 10, 14)], "node_id string, start long, end long")
    names = spark.createDataFrame([("K12", "k12")], "sample string, assembly string")
    assert [r["kind"] for r in spans.launch_targets(nodes, at, names).collect()] == ["own"]
    got = {r["kind"]: (r["assembly"], r["ref"], r["start"], r["end"]) for r in spans.launch_targets(nodes, at, names, ("hg", "chr9")).collect()}
    assert got == {"own": ("k12", "chr", 0, 512), "reference": ("hg", "chr9", 0, 512)}
