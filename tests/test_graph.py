"""Small graphs with known answers, and the cases at the edges."""

import pytest

from haplospan.functions import naming, regions, register
from haplospan.operators import alleles, cut, curves, force, layout, spans
from haplospan.sources import beds, gfa
from haplospan.streaming import ingest
from pyspark.sql import functions as F

NODES = "rec_no long, node_id string, name string, length long, depth double, sn string, so long, sr long"
EDGES = "edge_no long, from_id string, to_id string"


def nodes_of(spark, rows):
    return spark.createDataFrame([(k, n, n, length, 1.0, sn, so, sr) for k, (n, length, sn, so, sr) in enumerate(rows)], NODES)


def edges_of(spark, rows):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], EDGES)


@pytest.fixture
def worked(spark):
    """Backbone v1-v4 on chr1 and an allele of two segments between v2 and v3."""
    n = nodes_of(spark, [("v1", 10, "chr1", 0, 0), ("v2", 5, "chr1", 10, 0), ("v3", 8, "chr1", 20, 0), ("v4", 4, "chr1", 28, 0), ("v5", 3, "foo#1#x", 100, 1), ("v6", 4, "foo#1#x", 103, 1)])
    e = edges_of(spark, [("v1", "v2"), ("v2", "v3"), ("v3", "v4"), ("v2", "v5"), ("v5", "v6"), ("v6", "v3")])
    return n, e


def test_alleles(worked):
    found, members, unanchored = alleles.project(*worked)
    (row,) = found.collect()
    assert (row["start"], row["end"], row["alt_length"], row["delta"], row["kind"], row["sample"], row["haplotype"]) == (15, 20, 7, 2, "insertion", "foo", 1)
    assert row["segments"] == ["v5", "v6"] and row["offsets"] == [0, 3] and row["path_length"] == 7
    assert unanchored.first()[0] == 0


def test_parallel_branches_share_their_range(spark):
    n = nodes_of(spark, [("a", 10, "r", 0, 0), ("b", 10, "r", 50, 0), ("x", 2, "s#1#c", 0, 1), ("y", 9, "s#1#c", 2, 1), ("z", 3, "s#1#c", 11, 1), ("t", 1, "s#1#c", 14, 1)])
    e = edges_of(spark, [("a", "x"), ("x", "y"), ("x", "z"), ("y", "t"), ("z", "t"), ("t", "b")])
    (row,) = alleles.project(n, e)[0].collect()
    offsets = dict(zip(row["segments"], row["offsets"], strict=True))
    assert offsets == {"x": 0, "y": 2, "z": 2, "t": 11} and row["path_length"] == 12 and row["alt_length"] == 15


def test_deletions(worked, spark):
    n, e = worked
    assert [tuple(r) for r in spans.deletion_edges(n, e).collect()] == [(1, "v2", "v3", "chr1", 15, 20, 5)]
    skip = edges_of(spark, [("v4", "v1")])
    d = spans.deletion_edges(n, skip)
    assert d.first()["bp"] == 18
    assert spans.bypassed(d, n).first()["bypassed"] == ["v2", "v3"]


def test_reference_spans(worked):
    found = {r["node_id"]: (r["start"], r["end"]) for r in spans.reference_spans(*worked).collect()}
    assert found["v5"] == (15, 20) and found["v6"] == (15, 20) and found["v2"] == (10, 15)


def test_layouts(worked):
    n, e = worked
    rows = {r["node_id"]: (r["x0"], r["x1"], r["y"]) for r in layout.anchored_layout(n, e).collect()}
    assert rows["v1"] == (0, 10, 0) and rows["v5"][0] == 15 and rows["v6"][1] == pytest.approx(20) and rows["v6"][2] == 20
    assert layout.available_modes(n) == ["anchored", "sample-rows", "force"]
    a, b = (sorted(map(tuple, force.force_layout(n, e).collect())) for _ in range(2))
    assert a == b and len(a) == 6


def test_contributors_keep_the_widest_run(spark):
    n = nodes_of(spark, [("s1", 10000, "K12#1#chr", 0, 0), ("s2", 400, "Sakai#1#chr", 50000, 1), ("s3", 400, "Sakai#1#chr", 50600, 1), ("s4", 100, "Sakai#1#chr", 3000000, 1)])
    row = spans.contributors(n, 10000).where("sample = 'Sakai'").first()
    assert tuple(row) == ("Sakai", "chr", 50000, 51000, 1, 3)


def test_parser(spark, tmp_path):
    text = "H\tVN:Z:1.0\nS\ts1\tACGT\tSN:Z:c\tSO:i:3\tSR:i:0\nS\ts2\t*\tLN:i:7\tSN:i:5\tSO:i:1\tSR:i:0\r\nSx\ts3\t9\tAC\nL\ts1\t+\ts2\t-\t0M\nE\te1\ts1+\ts2-\t0\t1\t2\t3\t5M\nP\tp:5-9\ts1+,s2-\t*\nW\tsm\t1\tc\t*\t*\t>s1<s2\n"
    path = tmp_path / "a.gfa"
    path.write_bytes(text.encode())
    lines = gfa.read_lines(spark, str(path))
    s = {r["id"]: r for r in gfa.segments(lines).collect()}
    assert (s["s1"]["length"], s["s1"]["sn"], s["s1"]["so"]) == (4, "c", 3)
    assert (s["s2"]["length"], s["s2"]["sn"]) == (7, None) and s["s3"]["length"] == 9
    assert [(r["source"], r["target"], r["target_strand"], r["cigar"]) for r in gfa.links(lines).orderBy("rec_no").collect()] == [("s1", "s2", "-", "0M"), ("s1", "s2", "-", "5M")]
    steps = gfa.exploded(gfa.records(gfa.paths(lines), gfa.walks(lines))).orderBy("phase", "step_no").collect()
    assert [(r["name"], r["start"], r["segment"], r["strand"]) for r in steps] == [("p", 5, "s1", "+"), ("p", 5, "s2", "-"), ("sm#1#c", 0, "s1", "+"), ("sm#1#c", 0, "s2", "-")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gfa").write_text("S\ts1\tACGT\tSN:Z:c\tSO:i:0\tSR:i:0\nS\ts2\tAC\tSN:Z:c\tSO:i:4\tSR:i:0\n")
    run = ingest.bp_by_sequence(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("bp").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("bp").collect()] == [("c", 2, 6)]


def test_guards(spark):
    with pytest.raises(ValueError):
        cut.check_region(0, 5_000_001)
    cut.check_region(0, 5_000_000)
    with pytest.raises(ValueError):
        cut.check_nodes(spark.range(5), 4)


def test_index_round_trip(spark, tmp_path):
    from haplospan.plans import fixtures as fx

    segs, links = fx.index(spark, "/root/testdata/sf0.001")
    beds.write_index(segs, str(tmp_path / "segs"))
    assert spark.read.parquet(str(tmp_path / "segs")).count() == segs.count()
    assert links.count() == 2 * fx.links(spark, "/root/testdata/sf0.001").count()


def test_names(spark):
    row = spark.range(1).select(
        naming.pansn_contig(F.lit("a#1#b#c")).alias("a"), naming.pansn_contig(F.lit("a#b")).alias("b"), naming.pansn_haplotype(F.lit("a##c")).alias("c"), naming.pansn_haplotype(F.lit("a")).alias("d"),
        naming.format_bp(F.lit(1450)).alias("e"), naming.format_bp(F.lit(1250)).alias("f"), naming.format_bp(F.lit(2000000)).alias("g"), naming.locstring(F.lit("chr"), F.lit(0), F.lit(100)).alias("h"),
        naming.hue_of(F.lit("s1")).alias("i"), naming.pack_abgr(F.lit(1), F.lit(2), F.lit(3), F.lit(255)).alias("j"),
    ).first()
    assert tuple(row) == ("b#c", "b", 0, None, "1.4 kb", "1.3 kb", "2 Mb", "chr:1-100", 14, 255 * 2**24 + 3 * 2**16 + 2 * 2**8 + 1)
    register.register(spark)
    assert spark.sql("select pansn_sample('a#1#b'), edge_key('b', 'a'), path_origin_start('x:5-9')").first()[:] == ("a", "a--b", 5)


def test_regions(spark):
    blocks = spark.createDataFrame([(0, "a", -3.5, 10.5), (1, "b", 0.0, 14.0)], "block_no int, ref string, start double, end double")
    assert tuple(regions.region_of_blocks(blocks).first()) == ("a", 0, 10)


def test_curves(spark):
    c = curves.curve(*[F.lit(float(v)) for v in (0, 0, 1, 0, 2, 0, 3, 0)])
    row = spark.range(1).select(curves.midpoint(c).alias("m"), curves.part(c, F.lit(0.0), F.lit(0.5)).alias("p"), curves.distance(c, F.lit(1.5), F.lit(2.0)).alias("d"), F.size(curves.dashes(c, 4)).alias("n")).first()
    assert row["m"]["x"] == 1.5 and row["p"]["x3"] == 1.5 and row["d"] == 2.0 and row["n"] == 3


def test_empty_tables(spark):
    n, e = nodes_of(spark, []), edges_of(spark, [])
    assert alleles.project(n, e)[0].count() == 0 and spans.reference_spans(n, e).count() == 0 and spans.contributors(n).count() == 0


def test_colours_and_layouts_have_their_limits(spark, worked):
    from haplospan.operators import colors

    records = spark.createDataFrame([(0, k, f"S{k}#1#c") for k in range(17)], "phase int, rec_no long, full_name string")
    assert colors.path_key(records).count() == 0 and colors.path_key(records.where("rec_no < 16")).count() == 16 and colors.path_key(records.limit(0)).count() == 0
    n, e = worked
    with pytest.raises(ValueError, match="more than 5 nodes"):
        layout.lay_out(n, e, "anchored", limit=5)
    assert layout.lay_out(n, e, "anchored", limit=6).count() == layout.lay_out(n, e, "auto", limit=None).count() == 6


def test_rows_reach_as_far_as_in_the_layout(spark, monkeypatch):
    """Bounds of rows are those of the layout, and without one where nodes beside the backbone decide."""
    def graph(ranks, pairs):
        nodes = [(k, x, x, 10, 1.0, "R#0#c" if r == 0 else "S#1#c", k * 10, r) for k, (x, r) in enumerate(ranks.items())]
        return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], EDGES)

    beside = graph({"a": 0, "b": 0, "x": 1, "y": 3, "z": 2, "n": None}, [("a", "b"), ("a", "x"), ("x", "b"), ("y", "a"), ("x", "z"), ("n", "b")])
    beyond = graph({"a": 0, "b": 0, "x": 1, "z": 2, "far": 5}, [("a", "b"), ("a", "x"), ("x", "z"), ("far", "far")])
    for g, height in ((beside, 60.0), (beyond, 40.0)):
        assert layout.row_bounds(*g).collect() == layout.layout_bounds(layout.anchored_layout(*g)).select("min_y", "h").collect() == [(0.0, height)]
    monkeypatch.setattr(layout, "positions", None)
    assert layout.row_bounds(*beside).collect() == [(0.0, 60.0)]
