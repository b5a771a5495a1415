"""The gfa data source against the line reader, and the SQL functions against the column functions."""

import gzip

import pytest
from pyspark.sql import functions as F

from haplospan.functions import naming, register
from haplospan.sources import gfa, gfa_source

TEXT = "H\tVN:Z:1.0\nS\ts1\tACGT\tSN:Z:a#1#c\tSO:i:0\tSR:i:0\nS\ts2\t7\t*\tdp:f:2.5\r\n\n# note\nL\ts1\t+\ts2\t-\t0M\tNM:i:0\nE\te\ts1+\ts2-\t0\t4\t0\t4\t*\nP\tp:5-9\ts1+,s2-\t*\nW\tsm\t1\tc\t*\t*\t>s1<s2\tco:Z:x:y\nS\tlong\t" + "ACGT" * 900 + "\nS\tlast\tA"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("gfa")
    (at / "b.gfa").write_bytes(TEXT.encode())
    (at / "a.gfa").write_bytes(b"".join(b"S\tt%d\t%s\n" % (k, b"A" * (k % 50)) for k in range(700)))
    (at / "c.gfa").write_bytes(b"")
    (at / "d.gfa").write_bytes(b"S\tend\tACGT\n")
    (at / "_hidden").write_bytes(b"S\tno\tA\n")
    return str(at)


@pytest.mark.parametrize("size", [7, 100, 4096, 1 << 27])
def test_the_source_gives_the_rows_of_the_reader(spark, folder, size):
    gfa_source.register(spark)
    got = spark.read.format("gfa").option("splitBytes", size).load(folder).orderBy("rec_no").collect()
    want = gfa.read_lines(spark, folder).orderBy("rec_no").collect()
    assert [r["line"] for r in got] == [r["line"] for r in want]
    assert len({r["rec_no"] for r in got}) == len(got) and all(r["record"] == r["line"][:1] for r in got)


def test_tables_from_the_source(spark, folder):
    by = gfa.read_lines(spark, folder)
    whole, loaded = gfa_source.lines(spark, folder), gfa_source.load(spark, folder)
    for table, other in zip((gfa.segments, gfa.links, gfa.paths, gfa.walks), loaded, strict=True):
        want = [r[1:] for r in table(by).orderBy("rec_no").collect()]
        for got in (table(whole), other):
            assert got.columns == table(by).columns and [r[1:] for r in got.orderBy("rec_no").collect()] == want


def test_records_are_chosen_in_the_reader(spark, folder, tmp_path):
    reader = gfa_source.Reader({"path": folder, "records": "L, P"})
    made = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["line"][:4] for r in made] == ["L\ts1", "P\tp:"]
    df = gfa_source.lines(spark, folder)
    assert df.where("record = ''").count() == 1 and df.where("record = 'L'").union(df.where("record = 'E'")).count() == 2
    with pytest.raises(Exception, match="single letters"):
        gfa_source.lines(spark, folder, records="LN").count()
    (tmp_path / "bad.gfa").write_text("S\ts1\tA\nP\tp\n")
    with pytest.raises(Exception, match="malformed record"):
        gfa_source.load(spark, str(tmp_path / "bad.gfa")).paths.collect()


def test_several_paths_packed_files_and_nothing(spark, folder, tmp_path):
    with gzip.open(tmp_path / "x.gfa.gz", "wb") as f:
        f.write(TEXT.encode())
    got = gfa_source.lines(spark, str(tmp_path / "x.gfa.gz"), f"{folder}/d.gfa", f"file://{folder}/c.gfa").orderBy("rec_no").collect()
    assert [r["line"] for r in got] == [x.rstrip("\r") for x in TEXT.split("\n")] + ["S\tend\tACGT"]
    assert gfa_source.lines(spark, f"{folder}/c.gfa").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        gfa_source.lines(spark, f"{folder}/nowhere").count()


def test_sql_functions_agree_with_column_functions(spark, folder):
    register.register(spark)
    lines = gfa.read_lines(spark, folder)
    lines.createOrReplaceTempView("gfa_lines")
    tagged = spark.sql("select rec_no, gfa_tag(line, 'SN') as sn, gfa_tag(line, 'dp') as dp from gfa_lines where line like 'S%'").orderBy("rec_no").collect()
    own = gfa.segments(lines).select("rec_no", F.col("tags")["SN"]["value"].alias("sn"), F.col("tags")["dp"]["value"].alias("dp")).orderBy("rec_no").collect()
    assert tagged == own and any(r["sn"] for r in own) and any(r["dp"] for r in own)
    assert spark.sql("select gfa_tag(line, 'co') from gfa_lines where line like 'W%'").first()[0] == "x:y"
    assert spark.sql("select gfa_path(split(line, '\t')[2]) from gfa_lines where line like 'P%'").first()[0] == gfa.paths(lines).first()["steps"]
    assert spark.sql("select gfa_walk(split(line, '\t')[6]) from gfa_lines where line like 'W%'").first()[0] == gfa.walks(lines).first()["steps"]
    numbers = spark.createDataFrame([(n,) for n in (0, 999, 1000, 1250, 1449, 1450, 1750, 999999, 1250000, 123456789, 2000000)], "bp long")
    numbers.createOrReplaceTempView("numbers")
    assert spark.sql("select format_bp(bp), format_span_bp(bp) from numbers").collect() == numbers.select(naming.format_bp(F.col("bp")), naming.format_span_bp(F.col("bp"))).collect()
    names = spark.createDataFrame([("a#1#c:5-9",), ("a##c",), ("a",), ("a#x#c:1-",)], "n string")
    names.createOrReplaceTempView("names")
    assert spark.sql("select pansn_haplotype(n), path_origin_name(n) from names").collect() == names.select(naming.pansn_haplotype(F.col("n")), naming.origin_name(F.col("n"))).collect()
