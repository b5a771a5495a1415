"""A graph derived from the parquet tables, by SQL that Spark and DuckDB both run.

seg, lnk, path_rec (steps of P records), walk_rec (steps of W records), bubble: see the rules in FIXTURES.md; rec_no of lnk is
a number in the order of (source key, target key, kind) that each row has by itself, rather than its row number.

Each derived table is written once for a session and folder, as Parquet by place, or as text of GFA lines and BED rows, and read from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import passing, running, tasks

SEG = """
seg AS (
    SELECT pk, id, len, contig, rank,
           CASE WHEN rank = 0 THEN concat('REF#0#', contig) ELSE concat('S', CAST(pk % 7 AS VARCHAR(20)), '#', CAST(pk % 2 + 1 AS VARCHAR(20)), '#', contig) END AS sn,
           CAST(CASE WHEN rank = 0 THEN COALESCE(SUM(CASE WHEN rank = 0 THEN len ELSE 0 END) OVER (PARTITION BY contig ORDER BY pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE pk * 100 END AS BIGINT) AS so,
           CAST(SUM(CASE WHEN rank = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bno
    FROM (
        SELECT CAST(p_partkey AS BIGINT) AS pk, concat('s', CAST(p_partkey AS VARCHAR(20))) AS id, CAST(p_size AS BIGINT) AS len,
               concat('chr', CAST(p_partkey % 4 AS VARCHAR(20))) AS contig,
               CAST(CASE WHEN p_size % 3 = 0 THEN 1 + p_partkey % 3 ELSE 0 END AS BIGINT) AS rank
        FROM part
    ) base
)"""

#: The innermost rows of SEG, before sums along contigs.
BASE = SEG[SEG.rindex("FROM (") + 6 : SEG.rindex(") base")]

LNK = """
bb AS (SELECT * FROM seg WHERE rank = 0),
off AS (
    SELECT s.*, ROW_NUMBER() OVER (PARTITION BY contig, bno ORDER BY pk) AS place, COUNT(*) OVER (PARTITION BY contig, bno) AS members
    FROM seg s WHERE rank > 0
),
pairs AS (
    SELECT a.pk AS spk, b.pk AS tpk, 0 AS kind FROM bb a JOIN bb b ON a.contig = b.contig AND b.bno = a.bno + 1
    UNION ALL SELECT a.pk, b.pk, 1 FROM bb a JOIN bb b ON a.contig = b.contig AND b.bno = a.bno + 3 WHERE a.bno % 11 = 0
    UNION ALL SELECT a.pk, b.pk, 2 FROM off a JOIN off b ON a.contig = b.contig AND a.bno = b.bno AND b.place = a.place + 1
    UNION ALL SELECT a.pk, b.pk, 3 FROM bb a JOIN off b ON a.contig = b.contig AND a.bno = b.bno AND b.place = 1
    UNION ALL SELECT a.pk, b.pk, 4 FROM off a JOIN bb b ON a.contig = b.contig AND b.bno = a.bno + 1 + a.bno % 3 WHERE a.place = a.members
),
lnk AS (
    SELECT CAST(spk * 1073741824 + tpk * 8 + kind AS BIGINT) AS rec_no, kind, spk, tpk,
           concat('s', CAST(spk AS VARCHAR(20))) AS source, CASE WHEN (spk + tpk) % 13 = 0 THEN '-' ELSE '+' END AS source_strand,
           concat('s', CAST(tpk AS VARCHAR(20))) AS target, CASE WHEN (spk + tpk) % 17 = 0 THEN '-' ELSE '+' END AS target_strand
    FROM pairs
)"""

STEPS = """
psteps AS (
    SELECT CAST(l_orderkey AS BIGINT) AS rec_no,
           CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS step_no,
           concat('s', CAST(l_partkey AS VARCHAR(20))) AS segment, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand
    FROM lineitem
),
pname AS (
    SELECT CAST(o_orderkey AS BIGINT) AS rec_no, concat('C', CAST(o_custkey % 50 AS VARCHAR(20))) AS sample,
           concat('C', CAST(o_custkey % 50 AS VARCHAR(20)), '#', CAST(o_orderkey % 2 + 1 AS VARCHAR(20)), '#chr') AS name,
           CAST(o_orderkey * 1000 AS BIGINT) AS start
    FROM orders
),
wsteps AS (
    SELECT CAST(user_id AS BIGINT) AS rec_no, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step_no,
           concat('s', CAST(event_id % (SELECT COUNT(*) FROM part) AS VARCHAR(20))) AS segment, CASE WHEN event_type = 'error' THEN '-' ELSE '+' END AS strand
    FROM events
),
steps AS (
    SELECT CAST(0 AS INTEGER) AS phase, p.rec_no, n.name, n.sample, n.start, p.step_no, p.segment, p.strand FROM psteps p JOIN pname n ON p.rec_no = n.rec_no
    UNION ALL
    SELECT CAST(1 AS INTEGER), rec_no, concat('U', CAST(rec_no AS VARCHAR(20)), '#1#chr'), concat('U', CAST(rec_no AS VARCHAR(20))), CAST(0 AS BIGINT), step_no, segment, strand FROM wsteps
)"""

GRAPH = SEG + "," + LNK


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in ("part", "lineitem", "orders", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def rows(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    """A query over CTEs of which the first is SEG; that is read as it is kept, not derived again for each time that it is named."""
    kept(spark, sf_dir, "seg", lambda: derived_seg(spark, sf_dir)).createOrReplaceTempView("seg")
    more = ctes.removeprefix(SEG).lstrip(",").strip()
    return spark.sql(f"WITH {more} {select}" if more else select)


FILES: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], text: bool = False) -> str:
    """The folder of a derived table in the shared folder, written at its first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in FILES:
        path = passing(spark, f"graph-{name}")
        built = build()
        built.write.text(path) if text else built.write.parquet(path)
        FILES[key] = path
    return FILES[key]


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(stored(spark, sf_dir, name, build))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_segments(spark, sf_dir)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "links", lambda: derived_links(spark, sf_dir))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = records(spark, sf_dir).select("phase", "rec_no", "name", "sample", "start", F.posexplode("steps").alias("step_no", "step"))
    return each.select("phase", "rec_no", F.col("name").alias("full_name"), "name", "sample", "start", "step_no", "step.segment", "step.strand")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P and W records, a row each with its steps in order."""
    return kept(spark, sf_dir, "records", lambda: derived_records(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments under their own names as node ids."""
    return segments(spark, sf_dir).select("rec_no", F.col("id").alias("node_id"), F.col("id").alias("name"), "length", F.lit(1.0).alias("depth"), "sn", "so", "sr")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select(F.col("rec_no").alias("edge_no"), F.col("source").alias("from_id"), F.col("target").alias("to_id"))


def derived_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, SEG, "SELECT pk AS rec_no, id, len AS length, sn, so, rank AS sr FROM seg")


def derived_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, GRAPH, "SELECT rec_no, source, source_strand, target, target_strand FROM lnk")


def derived_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG, its sums along each contig by ranges of rows rather than a task for each contig."""
    tables(spark, sf_dir)
    base = spark.sql(BASE).withColumns({"_len": F.when(F.col("rank") == 0, F.col("len")).otherwise(0), "_one": (F.col("rank") == 0).cast("long")})
    placed = running(running(base, "contig", "pk", of="_len", name="_along"), "contig", "pk", of="_one", name="_count")
    first = placed.groupBy("contig").agg(F.min("_along").alias("_along0"), F.min("_count").alias("_count0"))  # a row for each of four contigs
    backbone = F.col("rank") == 0
    name = F.when(backbone, F.concat(F.lit("REF#0#"), "contig")).otherwise(F.concat(F.lit("S"), (F.col("pk") % 7).cast("string"), F.lit("#"), (F.col("pk") % 2 + 1).cast("string"), F.lit("#"), "contig"))
    so, bno = F.when(backbone, F.col("_along") - F.col("_along0")).otherwise(F.col("pk") * 100), F.col("_count") - F.col("_count0") + F.col("_one")
    return placed.join(F.broadcast(first), "contig").select("pk", "id", "len", "contig", "rank", name.alias("sn"), so.cast("long").alias("so"), bno.cast("long").alias("bno"))


def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of STEPS.  Rows are dealt by record before their steps are collected, into so many tasks that none spills what it sorts; they carry
    numbers, of which names and strands are made afterwards."""
    tables(spark, sf_dir)

    def collected(table: str, read: str, by: list[str], segment: Callable[[Column], Column]) -> DataFrame:
        n = tasks(spark, spark.table(table).count())  # files count their rows
        of = spark.sql(read).repartition(n, "rec_no").groupBy("rec_no").agg(F.array_sort(F.collect_list(F.struct(*by, "back"))).alias("s"))
        return of.select("rec_no", F.transform("s", lambda x: F.struct(segment(x).alias("segment"), F.when(x["back"], "-").otherwise("+").alias("strand"))).alias("steps"))

    p = collected(
        "lineitem",
        "SELECT CAST(l_orderkey AS BIGINT) AS rec_no, l_linenumber, l_partkey, l_suppkey, l_extendedprice, COALESCE(l_returnflag = 'R', FALSE) AS back FROM lineitem",
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        lambda x: F.concat(F.lit("s"), x["l_partkey"].cast("string")),
    )
    parts = F.lit(spark.table("part").count())
    w = collected(
        "events",
        "SELECT CAST(user_id AS BIGINT) AS rec_no, ts, event_id, COALESCE(event_type = 'error', FALSE) AS back FROM events",
        ["ts", "event_id"],
        lambda x: F.concat(F.lit("s"), (x["event_id"] % parts).cast("string")),
    )
    sample = "concat('C', CAST(o_custkey % 50 AS VARCHAR(20)))"
    named = spark.sql(f"SELECT CAST(o_orderkey AS BIGINT) AS rec_no, {sample} AS sample, concat({sample}, '#', CAST(o_orderkey % 2 + 1 AS VARCHAR(20)), '#chr') AS name, CAST(o_orderkey * 1000 AS BIGINT) AS start FROM orders")
    user = F.concat(F.lit("U"), F.col("rec_no").cast("string"))
    paths = p.join(named.hint("shuffle_hash"), "rec_no").select(F.lit(0).alias("phase"), "rec_no", "name", "sample", "start", "steps")
    return paths.unionByName(w.select(F.lit(1).alias("phase"), "rec_no", F.concat(user, F.lit("#1#chr")).alias("name"), user.alias("sample"), F.lit(0).cast("long").alias("start"), "steps"))


TAGS = "concat('SM:Z:S', CAST(pk % 7 AS VARCHAR(20)), ',S', CAST(pk % 5 AS VARCHAR(20)))"
SEGS_BED = SEG + f""",
segs AS (SELECT sn AS ref, so AS start, so + len AS stop, id, rank, CASE WHEN pk % 3 = 0 THEN NULL ELSE {TAGS} END AS tags FROM seg)"""
LINKS_BED = SEG + "," + LNK + """,
lboth AS (
    SELECT l.rec_no, concat(l.source, l.source_strand) AS source, concat(l.target, l.target_strand) AS target,
           a.sn AS source_ref, a.so AS source_start, a.so + a.len AS source_end, a.rank AS source_rank, a.id AS source_id,
           b.sn AS target_ref, b.so AS target_start, b.so + b.len AS target_end, b.rank AS target_rank, b.id AS target_id
    FROM lnk l JOIN seg a ON l.spk = a.pk JOIN seg b ON l.tpk = b.pk
)"""


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The segment and link tables of the derived graph, read from an index written by place."""
    from ..sources.beds import by_place

    def side(k: int) -> DataFrame:
        return kept(spark, sf_dir, ("segment-index", "link-index")[k], lambda: by_place(derived_index(spark, sf_dir)[k]))

    return side(0), side(1)


def bed_prefix(spark: SparkSession, sf_dir: str) -> str:
    """The prefix of BED files of the derived graph: segments, links and bubbles, each a folder of text."""
    from ..sources.beds import BUBBLES, LINKS, SEGMENTS, bed_rows

    segs, both = index(spark, sf_dir)
    wide = bubbles(spark, sf_dir).withColumns({"x1": F.lit("-1"), "x2": F.lit("-1"), "x3": F.lit("-1"), "segments": F.lit("s1,s2")})
    at = {name: stored(spark, sf_dir, f"{name}-bed", lambda table=table, schema=schema: bed_rows(table, schema), text=True) for name, table, schema in (("segs", segs, SEGMENTS), ("links", both, LINKS), ("bubbles", wide, BUBBLES))}
    key = (spark.sparkContext.applicationId, sf_dir, "bed-prefix")
    if key not in FILES:
        folder = passing(spark, "graph-bed")
        for name, path in at.items():
            spark.read.text(path).write.text(f"{folder}/graph.{name}.bed")
        FILES[key] = f"{folder}/graph"
    return FILES[key]


def gfa_file(spark: SparkSession, sf_dir: str) -> str:
    """The derived graph as a folder of GFA text, in order."""
    return stored(spark, sf_dir, "gfa-file", lambda: gfa_text(spark, sf_dir).repartitionByRange("rec_no").sortWithinPartitions("rec_no").select("line"), text=True)


def derived_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..sources.beds import index_tables

    tagged = rows(spark, sf_dir, SEG, f"SELECT pk AS rec_no, id, len AS length, sn, so, rank AS sr, CASE WHEN pk % 3 = 0 THEN NULL ELSE {TAGS} END AS tags_text FROM seg")
    return index_tables(tagged, links(spark, sf_dir))


BUBBLE = GRAPH + """,
bubble AS (
    SELECT concat('REF#0#', o.contig) AS ref, e.so + e.len AS start, x.so AS stop, CAST(o.members AS BIGINT) AS segment_count,
           CAST(CASE WHEN o.bno % 9 = 0 THEN 2147483647 ELSE o.bno * 1500 END AS BIGINT) AS path_count, CASE WHEN o.bno % 5 = 0 THEN '1' ELSE '0' END AS inversion,
           CAST(0 + (o.bno % 2) * o.total AS BIGINT) AS shortest_length, CAST(o.total AS BIGINT) AS longest_length, '*' AS shortest, 'ACGT' AS longest
    FROM (SELECT contig, bno, MAX(members) AS members, SUM(len) * 37 AS total FROM off GROUP BY contig, bno) o
    JOIN bb e ON e.contig = o.contig AND e.bno = o.bno JOIN bb x ON x.contig = o.contig AND x.bno = o.bno + 1 + o.bno % 3
)"""


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, BUBBLE, "SELECT ref, start, stop AS `end`, segment_count, path_count, inversion, shortest_length, longest_length, shortest, longest FROM bubble")


def gfa_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_no and line: the derived graph as GFA1 text, for the parser; the order is that of rec_no."""
    return kept(spark, sf_dir, "gfa-text", lambda: derived_text(spark, sf_dir))


#: Length and depth tag (null without one that counts) of the segments of `odd_files`.
ODD = GRAPH + "," + STEPS + """,
odd AS (
    SELECT pk, id, CASE WHEN pk % 14 = 0 THEN 0 ELSE len END AS len,
           CASE WHEN pk % 2 = 1 THEN CASE WHEN pk % 3 = 0 THEN 3.0::DOUBLE END WHEN pk % 5 = 0 THEN len + 0.5::DOUBLE WHEN pk % 5 = 1 THEN len WHEN pk % 5 = 3 THEN 2.0::DOUBLE END AS tagged
    FROM seg
),
claims AS (
    SELECT 0 AS p, pk AS rec_no, 0 AS spot, id AS segment, '-' AS strand FROM seg WHERE pk % 20 = 0 UNION ALL SELECT 0, pk, 1, concat('x', pk), '+' FROM seg WHERE pk % 20 = 0
    UNION ALL SELECT 1, rec_no, 0, source, source_strand FROM lnk UNION ALL SELECT 1, rec_no, 1, target, target_strand FROM lnk UNION ALL SELECT 2, rec_no, step_no, segment, strand FROM psteps
),
canon AS (SELECT segment, strand FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY p, rec_no, spot) AS n FROM claims) c WHERE n = 1)"""


def odd_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Three folders of GFA text of unlike sizes: ids that come again later and links to segments that no record declares; segments of both
    versions, of length 0, with depth tags of every kind; edges of the second version and paths."""
    seg = rows(spark, sf_dir, SEG, "SELECT pk, id, len FROM seg")
    pk, size = F.col("pk"), F.col("len").cast("string")

    def ordered(lines: DataFrame, *by: str) -> DataFrame:
        return lines.repartitionByRange(*by).sortWithinPartitions(*by).select("line")

    again = seg.where("pk % 10 = 0").select(pk, F.lit(1).alias("at"), F.concat_ws("\t", F.lit("S"), "id", F.lit("*"), F.lit("LN:i:9999")).alias("line"))
    loose = seg.where("pk % 20 = 0").select(pk, F.lit(2).alias("at"), F.concat_ws("\t", F.lit("L"), "id", F.lit("-"), F.concat(F.lit("x"), pk.cast("string")), F.lit("+"), F.lit("0M")).alias("line"))
    depth = F.when(pk % 5 == 0, F.concat(F.lit("dp:f:"), size, F.lit(".5"))).when(pk % 5 == 1, F.concat(F.lit("RC:i:"), size)).when(pk % 5 == 2, F.lit("FC:i:0")).when(pk % 5 == 3, F.lit("KC:i:7\tdp:f:2"))
    one = F.concat_ws("\t", F.lit("S"), "id", F.lit("*"), F.concat(F.lit("LN:i:"), F.when(pk % 14 == 0, "0").otherwise(size)), depth)
    two = F.concat_ws("\t", F.lit("S"), "id", size, F.lit("*"), F.when(pk % 3 == 0, F.lit("RC:i:3")))
    edge = links(spark, sf_dir).select(F.lit(0).alias("at"), "rec_no", F.concat_ws("\t", F.lit("E"), F.lit("*"), F.concat("source", "source_strand"), F.concat("target", "target_strand"), F.lit("0"), F.lit("1"), F.lit("0"), F.lit("1"), F.lit("*")).alias("line"))
    path = gfa_text(spark, sf_dir).where(F.startswith("line", F.lit("P"))).select(F.lit(1).alias("at"), "rec_no", "line")
    return [
        stored(spark, sf_dir, "odd-a", lambda: ordered(again.union(loose), "pk", "at"), text=True),
        stored(spark, sf_dir, "odd-b", lambda: ordered(seg.select(pk, F.when(pk % 2 == 1, two).otherwise(one).alias("line")), "pk"), text=True),
        stored(spark, sf_dir, "odd-c", lambda: ordered(edge.union(path), "at", "rec_no"), text=True),
    ]


#: Records of one type lie between multiples of this number.
BAND = 1 << 58


def derived_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = rows(spark, sf_dir, SEG, "SELECT * FROM seg")
    s = seg.select((F.col("pk") + 1).alias("rec_no"), F.concat_ws("\t", F.lit("S"), "id", F.lit("*"), F.concat(F.lit("LN:i:"), "len"), F.concat(F.lit("SN:Z:"), "sn"), F.concat(F.lit("SO:i:"), "so"), F.concat(F.lit("SR:i:"), "rank"), F.concat(F.lit("xx:A:"), "rank")).alias("line"))
    big = BAND
    ln = links(spark, sf_dir).select((F.col("rec_no") + big).alias("rec_no"), F.concat_ws("\t", F.lit("L"), "source", "source_strand", "target", "target_strand", F.lit("0M")).alias("line"))
    told = records(spark, sf_dir)
    p = told.where("phase = 0").select((F.col("rec_no") + 2 * big).alias("rec_no"), F.concat_ws("\t", F.lit("P"), F.concat("name", F.lit(":"), "start", F.lit("-"), F.col("start") + 1), F.array_join(F.transform("steps", lambda x: F.concat(x["segment"], x["strand"])), ","), F.lit("*")).alias("line"))
    w = told.where("phase = 1").select((F.col("rec_no") + 3 * big).alias("rec_no"), F.concat_ws("\t", F.lit("W"), "sample", F.lit("1"), F.lit("chr"), F.lit("*"), F.lit("*"), F.array_join(F.transform("steps", lambda x: F.concat(F.when(x["strand"] == "-", "<").otherwise(">"), x["segment"])), "")).alias("line"))
    return s.unionByName(ln).unionByName(p).unionByName(w)
