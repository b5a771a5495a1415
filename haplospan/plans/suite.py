"""Named queries over the derived graph, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import alleles, anchor, colors, convert, curves, cut, edges, force, labels, layout, seeds, spans, spatial
from ..operators.curves import NAMES
from ..functions.register import register
from ..sources import ancestry, beds, gfa, gfa_source
from ..storage import numbered
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
REGION = ("REF#0#chr0", 100, 2500)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- records


@query(f"WITH {fx.SEG} SELECT id, len AS length, sn, so, rank AS sr FROM seg")
def gfa_segments(spark, sf_dir):
    return gfa.segments(fx.gfa_text(spark, sf_dir)).select("id", "length", "sn", "so", "sr")


@query(f"WITH {fx.GRAPH} SELECT rec_no + {fx.BAND} AS rec_no, source, source_strand, target, target_strand, '0M' AS cigar FROM lnk")
def gfa_links(spark, sf_dir):
    return gfa.links(fx.gfa_text(spark, sf_dir)).select("rec_no", "source", "source_strand", "target", "target_strand", "cigar")


@query(f"WITH {fx.STEPS} SELECT phase, name, sample, start, step_no, segment, strand FROM steps")
def gfa_steps(spark, sf_dir):
    lines = fx.gfa_text(spark, sf_dir)
    steps = gfa.exploded(gfa.records(gfa.paths(lines), gfa.walks(lines)))
    return steps.select("phase", "name", "sample", "start", F.col("step_no").cast("long").alias("step_no"), "segment", "strand")


@query(f"WITH {fx.SEG} SELECT id, 3 + 0 AS kept, CAST(len AS VARCHAR) AS ln, sn FROM seg")
def gfa_tags(spark, sf_dir):
    tags = gfa.of_type(fx.gfa_text(spark, sf_dir), "S").select(F.col("f")[1].alias("id"), gfa.tags(gfa.rest(F.col("f"), 4)).alias("t"))
    return tags.select("id", (F.size("t") - 1).cast("int").alias("kept"), F.col("t")["LN"]["value"].alias("ln"), F.col("t")["SN"]["value"].alias("sn"))


# ---------------------------------------------------------------- tables by place

IN_REGION = f"ref = '{REGION[0]}' AND ((start < {REGION[2]} AND stop > {REGION[1]}) OR (start = stop AND start >= {REGION[1]} AND start < {REGION[2]}))"


@query(f"WITH {fx.SEGS_BED} SELECT id, ref, start, stop, rank FROM segs WHERE {IN_REGION}")
def segs_in_region(spark, sf_dir):
    return beds.in_region(fx.index(spark, sf_dir)[0], *REGION).select("id", "ref", "start", F.col("end").alias("stop"), "rank")


LINK_ROWS = fx.LINKS_BED + """,
lrows AS (
    SELECT source_ref AS ref, source_start AS start, source_end AS stop, * FROM lboth
    UNION ALL SELECT target_ref, target_start, target_end, * FROM lboth
)"""


@query(f"WITH {LINK_ROWS} SELECT ref, start, stop, source, target, source_start, target_start, source_rank, target_rank FROM lrows WHERE {IN_REGION}")
def links_in_region(spark, sf_dir):
    found = beds.in_region(fx.index(spark, sf_dir)[1], *REGION)
    return found.select("ref", "start", F.col("end").alias("stop"), "source", "target", "source_start", "target_start", "source_rank", "target_rank")


@query(
    f"""WITH {fx.BUBBLE} SELECT ref, start, stop,
    CASE WHEN shortest_length = longest_length THEN format('{{:,}} bp', longest_length) ELSE format('{{:,}}-{{:,}} bp', shortest_length, longest_length) END AS label,
    concat_ws(', ', format('{{}} segments', segment_count), CASE WHEN path_count = 2147483647 THEN 'more paths than gfatools counts' ELSE format('up to {{:,}} paths', path_count) END,
              CASE WHEN inversion = '1' THEN 'inversion' END) AS description, NULLIF(shortest, '*') AS shortest, NULLIF(longest, '*') AS longest
    FROM bubble WHERE {IN_REGION}"""
)
def bubbles_in_region(spark, sf_dir):
    found = beds.bubble_features(fx.bubbles(spark, sf_dir), *REGION)
    return found.withColumnRenamed("end", "stop")


@query(
    f"""WITH {fx.SEGS_BED}, t AS (SELECT id, pk FROM seg)
    SELECT s.id, CASE WHEN t.pk % 3 = 0 THEN NULL ELSE concat('S', t.pk % 7, '|', 'S', t.pk % 5) END AS samples, CASE WHEN t.pk % 3 = 0 THEN NULL ELSE CAST(2 AS BIGINT) END AS carriers
    FROM segs s JOIN t ON s.id = t.id WHERE {IN_REGION}"""
)
def samples_and_carriers(spark, sf_dir):
    return beds.segment_features(fx.index(spark, sf_dir)[0], *REGION).select("id", F.array_join("samples", "|").alias("samples"), "carriers")


@query(f"WITH {fx.SEG} SELECT DISTINCT contig AS name FROM seg WHERE rank = 0")
def refnames_for_assembly(spark, sf_dir):
    return beds.reference_names(fx.index(spark, sf_dir)[0], "REF")


@query(f"WITH {fx.SEG} SELECT DISTINCT sn AS name FROM seg")
def refnames_without_assembly(spark, sf_dir):
    return beds.reference_names(fx.index(spark, sf_dir)[0], "nobody")


@query(
    f"""WITH {fx.SEG}, q AS (SELECT 'REF' AS assembly, contig FROM seg UNION SELECT 'other', sn FROM seg WHERE rank > 0 UNION SELECT 'none', contig FROM seg)
    SELECT assembly, contig, CASE assembly WHEN 'REF' THEN concat('REF#0#', contig) WHEN 'other' THEN contig END AS ref FROM q"""
)
def refname_resolve(spark, sf_dir):
    seg = fx.segments(spark, sf_dir)
    contig = naming.pansn_contig(F.col("sn"))
    asked = seg.select(F.lit("REF").alias("assembly"), contig.alias("contig")).union(seg.where("sr > 0").select(F.lit("other"), "sn")).union(seg.select(F.lit("none"), contig)).distinct()
    return beds.resolve_names(asked, fx.index(spark, sf_dir)[0])


# ---------------------------------------------------------------- conversion

CLAIMED = """
claims AS (
    SELECT 0 AS p, rec_no, 0 AS spot, source AS segment, source_strand AS strand FROM lnk UNION ALL SELECT 0, rec_no, 1, target, target_strand FROM lnk
    UNION ALL SELECT phase + 1, rec_no, step_no, segment, strand FROM steps
),
canon AS (SELECT segment, strand FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY p, rec_no, spot) AS n FROM claims) c WHERE n = 1)"""
CLAIMS = fx.GRAPH + "," + fx.STEPS + "," + CLAIMED


@query(f"WITH {CLAIMS} SELECT segment, strand FROM canon")
def canonical_strand(spark, sf_dir):
    return convert.canonical_strands(fx.links(spark, sf_dir), fx.steps(spark, sf_dir))


@query(
    f"""WITH {CLAIMS}, t AS (SELECT segment, COUNT(*) AS n FROM steps GROUP BY segment)
    SELECT concat(s.id, COALESCE(c.strand, '+')) AS node_id, CAST(GREATEST(COALESCE(t.n, 1), 1) AS DOUBLE) AS depth, s.sn, s.so FROM seg s LEFT JOIN canon c ON s.id = c.segment LEFT JOIN t ON s.id = t.segment"""
)
def segment_depth(spark, sf_dir):
    lines = fx.gfa_text(spark, sf_dir)
    return convert.nodes(gfa.segments(lines), fx.links(spark, sf_dir), fx.steps(spark, sf_dir)).select("node_id", "depth", "sn", "so")


NAMED_EDGES = """
own AS (SELECT s.phase, s.rec_no, s.name, s.step_no, concat(c.segment, c.strand) AS node FROM steps s JOIN canon c ON s.segment = c.segment),
nx AS (SELECT *, LEAD(node) OVER (PARTITION BY phase, rec_no ORDER BY step_no) AS other FROM own),
k AS (SELECT concat(LEAST(node, other), '--', GREATEST(node, other)) AS key, name, MIN(phase * 1000000000000000 + rec_no * 1000000 + step_no) AS spot FROM nx WHERE other IS NOT NULL GROUP BY 1, 2),
names AS (SELECT key, string_agg(name, '|' ORDER BY spot) AS path_ids, COUNT(*) AS paths FROM k GROUP BY key),
e AS (SELECT l.rec_no AS edge_no, concat(l.source, a.strand) AS from_id, concat(l.target, b.strand) AS to_id FROM lnk l JOIN canon a ON l.source = a.segment JOIN canon b ON l.target = b.segment),
named AS (SELECT e.edge_no, e.from_id, e.to_id, n.path_ids, COALESCE(n.paths, 0) AS paths FROM e LEFT JOIN names n ON n.key = concat(LEAST(from_id, to_id), '--', GREATEST(from_id, to_id)))"""


@query(f"WITH {CLAIMS},{NAMED_EDGES} SELECT edge_no, from_id, to_id, path_ids FROM named")
def edge_paths(spark, sf_dir):
    links, steps = fx.links(spark, sf_dir), fx.steps(spark, sf_dir)
    return convert.edges(links, convert.canonical_strands(links, steps), steps).select("edge_no", "from_id", "to_id", F.array_join("path_ids", "|").alias("path_ids"))


@query(f"WITH {CLAIMS} SELECT (SELECT COUNT(*) FROM seg) AS nodes, (SELECT COUNT(*) FROM lnk) AS edges, (SELECT COUNT(*) FROM (SELECT DISTINCT phase, rec_no FROM steps) x) AS paths")
def graph_summary(spark, sf_dir):
    return convert.summary(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), fx.records(spark, sf_dir).select("phase", "rec_no").distinct())


# ---------------------------------------------------------------- anchoring

WALK = fx.SEG + "," + fx.STEPS + """,
walk AS (
    SELECT s.*, COALESCE(g.len, 0) AS len,
           s.start + COALESCE(SUM(COALESCE(g.len, 0)) OVER (PARTITION BY s.phase, s.rec_no ORDER BY s.step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot
    FROM steps s LEFT JOIN seg g ON s.segment = g.id
)"""


def visits(spark, sf_dir):
    return anchor.visits(fx.steps(spark, sf_dir), fx.segments(spark, sf_dir))


@query(f"WITH {WALK} SELECT phase, rec_no, step_no, name, segment, strand, CAST(spot AS BIGINT) AS spot FROM walk")
def path_walk(spark, sf_dir):
    return visits(spark, sf_dir).select("phase", "rec_no", F.col("step_no").cast("long").alias("step_no"), "name", "segment", "strand", F.col("at").cast("long").alias("spot"))


@query(f"WITH {WALK} SELECT phase, rec_no, name, sample, start, CAST(SUM(len) AS BIGINT) AS length FROM walk GROUP BY ALL")
def path_origins(spark, sf_dir):
    return anchor.origins(fx.steps(spark, sf_dir), fx.segments(spark, sf_dir))


@query(
    f"""WITH {WALK}, v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY CASE WHEN name = 'C7#1#chr' THEN 0 ELSE 1 END, phase, rec_no, step_no) AS n FROM walk)
    SELECT segment, name AS sn, CAST(spot AS BIGINT) AS so, CAST(CASE WHEN name = 'C7#1#chr' THEN 0 ELSE 1 END AS BIGINT) AS sr, strand FROM v WHERE n = 1"""
)
def anchor_from_paths(spark, sf_dir):
    return anchor.anchored(visits(spark, sf_dir), "C7#1#chr").withColumn("so", F.col("so").cast("long"))


@query(f"WITH {WALK} SELECT segment, string_agg(sample, '|' ORDER BY sample) AS samples FROM (SELECT DISTINCT segment, sample FROM walk) d GROUP BY segment")
def carriage(spark, sf_dir):
    return anchor.carriage(visits(spark, sf_dir)).select("segment", F.array_join("samples", "|").alias("samples"))


@query(f"WITH {fx.STEPS} SELECT name FROM steps WHERE sample = 'C7' ORDER BY phase, rec_no LIMIT 1")
def reference_path(spark, sf_dir):
    return spark.createDataFrame([(anchor.reference_path(fx.steps(spark, sf_dir).select("phase", "rec_no", "name", "sample"), "C7"),)], "name string")


@query(
    f"""WITH {WALK}, d AS (SELECT segment, COUNT(*) AS depth FROM walk GROUP BY segment),
    s AS (SELECT w.name, w.spot, w.spot + w.len AS stop, d.depth FROM walk w JOIN d ON w.segment = d.segment WHERE w.len > 0),
    t AS (SELECT *, unnest(range(CAST(spot // 500 AS BIGINT), CAST((stop - 1) // 500 AS BIGINT) + 1)) AS tile FROM s)
    SELECT name, CAST(tile * 500 AS BIGINT) AS start, CAST(SUM(LEAST(stop, (tile + 1) * 500) - GREATEST(spot, tile * 500)) AS BIGINT) AS bp,
           CAST(SUM((LEAST(stop, (tile + 1) * 500) - GREATEST(spot, tile * 500)) * depth) AS BIGINT) AS bp_depth FROM t GROUP BY name, tile"""
)
def depth_windows(spark, sf_dir):
    return anchor.depth_windows(visits(spark, sf_dir))


# ---------------------------------------------------------------- cuts


def cut_sql(hops: int) -> str:
    """CTEs k{n} (segments known) and f{n} (link rows found) after n hops."""
    ends = "SELECT source_id AS id, source_ref AS ref, source_start AS start, source_end AS stop, source_rank AS rank FROM {0} UNION SELECT target_id, target_ref, target_start, target_end, target_rank FROM {0}"
    sql = LINK_ROWS + f""",
own AS (SELECT id, sn AS ref, so AS start, so + len AS stop, rank FROM seg WHERE {IN_REGION.replace("ref =", "sn =").replace("start", "so").replace("stop", "(so + len)")}),
f0 AS (SELECT * FROM lrows WHERE {IN_REGION}),
r0 AS (SELECT * FROM ({ends.format("f0")}) e WHERE id NOT IN (SELECT id FROM own)),
k0 AS (SELECT * FROM own UNION ALL SELECT * FROM r0)"""
    for n in range(1, hops + 1):
        sql += f""",
n{n} AS (SELECT DISTINCT l.* FROM lrows l JOIN r{n - 1} r ON r.rank > 0 AND l.ref = r.ref AND ((l.start < r.stop AND l.stop > r.start) OR (l.start = l.stop AND l.start >= r.start AND l.start < r.stop))),
f{n} AS (SELECT * FROM f{n - 1} UNION ALL SELECT * FROM n{n}),
r{n} AS (SELECT * FROM ({ends.format(f"n{n}")}) e WHERE id NOT IN (SELECT id FROM k{n - 1})),
k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT * FROM r{n})"""
    return sql


def cut_of(spark, sf_dir, context):
    return cut.subgraph(*fx.index(spark, sf_dir), *REGION, context=context)


def cut_segments(hops: int) -> None:
    def run(spark, sf_dir):
        return cut_of(spark, sf_dir, hops)[0].select("id", "ref", "start", F.col("end").alias("stop"), "rank")

    run.__name__ = f"subgraph_k{hops}"
    query(f"WITH {cut_sql(hops)} SELECT id, ref, start, stop, rank FROM k{hops}")(run)


for hops_ in (0, 1, 2):
    cut_segments(hops_)


@query(f"WITH {cut_sql(1)} SELECT DISTINCT source, target FROM f1")
def subgraph_links(spark, sf_dir):
    return cut_of(spark, sf_dir, 1)[1].select("source", "target")


@query(
    f"""WITH {cut_sql(1)}, tagged AS (SELECT k.*, CASE WHEN g.pk % 3 = 0 THEN NULL ELSE concat('SM:Z:S', g.pk % 7, ',S', g.pk % 5) END AS tag FROM k1 k JOIN seg g ON k.id = g.id)
    SELECT 'H' || chr(9) || 'VN:Z:1.0' AS line
    UNION ALL SELECT concat_ws(chr(9), 'S', id, '*', concat('LN:i:', stop - start), concat('SN:Z:', ref), concat('SO:i:', start), concat('SR:i:', rank), tag) FROM tagged
    UNION ALL SELECT concat_ws(chr(9), 'L', left(source, length(source) - 1), right(source, 1), left(target, length(target) - 1), right(target, 1), '0M') FROM (SELECT DISTINCT source, target FROM f1) x"""
)
def subgraph_gfa_text(spark, sf_dir):
    return cut.gfa_lines(*cut_of(spark, sf_dir, 1)).select("line")


# ---------------------------------------------------------------- spans

NEAR = fx.GRAPH + """,
nb AS (SELECT source AS node, target AS other FROM lnk UNION SELECT target, source FROM lnk),
isoff AS (SELECT id FROM seg WHERE rank > 0),
isbb AS (SELECT id, so, so + len AS stop FROM seg WHERE rank = 0),
w0 AS (SELECT id AS origin, id AS node FROM isoff),
w1 AS (SELECT DISTINCT w.origin, n.other AS node FROM w0 w JOIN nb n ON n.node = w.node JOIN isoff o ON o.id = n.other),
w2 AS (SELECT DISTINCT w.origin, n.other AS node FROM w1 w JOIN nb n ON n.node = w.node JOIN isoff o ON o.id = n.other),
w3 AS (SELECT DISTINCT w.origin, n.other AS node FROM w2 w JOIN nb n ON n.node = w.node JOIN isoff o ON o.id = n.other),
wall AS (SELECT * FROM w0 UNION SELECT * FROM w1 UNION SELECT * FROM w2 UNION SELECT * FROM w3),
spans AS (
    SELECT id AS node_id, so AS start, stop FROM isbb
    UNION ALL
    SELECT w.origin, LEAST(MIN(b.stop), MAX(b.so)), GREATEST(MIN(b.stop), MAX(b.so)) FROM wall w JOIN nb n ON n.node = w.node JOIN isbb b ON b.id = n.other GROUP BY w.origin
)"""


def span_rows(spark, sf_dir):
    return spans.reference_spans(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))


@query(f"WITH {NEAR} SELECT node_id, start, stop FROM spans")
def node_reference_span(spark, sf_dir):
    return span_rows(spark, sf_dir).select("node_id", "start", F.col("end").alias("stop"))


@query(f"WITH {NEAR} SELECT node_id, CAST(start + stop AS DOUBLE) / 2 AS midpoint FROM spans")
def reference_midpoints(spark, sf_dir):
    return spans.midpoints(span_rows(spark, sf_dir))


DELETIONS = fx.GRAPH + """,
del AS (
    SELECT l.rec_no AS edge_no, l.source AS from_id, l.target AS to_id, a.sn AS ref, CASE WHEN a.so <= b.so THEN a.so + a.len ELSE b.so + b.len END AS start, CASE WHEN a.so <= b.so THEN b.so ELSE a.so END AS stop
    FROM lnk l JOIN bb a ON l.spk = a.pk JOIN bb b ON l.tpk = b.pk WHERE a.sn = b.sn
)"""


@query(f"WITH {DELETIONS} SELECT edge_no, from_id, to_id, ref, start, stop, stop - start AS bp FROM del WHERE stop - start >= 1")
def deletion_edges(spark, sf_dir):
    return spans.deletion_edges(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)).withColumnRenamed("end", "stop")


@query(f"WITH {DELETIONS} SELECT d.edge_no, string_agg(b.id, '|' ORDER BY b.so, b.id) AS bypassed FROM del d JOIN bb b ON b.sn = d.ref AND b.so >= d.start AND b.so < d.stop AND b.so + b.len <= d.stop WHERE d.stop - d.start >= 1 GROUP BY d.edge_no")
def deletion_bypassed(spark, sf_dir):
    nodes = fx.nodes(spark, sf_dir)
    return spans.bypassed(spans.deletion_edges(nodes, fx.edges(spark, sf_dir)), nodes).select("edge_no", F.array_join("bypassed", "|").alias("bypassed"))


@query(
    f"""WITH {NEAR}, q AS (SELECT pk AS point_id, concat('REF#0#', contig) AS ref, pk * 7 AS spot, CASE WHEN pk % 2 = 0 THEN id ELSE 'nobody' END AS name FROM seg),
    hit AS (SELECT q.point_id, b.id, ROW_NUMBER() OVER (PARTITION BY q.point_id ORDER BY b.pk) AS n FROM q JOIN bb b ON b.sn = q.ref AND q.spot BETWEEN b.so AND b.so + b.len),
    h AS (SELECT q.point_id, COALESCE(s.id, t.id) AS node_id FROM q LEFT JOIN seg s ON s.id = q.name LEFT JOIN (SELECT * FROM hit WHERE n = 1) t ON t.point_id = q.point_id)
    SELECT h.point_id, h.node_id, p.start, p.stop FROM h LEFT JOIN spans p ON p.node_id = h.node_id"""
)
def hover_to_node(spark, sf_dir):
    nodes = fx.nodes(spark, sf_dir)
    points = nodes.select(F.col("rec_no").alias("point_id"), F.concat(F.lit("REF#0#"), naming.pansn_contig(F.col("sn"))).alias("ref"), (F.col("rec_no") * 7).alias("at"), F.when(F.col("rec_no") % 2 == 0, F.col("name")).otherwise("nobody").alias("name"))
    return spans.hovered(points, nodes, span_rows(spark, sf_dir)).withColumnRenamed("end", "stop")


LOCI = fx.SEG + """,
p AS (SELECT split_part(sn, '#', 1) AS sample, contig AS ref, so AS start, so + len AS stop, rank FROM seg),
g AS (SELECT *, MAX(stop) OVER (PARTITION BY sample, ref ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM p),
i AS (SELECT *, SUM(CASE WHEN start - far > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, ref ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
r AS (SELECT sample, ref, run, MIN(start) AS start, MAX(stop) AS stop, MIN(rank) AS rank, COUNT(*) AS n FROM i GROUP BY sample, ref, run),
loci AS (
    SELECT sample, ref, start, stop, lowest AS rank, CAST(total AS BIGINT) AS node_count
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample, ref ORDER BY stop - start DESC, start) AS o, MIN(rank) OVER (PARTITION BY sample, ref) AS lowest, SUM(n) OVER (PARTITION BY sample, ref) AS total FROM r) x WHERE o = 1
)"""


@query(f"WITH {LOCI} SELECT sample, ref, start, stop, rank, node_count FROM loci")
def contributing_loci(spark, sf_dir):
    return spans.contributors(fx.nodes(spark, sf_dir), 2000).withColumnRenamed("end", "stop")


ALIASES = [("REF", "hg38"), ("S1", "one"), ("S3", "three")]
ALIAS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") AS a(sample, assembly)"


@query(f"WITH {LOCI} SELECT a.assembly AS sample, ref, start, stop, rank, node_count FROM loci JOIN {ALIAS_SQL} ON loci.sample = a.sample")
def contributors_resolved(spark, sf_dir):
    names = spark.createDataFrame(ALIASES, "sample string, assembly string")
    return spans.resolve_contributors(spans.contributors(fx.nodes(spark, sf_dir), 2000), names).withColumnRenamed("end", "stop")


@query(f"WITH {LOCI} SELECT CASE WHEN rank = 0 THEN 'asm' ELSE sample END AS sample, CASE WHEN rank = 0 THEN 'chr0' ELSE ref END AS ref, CASE WHEN rank = 0 THEN CAST(100 AS BIGINT) ELSE start END AS start, CASE WHEN rank = 0 THEN CAST(2500 AS BIGINT) ELSE stop END AS stop, rank, node_count FROM loci")
def contributors_with_region(spark, sf_dir):
    return spans.with_reference_region(spans.contributors(fx.nodes(spark, sf_dir), 2000), "asm", "chr0", 100, 2500).withColumnRenamed("end", "stop")


@query(
    f"""WITH {NEAR}, t AS (
        SELECT s.id AS node_id, 'own' AS kind, a.assembly, s.contig AS ref, s.so AS start, s.so + s.len AS stop FROM seg s JOIN {ALIAS_SQL} ON split_part(s.sn, '#', 1) = a.sample
        UNION ALL SELECT node_id, 'reference', 'hg38', 'chr0', start, stop FROM spans)
    SELECT node_id, kind, assembly, ref, CAST(GREATEST(start - CAST(ceil(GREATEST(1000 - (stop - start), 0) / 2.0) AS BIGINT), 0) AS BIGINT) AS start, CAST(stop + ceil(GREATEST(1000 - (stop - start), 0) / 2.0) AS BIGINT) AS stop FROM t"""
)
def launch_targets(spark, sf_dir):
    names = spark.createDataFrame(ALIASES, "sample string, assembly string")
    return spans.launch_targets(fx.nodes(spark, sf_dir), span_rows(spark, sf_dir), names, ("hg38", "chr0")).withColumnRenamed("end", "stop")


# ---------------------------------------------------------------- alleles

ALLELES = fx.GRAPH + """,
members AS (
    SELECT o.*, CAST(COALESCE(SUM(len) OVER (PARTITION BY contig, bno ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, CAST(SUM(len) OVER (PARTITION BY contig, bno) AS BIGINT) AS total,
           ROW_NUMBER() OVER (PARTITION BY contig, bno ORDER BY len DESC, place) AS longest
    FROM off o
),
al AS (
    SELECT m.contig, m.bno, concat('REF#0#', m.contig) AS ref, e.so + e.len AS start, x.so AS stop, split_part(m.sn, '#', 1) AS sample, CAST(split_part(m.sn, '#', 2) AS BIGINT) AS haplotype, m.sn AS source_ref, m.rank, m.total, m.members
    FROM members m JOIN bb e ON e.contig = m.contig AND e.bno = m.bno JOIN bb x ON x.contig = m.contig AND x.bno = m.bno + 1 + m.bno % 3
    WHERE m.longest = 1
)"""


def projected(spark, sf_dir):
    return alleles.project(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))


@query(
    f"""WITH {ALLELES}, ids AS (SELECT contig, bno, string_agg(id, '|' ORDER BY place) AS segments, string_agg(CAST(pos AS VARCHAR), '|' ORDER BY place) AS offsets FROM members GROUP BY contig, bno)
    SELECT al.ref, al.start, al.stop, sample, haplotype, source_ref, rank, stop - start AS ref_span, total AS alt_length, total - (stop - start) AS delta,
           CASE WHEN total > stop - start THEN 'insertion' WHEN total < stop - start THEN 'deletion' ELSE 'substitution' END AS kind, total AS path_length, ids.segments, ids.offsets
    FROM al JOIN ids ON al.contig = ids.contig AND al.bno = ids.bno"""
)
def allele_projection(spark, sf_dir):
    found = projected(spark, sf_dir)[0].withColumnRenamed("end", "stop")
    return found.drop("run", "nodes").withColumns({"segments": F.array_join("segments", "|"), "offsets": F.array_join(F.col("offsets").cast("array<string>"), "|")})


@query(f"WITH {ALLELES} SELECT CAST((SELECT COUNT(*) FROM (SELECT DISTINCT contig, bno FROM off) r) - (SELECT COUNT(*) FROM al) AS BIGINT) AS unanchored")
def allele_unanchored(spark, sf_dir):
    return projected(spark, sf_dir)[2]


@query(f"WITH {ALLELES} SELECT kind, COUNT(*) AS n, CAST(SUM(d) AS BIGINT) AS bp FROM (SELECT CASE WHEN total > stop - start THEN 'insertion' WHEN total < stop - start THEN 'deletion' ELSE 'substitution' END AS kind, total - (stop - start) AS d FROM al) k GROUP BY kind")
def allele_summary(spark, sf_dir):
    return projected(spark, sf_dir)[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("bp"))


@query(f"WITH {ALLELES} SELECT ref, start, stop - start - total AS bp FROM al WHERE stop - start - total >= 1")
def allele_deletions(spark, sf_dir):
    found = projected(spark, sf_dir)[0]
    return alleles.allele_deletions(found).join(found.select("run", "ref", "start"), "run").select("ref", "start", "bp")


@query(f"WITH {ALLELES} SELECT DISTINCT sample FROM al")
def allele_samples(spark, sf_dir):
    return alleles.samples(projected(spark, sf_dir)[0])


# ---------------------------------------------------------------- layouts

LAYOUT = ALLELES + """,
width AS (SELECT CAST(MAX(so + len) - MIN(so) AS DOUBLE) * 0.015 AS least FROM bb),
pos AS (
    SELECT id, CAST(so AS DOUBLE) AS x0, CAST(so + len AS DOUBLE) AS x1 FROM bb
    UNION ALL
    SELECT m.id, al.start + m.pos * (GREATEST(CAST(al.stop - al.start AS DOUBLE), w.least) / al.total), al.start + (m.pos + m.len) * (GREATEST(CAST(al.stop - al.start AS DOUBLE), w.least) / al.total)
    FROM members m JOIN al ON al.contig = m.contig AND al.bno = m.bno, width w
    UNION ALL
    SELECT m.id, CAST(COALESCE(e.so + e.len, x.so + x.len) AS DOUBLE) + (k - 1) * w.least, CAST(COALESCE(e.so + e.len, x.so + x.len) AS DOUBLE) + k * w.least
    FROM (SELECT m.*, CASE WHEN bno >= 1 THEN place ELSE members - place + 1 END AS k FROM members m) m
    LEFT JOIN bb e ON e.contig = m.contig AND e.bno = m.bno LEFT JOIN bb x ON x.contig = m.contig AND x.bno = m.bno + 1 + m.bno % 3, width w
    WHERE (e.pk IS NULL) <> (x.pk IS NULL)
),
ranks AS (SELECT rank, DENSE_RANK() OVER (ORDER BY rank) - 1 AS row FROM (SELECT DISTINCT rank FROM seg) d),
srows AS (SELECT sample, ROW_NUMBER() OVER (ORDER BY bp DESC, sample) AS row FROM (SELECT split_part(sn, '#', 1) AS sample, SUM(len) AS bp FROM seg WHERE rank > 0 GROUP BY 1) s)"""


def rounded(df):
    return df.withColumns({"x0": F.round("x0", 4), "x1": F.round("x1", 4)})


@query(f"WITH {LAYOUT} SELECT p.id AS node_id, round(x0, 4) AS x0, round(x1, 4) AS x1, CAST(r.row * 20 AS BIGINT) AS y FROM pos p JOIN seg s ON p.id = s.id JOIN ranks r ON r.rank = s.rank")
def anchored_layout(spark, sf_dir):
    return rounded(layout.anchored_layout(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)))


@query(f"WITH {LAYOUT} SELECT p.id AS node_id, round(x0, 4) AS x0, round(x1, 4) AS x1, CAST(CASE WHEN s.rank = 0 THEN 0 ELSE r.row * 20 END AS BIGINT) AS y FROM pos p JOIN seg s ON p.id = s.id LEFT JOIN srows r ON r.sample = split_part(s.sn, '#', 1)")
def sample_row_layout(spark, sf_dir):
    return rounded(layout.sample_row_layout(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)))


@query(f"WITH {LAYOUT} SELECT CASE WHEN rank = 0 THEN 'Reference (rank 0)' ELSE concat('Rank ', rank) END AS label, CAST(row * 20 AS BIGINT) AS y FROM ranks")
def row_labels(spark, sf_dir):
    return layout.rank_labels(layout.rank_rows(fx.nodes(spark, sf_dir)))


@query(f"WITH {LAYOUT} SELECT 'REF' AS label, CAST(0 AS BIGINT) AS y UNION ALL SELECT sample, CAST(row * 20 AS BIGINT) FROM srows")
def sample_labels(spark, sf_dir):
    nodes = fx.nodes(spark, sf_dir)
    return layout.sample_labels(nodes, layout.sample_rows(nodes))


@query()
def force_layout(spark, sf_dir):
    return fx.kept(spark, sf_dir, "force-layout", lambda: force.force_layout(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), quality=0))


@query(
    f"""WITH {fx.SEG}, d AS (SELECT contig, GREATEST(len * (SELECT GREATEST(COUNT(*) * 40, 500) / (SUM(len) / 1000000.0::DOUBLE) FROM seg) / 1000000, 5) AS drawn FROM seg)
    SELECT COUNT(*) AS nodes, COUNT(*) AS finite, CAST(SUM(ceil(drawn / 20) + 1) AS BIGINT) AS points, COUNT(DISTINCT contig) AS components, CAST(0 AS BIGINT) AS meeting FROM d"""
)
def force_invariants(spark, sf_dir):
    """All nodes placed at finite points, as many as their drawn lengths ask for, and no two boxes of components nearer than their distance."""
    drawn = force_layout(spark, sf_dir)
    sound = F.forall("points", lambda p: (F.abs(p["x"]) < 1e12) & (F.abs(p["y"]) < 1e12)) & (F.size("points") > 1)
    of = drawn.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(sound, 1)).alias("finite"), F.sum(F.size("points")).alias("points"), F.count_distinct("component").alias("components"))
    return of.join(F.broadcast(force.boxes_meeting(drawn)))  # one row each


@query(f"WITH {fx.SEG} SELECT round(GREATEST(COUNT(*) * 40, 500) / (SUM(len) / 1000000.0), 4) AS node_length_per_megabase, CAST(5 AS DOUBLE) AS minimum_node_length, CAST(5 AS BIGINT) AS edge_length, CAST(20 AS BIGINT) AS node_segment_length FROM seg")
def drawn_scale(spark, sf_dir):
    return layout.drawn_scale(fx.nodes(spark, sf_dir)).withColumn("node_length_per_megabase", F.round("node_length_per_megabase", 4))


@query(f"WITH {fx.SEG}, m AS (SELECT AVG(len) AS bp, GREATEST(COUNT(*) * 40, 500) / CAST(COUNT(*) AS DOUBLE) AS drawn FROM seg) SELECT id AS node_id, CAST(floor(GREATEST(drawn * ((pow(len / bp, 0.5) - 1) * 0.5 + 1), 5.0) * 1000 + 0.5) AS BIGINT) AS length FROM seg, m")
def drawn_lengths(spark, sf_dir):
    return layout.drawn_lengths(fx.nodes(spark, sf_dir), "compress")


# ---------------------------------------------------------------- colours, labels, places


@query(f"WITH {fx.SEG} SELECT CAST(1 AS DOUBLE) AS min_depth, CAST(1 AS DOUBLE) AS max_depth, MIN(len) AS min_length, MAX(len) AS max_length, MAX(rank) AS max_rank, COUNT(*) AS nodes FROM seg")
def color_range(spark, sf_dir):
    return colors.color_range(fx.nodes(spark, sf_dir))


@query(f"WITH {fx.SEG}, r AS (SELECT MIN(len) AS a, MAX(len) AS b FROM seg) SELECT id AS node_id, round(CAST(len - a AS DOUBLE) / (b - a), 9) AS share FROM seg, r")
def color_by_length(spark, sf_dir):
    return colors.node_colors(fx.nodes(spark, sf_dir), "node-length").withColumn("share", F.round("share", 9))


@query(f"WITH {NEAR}, m AS (SELECT node_id, (start + stop) / 2.0 AS v FROM spans), r AS (SELECT MIN(v) AS a, MAX(v) AS b FROM m) SELECT s.id AS node_id, CASE WHEN s.rank = 0 THEN round((v - a) / (b - a), 9) END AS share FROM seg s LEFT JOIN m ON m.node_id = s.id, r")
def color_by_position(spark, sf_dir):
    return colors.node_colors(fx.nodes(spark, sf_dir), "reference-position", span_rows(spark, sf_dir)).withColumn("share", F.round("share", 9))


def hue_sql(name: str) -> str:
    """The rolling hash of a name as a hue."""
    wrapped = "(((h % 4294967296 + 4294967296) % 4294967296) * 32 + 2147483648) % 4294967296 - 2147483648"
    return f"abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({name}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, c: c + ({wrapped}) - h) % 360)"


def channel_sql(n: int, hue: str, saturation: float) -> str:
    k = f"(({n}.0 + ({hue}) / 30.0::DOUBLE) % 12.0::DOUBLE)"
    return f"CAST(floor((0.5::DOUBLE - {saturation}::DOUBLE / 2 * GREATEST(-1.0::DOUBLE, LEAST({k} - 3.0, 9.0 - {k}, 1.0::DOUBLE))) * 255 + 0.5) AS BIGINT)"


def hsl_sql(hue: str, saturation: float = 0.7) -> str:
    r, g, b = (channel_sql(n, hue, saturation) for n in (0, 8, 4))
    return f"{r} + {g} * 256 + {b} * 65536 + 4278190080"


def flat_sql(rgb: tuple[int, int, int]) -> str:
    return f"CAST({rgb[0] + rgb[1] * 256 + rgb[2] * 65536 + 255 * 16777216} AS BIGINT)"


def gradient_sql(share: str, stops) -> str:
    at = f"LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, {share})) * {len(stops) - 1}"
    step = f"CAST(LEAST({len(stops) - 2}, floor({at})) AS INTEGER)"

    def channel(k: int) -> str:
        values = "[" + ", ".join(f"{float(s[k])}::DOUBLE" for s in stops) + "]"
        return f"CAST(floor({values}[{step} + 1] + ({values}[{step} + 2] - {values}[{step} + 1]) * ({at} - {step}) + 0.5) AS BIGINT)"

    return f"{channel(0)} + {channel(1)} * 256 + {channel(2)} * 65536 + 4278190080"


@query(f"WITH {fx.SEG}, h AS (SELECT id AS node_id, {hue_sql('id')} AS hue FROM seg) SELECT node_id, {channel_sql(0, 'hue', 0.7)} AS r, {channel_sql(8, 'hue', 0.7)} AS g, {channel_sql(4, 'hue', 0.7)} AS b FROM h")
def color_by_name(spark, sf_dir):
    return colors.node_rgb(colors.node_colors(fx.nodes(spark, sf_dir), "random")).select("node_id", "rgb.r", "rgb.g", "rgb.b")


PAINTED = {
    "uniform": f"WITH {fx.SEG} SELECT id AS node_id, {flat_sql(colors.PLAIN)} AS color FROM seg",
    "grey": f"WITH {fx.SEG} SELECT id AS node_id, {flat_sql(colors.GREY)} AS color FROM seg",
    "random": f"WITH {fx.SEG}, h AS (SELECT id, {hue_sql('id')} AS hue FROM seg) SELECT id AS node_id, {hsl_sql('hue')} AS color FROM h",
    "rainbow": f"WITH {fx.SEG}, h AS (SELECT id, (ROW_NUMBER() OVER (ORDER BY pk) - 1)::DOUBLE / (SELECT COUNT(*) FROM seg) * 360 AS hue FROM seg) SELECT id AS node_id, {hsl_sql('hue', 0.75)} AS color FROM h",
    "depth": f"WITH {fx.SEG}, {fx.STEPS}, d AS (SELECT s.id, CAST(GREATEST(COUNT(t.segment), 1) AS DOUBLE) AS depth FROM seg s LEFT JOIN steps t ON s.id = t.segment GROUP BY s.id), r AS (SELECT MIN(depth) AS a, MAX(depth) AS b FROM d) SELECT id AS node_id, {gradient_sql('(depth - a) / (b - a)', colors.DEPTH_STOPS)} AS color FROM d, r",
    "node-length": f"WITH {fx.SEG}, r AS (SELECT CAST(MIN(len) AS DOUBLE) AS a, CAST(MAX(len) AS DOUBLE) AS b FROM seg) SELECT id AS node_id, {gradient_sql('(len - a) / (b - a)', colors.LENGTH_STOPS)} AS color FROM seg, r",
    "stable-rank": f"WITH {fx.SEG}, r AS (SELECT MAX(rank) AS m FROM seg) SELECT id AS node_id, CASE WHEN rank = 0 THEN {flat_sql(colors.PLAIN)} ELSE {gradient_sql('CAST(rank - 1 AS DOUBLE) / (m - 1)', colors.RANK_STOPS)} END AS color FROM seg, r",
    "reference-position": f"WITH {NEAR} SELECT s.id AS node_id, CASE WHEN p.node_id IS NULL THEN {flat_sql(colors.GREY)} WHEN s.rank > 0 THEN {flat_sql(colors.OFF_RAMP)} ELSE {hsl_sql('LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, ((p.start + p.stop) / 2.0::DOUBLE - 100) / 2400)) * 300.0::DOUBLE')} END AS color FROM seg s LEFT JOIN spans p ON p.node_id = s.id",
}


def paint(scheme: str) -> None:
    def run(spark, sf_dir):
        nodes = fx.nodes(spark, sf_dir)
        if scheme == "depth":
            depth = fx.steps(spark, sf_dir).groupBy(F.col("segment").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("_depth"))
            nodes = nodes.join(depth, "name", "left").withColumn("depth", F.coalesce("_depth", F.lit(1.0))).drop("_depth")
        spans_of = span_rows(spark, sf_dir) if scheme == "reference-position" else None
        return colors.painted(nodes, scheme, spans_of, REGION[1:])

    run.__name__ = "paint_" + scheme.replace("-", "_")
    query(PAINTED[scheme])(run)


for scheme_ in PAINTED:
    paint(scheme_)


@query(f"WITH {NEAR} SELECT CAST(MIN(start + stop) AS DOUBLE) / 2 AS low, CAST(MAX(start + stop) AS DOUBLE) / 2 AS high FROM spans")
def ramp_legend(spark, sf_dir):
    return colors.ramp_domain(span_rows(spark, sf_dir))


@query(
    f"""WITH {fx.STEPS}, p AS (SELECT DISTINCT phase, rec_no, name FROM steps)
    SELECT phase, rec_no, name, concat(name, ' @0') AS label, round((ROW_NUMBER() OVER (ORDER BY phase, rec_no) - 1) * 360.0 / (SELECT COUNT(*) FROM p), 9) AS hue FROM p"""
)
def path_legend(spark, sf_dir):
    paths = fx.steps(spark, sf_dir).select("phase", "rec_no", "full_name").distinct()
    return colors.path_legend(paths).withColumn("hue", F.round("hue", 9))


@query(
    f"""WITH {fx.STEPS}, p AS (SELECT DISTINCT rec_no, name FROM steps WHERE phase = 1)
    SELECT rec_no, split_part(name, '#', 1) AS label, round((ROW_NUMBER() OVER (ORDER BY rec_no) - 1) * 360.0 / (SELECT COUNT(*) FROM p), 9) AS hue FROM p"""
)
def walk_legend(spark, sf_dir):
    """The legend of the W records, whose samples tell them apart."""
    walks = fx.steps(spark, sf_dir).where("phase = 1").select("phase", "rec_no", "full_name").distinct()
    return colors.path_legend(walks).select("rec_no", "label", F.round("hue", 9).alias("hue"))


def one_decimal_sql(n: str, unit: int) -> str:
    return f"CASE WHEN {n} % {unit} = {unit // 4} THEN concat({n} // {unit}, '.3') ELSE regexp_replace(printf('%.1f', {n} / {unit}.0::DOUBLE), '\\.0$', '') END"


def format_bp_sql(n: str) -> str:
    return f"CASE WHEN {n} >= 1000000 THEN concat({one_decimal_sql(n, 1000000)}, ' Mb') WHEN {n} >= 1000 THEN concat({one_decimal_sql(n, 1000)}, ' kb') ELSE concat({n}, ' bp') END"


@query(f"WITH {fx.SEG}, b AS (SELECT id, pk * pk * len * 50 AS bp FROM seg) SELECT id, bp, {format_bp_sql('bp')} AS label FROM b")
def format_bp(spark, sf_dir):
    bp = F.col("rec_no") * F.col("rec_no") * F.col("length") * 50
    return fx.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), bp.alias("bp"), naming.format_bp(bp).alias("label"))


@query(f"WITH {fx.SEG}, b AS (SELECT id, sn, so * 1000 AS a, (so + len) * 1000 AS b FROM seg) SELECT id, concat(sn, ':', a + 1, '-', b) AS loc, concat(sn, ':', format('{{:,}}', a), '-', format('{{:,}}', b)) AS label FROM b")
def range_labels(spark, sf_dir):
    """Places of segments, in bases of a thousandth."""
    a, b = F.col("so") * 1000, (F.col("so") + F.col("length")) * 1000
    return fx.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), naming.locstring(F.col("sn"), a, b).alias("loc"), naming.region_label(F.col("sn"), a, b).alias("label"))


def brightened_sql(color: str, factor: float) -> str:
    up = [f"LEAST(255, CAST(floor((({color} >> {8 * k}) & 255) * {factor}::DOUBLE + 0.5) AS BIGINT))" for k in range(3)]
    return f"{up[0]} + ({up[1]} << 8) + ({up[2]} << 16) + ((({color} >> 24) & 255) << 24)"


@query(f"WITH {fx.SEG}, c AS (SELECT id, (pk * 2654435761) % 4294967296 AS color FROM seg) SELECT id, color, {brightened_sql('color', 1.4)} AS bright FROM c")
def brightened_colors(spark, sf_dir):
    color = F.col("rec_no") * 2654435761 % 4294967296
    return fx.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), color.alias("color"), naming.brighten(color, 1.4).alias("bright"))


@query(
    f"""WITH {fx.SEG}, q AS (SELECT pk AS point_id, contig, CAST(pk * 3 AS DOUBLE) AS px, CAST(pk % 7 - 3 AS DOUBLE) AS py FROM seg),
    d AS (SELECT point_id, id, sqrt(power(GREATEST(so - px, px - (so + len), 0), 2) + power(py, 2)) AS distance FROM q JOIN seg ON q.contig = seg.contig),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY distance, id) AS n FROM d WHERE distance < 5)
    SELECT point_id, id AS node_id, round(distance, 9) AS distance FROM r WHERE n = 1"""
)
def nearest_node(spark, sf_dir):
    nodes = fx.nodes(spark, sf_dir)
    row = (F.col("rec_no") % 4 * 1000).cast("double")  # each sequence on a row of its own, out of reach of the others
    drawn = nodes.select("node_id", F.col("so").cast("double").alias("x0"), (F.col("so") + F.col("length")).cast("double").alias("x1"), row.alias("y"))
    points = nodes.select(F.col("rec_no").alias("point_id"), (F.col("rec_no") * 3).cast("double").alias("px"), (row + F.col("rec_no") % 7 - 3).alias("py"))
    return spatial.nearest_nodes(points, drawn, 5.0, 64.0, 20.0).withColumn("distance", F.round("distance", 9))


# ---------------------------------------------------------------- edges of a drawing


# Heights by a square: two skipped points are then seldom as far from a chord on both its sides (1 of 121 arcs at sf0.01); the first decides.
EDGES = DELETIONS + """,
drawn AS (SELECT id, CAST(so AS DOUBLE) AS x0, CAST(so + len AS DOUBLE) AS x1, CAST(pk * pk % 101 AS DOUBLE) / 2 AS y FROM seg),
ends AS (SELECT l.rec_no AS edge_no, a.x0 AS ax0, a.x1 AS ax1, a.y AS fy, b.x0 AS bx0, b.x1 AS bx1, b.y AS ty FROM lnk l JOIN drawn a ON a.id = l.source JOIN drawn b ON b.id = l.target),
sided AS (SELECT *, GREATEST(0, bx0 - ax1, ax1 - bx1) <= GREATEST(0, bx0 - ax0, ax0 - bx1) AS f_last, GREATEST(0, ax0 - bx1, bx1 - ax1) < GREATEST(0, ax0 - bx0, bx0 - ax1) AS t_last FROM ends),
met AS (SELECT edge_no, CASE WHEN f_last THEN ax1 ELSE ax0 END AS fx, fy, CASE WHEN f_last THEN 1 ELSE -1 END AS fv, CASE WHEN t_last THEN bx1 ELSE bx0 END AS tx, ty, CASE WHEN t_last THEN 1 ELSE -1 END AS tv FROM sided),
chord AS (SELECT *, sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy)) AS d FROM met),
aimed AS (SELECT *, CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE (tx - fx) / d END AS ux, CASE WHEN d = 0 THEN 0.0::DOUBLE ELSE (ty - fy) / d END AS uy FROM chord),
skipped AS (SELECT d.edge_no, b.id, b.so FROM del d JOIN bb b ON b.sn = d.ref AND b.so >= d.start AND b.so < d.stop AND b.so + b.len <= d.stop WHERE d.stop - d.start >= 1),
passed AS (SELECT k.edge_no, k.so, w.x0 AS x, w.y FROM skipped k JOIN drawn w ON w.id = k.id UNION ALL SELECT k.edge_no, k.so, w.x1, w.y FROM skipped k JOIN drawn w ON w.id = k.id),
beside AS (SELECT p.edge_no, p.so, p.x, (p.y - fy) * ux - (p.x - fx) * uy AS off, (p.x - fx) * ux + (p.y - fy) * uy AS along FROM passed p JOIN aimed m ON m.edge_no = p.edge_no),
far AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY edge_no ORDER BY abs(off) DESC, so, x) AS n FROM beside),
bow AS (SELECT edge_no, MAX(CASE WHEN n = 1 THEN off END) AS reach, MAX(along) - MIN(along) AS span FROM far GROUP BY edge_no),
bent AS (SELECT m.*, COALESCE(CASE WHEN reach < 0 THEN -1 ELSE 1 END * GREATEST(abs(reach) * 1.15 / 0.75, span * 0.35), 0) AS bulge FROM aimed m LEFT JOIN bow b ON b.edge_no = m.edge_no)"""


def drawn_nodes(spark, sf_dir):
    def at(x):
        return F.struct(x.cast("double").alias("x"), (F.col("rec_no") * F.col("rec_no") % 101).cast("double").alias("y"))

    return fx.nodes(spark, sf_dir).select("node_id", F.array(at(F.col("so")), at(F.col("so") + F.col("length"))).alias("points"))


def drawn_curves(spark, sf_dir):
    """Curves where a unit of y is half a unit of x, deletions around what they skip."""
    nodes, links = fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)
    skipped = spans.bypassed(spans.deletion_edges(nodes, links), nodes)
    return edges.edge_curves(links, drawn_nodes(spark, sf_dir), 2.0, 1.0, skipped)


@query(
    f"""WITH {EDGES} SELECT edge_no, round(fx, 3) + 0 AS x0, round(fy * 2, 3) + 0 AS y0, round(tx, 3) + 0 AS x3, round(ty * 2, 3) + 0 AS y3,
    round(fx + fv * GREATEST(0, LEAST(d * 0.5, 80, (tx - fx) * fv * 0.5)) - uy * bulge - ux * abs(bulge), 3) + 0 AS x1, round((fy + ux * bulge - uy * abs(bulge)) * 2, 3) + 0 AS y1,
    round(tx + tv * GREATEST(0, LEAST(d * 0.5, 80, (fx - tx) * tv * 0.5)) - uy * bulge + ux * abs(bulge), 3) + 0 AS x2, round((ty + ux * bulge + uy * abs(bulge)) * 2, 3) + 0 AS y2 FROM bent"""
)
def edge_curves(spark, sf_dir):
    first = F.get("curves", F.lit(0))
    return drawn_curves(spark, sf_dir).select("edge_no", *[(F.round(first[n], 3) + 0.0).alias(n) for n in NAMES])


@query(
    f"""WITH {EDGES},{fx.STEPS},{CLAIMED},{NAMED_EDGES},
    w AS (SELECT s.*, sqrt((bx0 - ax1) * (bx0 - ax1) + (ty - fy) * (ty - fy)) AS d, n.paths FROM ends s JOIN named n ON n.edge_no = s.edge_no),
    v AS (SELECT edge_no, paths, CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE (bx0 - ax1) / d END AS vx, CASE WHEN d = 0 THEN 0.0::DOUBLE ELSE (ty - fy) / d END AS vy FROM w),
    z AS (SELECT *, UNNEST(range(paths)) AS path_no FROM v)
    SELECT edge_no, CAST(path_no AS INT) AS path_no, round(-vy * (path_no - (paths - 1) / 2.0::DOUBLE) * 3, 3) + 0 AS dx, round(vx * (path_no - (paths - 1) / 2.0::DOUBLE) * 3 * 2, 3) + 0 AS dy FROM z"""
)
def edge_ribbons(spark, sf_dir):
    """A ribbon for each path that takes an edge."""
    links, steps = fx.links(spark, sf_dir), fx.steps(spark, sf_dir)
    paths = convert.edges(links, convert.canonical_strands(links, steps), steps).select("edge_no", "path_ids")
    found = edges.ribbon_offsets(fx.edges(spark, sf_dir).join(paths, "edge_no"), drawn_nodes(spark, sf_dir), 2.0, 1.0)
    each = found.select("edge_no", F.posexplode("offsets").alias("path_no", "by"))
    return each.select("edge_no", "path_no", (F.round("by.x", 3) + 0.0).alias("dx"), (F.round("by.y", 3) + 0.0).alias("dy"))


# Control points in units of x, and the boxes that hold them.
CONTROLS = EDGES + """,
cp AS (
    SELECT edge_no, fx AS x0, fy AS y0, tx AS x3, ty AS y3,
           fx + fv * GREATEST(0, LEAST(d * 0.5, 80, (tx - fx) * fv * 0.5)) - uy * bulge - ux * abs(bulge) AS x1, fy + ux * bulge - uy * abs(bulge) AS y1,
           tx + tv * GREATEST(0, LEAST(d * 0.5, 80, (fx - tx) * tv * 0.5)) - uy * bulge + ux * abs(bulge) AS x2, ty + ux * bulge + uy * abs(bulge) AS y2
    FROM bent
),
box AS (
    SELECT *, LEAST(x0, x1, x2, x3) AS min_x, GREATEST(x0, x1, x2, x3) AS max_x, LEAST(y0, y1, y2, y3) AS min_y, GREATEST(y0, y1, y2, y3) AS max_y FROM cp
)"""


@query(f"WITH {CONTROLS} SELECT round(GREATEST(1, SUM(max_x - min_x) / COUNT(*)), 3) AS cell_x, round(GREATEST(1, SUM((max_y - min_y) * 2) / COUNT(*)), 3) AS cell_y FROM box")
def edge_cell_size(spark, sf_dir):
    """The first cell of the grid over all edges."""
    return edges.cell_size(edges.curve_boxes(drawn_curves(spark, sf_dir))).select(F.round("cell_x", 3).alias("cell_x"), F.round("cell_y", 3).alias("cell_y"))


@query(f"WITH {CONTROLS} SELECT edge_no FROM box WHERE max_x >= 100 AND min_x <= 2500 AND max_y * 2 >= 10.25 AND min_y * 2 <= 60.25")
def edges_in_view(spark, sf_dir):
    return edges.edges_in_view(drawn_curves(spark, sf_dir), 100, 10.25, 2500, 60.25).select("edge_no")


@query(
    f"""WITH {CONTROLS}, pt AS (SELECT pk AS point_id, CAST(pk * 3 AS DOUBLE) AS px, (pk % 29) * 7 * 0.5::DOUBLE AS py FROM seg),
    m AS (SELECT p.*, b.* FROM pt p JOIN box b ON px BETWEEN min_x - 5 AND max_x + 5 AND py BETWEEN min_y - 5 AND max_y + 5),
    t AS (SELECT *, UNNEST(range(21)) / 20.0::DOUBLE AS t FROM m),
    d AS (
        SELECT point_id, edge_no, MIN(sqrt(power(x0 * (1 - t) * (1 - t) * (1 - t) + 3 * x1 * (1 - t) * (1 - t) * t + 3 * x2 * (1 - t) * t * t + x3 * t * t * t - px, 2)
                                         + power(y0 * (1 - t) * (1 - t) * (1 - t) + 3 * y1 * (1 - t) * (1 - t) * t + 3 * y2 * (1 - t) * t * t + y3 * t * t * t - py, 2))) AS distance
        FROM t GROUP BY point_id, edge_no
    ),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY distance, edge_no) AS n FROM d WHERE distance < 5)
    SELECT point_id, edge_no, round(distance, 6) AS distance FROM r WHERE n = 1"""
)
def nearest_edge(spark, sf_dir):
    points = fx.nodes(spark, sf_dir).select(F.col("rec_no").alias("point_id"), (F.col("rec_no") * 3).cast("double").alias("px"), (F.col("rec_no") % 29 * 7).cast("double").alias("py"))
    return edges.nearest_edges(points, drawn_curves(spark, sf_dir), 2.0, 1.0).withColumn("distance", F.round("distance", 6))


def side_sql(a: int, b: int) -> str:
    size = f"sqrt(power(x{b} - x{a}, 2) + power((y{b} - y{a}) * 0.5, 2))"
    return f"-(y{b} - y{a}) * 0.5 / {size} AS n{a}x, (x{b} - x{a}) / {size} AS n{a}y"


@query(
    f"""WITH {fx.SEG}, p AS (SELECT id, CAST(so AS DOUBLE) AS x0, CAST(pk % 7 * 20 AS DOUBLE) AS y0, so + len / 2.0::DOUBLE AS x1, CAST(pk % 11 * 20 AS DOUBLE) AS y1, CAST(so + len AS DOUBLE) AS x2, CAST(pk % 5 * 20 AS DOUBLE) AS y2 FROM seg),
    s AS (SELECT *, {side_sql(0, 1)}, {side_sql(1, 2)} FROM p),
    m AS (SELECT *, (n0x + n1x) / 2 AS mx, (n0y + n1y) / 2 AS my FROM s),
    d AS (SELECT *, CASE WHEN n0x * mx + n0y * my > 0.1 THEN n0x * mx + n0y * my ELSE 1 END AS d FROM m)
    SELECT id AS node_id, round(x0 + n0x * 3, 6) AS x0, round(y0 + n0y * 3 / 0.5, 6) AS y0, round(x1 + mx / d * 3, 6) AS x1, round(y1 + my / d * 3 / 0.5, 6) AS y1, round(x2 + n1x * 3, 6) AS x2, round(y2 + n1y * 3 / 0.5, 6) AS y2 FROM d"""
)
def offset_lines(spark, sf_dir):
    """Nodes drawn with a bend, moved sideways by three units where a unit of y is half of one of x."""
    def at(x, k):
        return F.struct(x.cast("double").alias("x"), (F.col("rec_no") % k * 20).cast("double").alias("y"))

    so, length = F.col("so"), F.col("length")
    points = F.array(at(so, 7), at(so + length / 2, 11), at(so + length, 5))
    moved = fx.nodes(spark, sf_dir).select("node_id", curves.shifted(points, 3.0, 0.5).alias("p"))
    return moved.select("node_id", *[F.round(F.col("p")[k][c], 6).alias(f"{c}{k}") for k in range(3) for c in "xy"])


@query(
    f"""WITH RECURSIVE {fx.GRAPH},
    ord AS (SELECT pk, ROW_NUMBER() OVER (ORDER BY pk) AS n, CAST(len AS DOUBLE) AS drawn FROM seg),
    pairs_once AS (SELECT spk, tpk, MIN(rec_no) AS rec_no FROM lnk GROUP BY spk, tpk),
    up AS (SELECT b.n, list(a.n ORDER BY p.rec_no) AS ups FROM pairs_once p JOIN ord a ON a.pk = p.spk JOIN ord b ON b.pk = p.tpk GROUP BY b.n),
    into_n AS (SELECT o.n, o.drawn, COALESCE(u.ups[1] < o.n, FALSE) AS led, COALESCE(list_filter(u.ups, lambda x: x < o.n), []) AS ups FROM ord o LEFT JOIN up u ON u.n = o.n),
    walked AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS ends
        UNION ALL
        SELECT w.n + 1, list_append(w.ends, drawn + 5 + CASE WHEN len(i.ups) = 0 THEN COALESCE(w.ends[-1], 0) WHEN led THEN list_max(list_transform(i.ups, lambda x: w.ends[x]))
                                                     ELSE GREATEST(COALESCE(w.ends[-1], 0), list_max(list_transform(i.ups, lambda x: w.ends[x]))) END)
        FROM walked w JOIN into_n i ON i.n = w.n + 1
    ),
    e AS (SELECT UNNEST(ends) AS x1, UNNEST(range(1, len(ends) + 1)) AS n FROM walked WHERE n = (SELECT MAX(n) FROM ord)),
    s AS (SELECT o.pk, o.n, e.x1 - o.drawn AS x0, e.x1 FROM e JOIN ord o ON o.n = e.n)
    SELECT concat('s', pk) AS node_id, x0, x1, CAST((ROW_NUMBER() OVER (PARTITION BY x0 ORDER BY n) - 1) * 5 AS DOUBLE) AS y FROM s"""
)
def linear_seeds(spark, sf_dir):
    """Seeds of nodes under the numbers of their parts, drawn as long as they are."""
    named = fx.nodes(spark, sf_dir).select("node_id", F.col("rec_no").cast("string").alias("name"), F.col("length").alias("drawn"))
    return seeds.linear_seeds(named, fx.edges(spark, sf_dir), 5.0)


# ---------------------------------------------------------------- ancestry

ANCESTRY = fx.SEG + """,
idx AS (SELECT pk, concat('H', CAST(pk * pk % 97 AS VARCHAR)) AS sample, CAST(pk % 2 + 1 AS VARCHAR) AS haplotype, concat('s3://b/', id, CASE WHEN pk % 3 = 0 THEN ',x' ELSE '' END) AS location, contig, so, so + len AS stop, id FROM seg),
firsts AS (SELECT sample, MIN(pk) AS spot FROM idx GROUP BY sample),
others AS (SELECT sample, ROW_NUMBER() OVER (ORDER BY spot) AS n, COUNT(*) OVER () AS total FROM firsts WHERE sample NOT IN ('H1', 'H4')),
picked AS (
    SELECT sample FROM firsts WHERE sample IN ('H1', 'H4')
    UNION ALL SELECT sample FROM others, (SELECT 12 - COUNT(*) AS need FROM firsts WHERE sample IN ('H1', 'H4')) w
    WHERE floor(n / (total / need::DOUBLE)) <> floor((n - 1) / (total / need::DOUBLE))
)"""


def ancestry_index(spark, sf_dir):
    """The index from text with a header, carriage returns and lines of unequal length."""
    def lines():
        at = F.col("rec_no")
        tail = F.when(at % 3 == 0, ",x").otherwise("")
        rows = fx.segments(spark, sf_dir).select(at, F.concat(F.lit("H"), at * at % 97, F.lit(","), at % 2 + 1, F.lit(",asm,s3://b/"), "id", tail, F.lit("\r")).alias("value"))
        head = spark.createDataFrame([(-1, "sample_id,haplotype,assembly,location\r")], "rec_no long, value string")
        return head.unionByName(rows).repartitionByRange("rec_no").sortWithinPartitions("rec_no").select("value")

    return ancestry.read_index(spark, fx.stored(spark, sf_dir, "ancestry-index", lines, text=True))


@query(f"WITH {ANCESTRY} SELECT sample FROM picked")
def ancestry_samples(spark, sf_dir):
    return ancestry.spread_samples(ancestry_index(spark, sf_dir), ["H1", "H4", "absent"], 12)


@query(
    f"""WITH {ANCESTRY} SELECT contig AS chrom, so AS start, stop, id AS name, '0' AS score, '.' AS strand, so AS thick_start, stop AS thick_end, '1,2,3' AS rgb, concat(sample, '.h', haplotype) AS sample
    FROM idx WHERE contig = 'chr1' AND sample IN (SELECT sample FROM picked)"""
)
def ancestry_rows(spark, sf_dir):
    index = ancestry_index(spark, sf_dir)
    rows = fx.segments(spark, sf_dir).select(
        F.concat(F.lit("s3://b/"), "id", F.when(F.col("rec_no") % 3 == 0, ",x").otherwise("")).alias("location"), naming.pansn_contig(F.col("sn")).alias("chrom"),
        F.col("so").alias("start"), (F.col("so") + F.col("length")).alias("end"), F.col("id").alias("name"), F.lit("0").alias("score"), F.lit("1,2,3").alias("itemRgb"),
    )
    found = ancestry.projected(index, ancestry.spread_samples(index, ["H1", "H4", "absent"], 12), rows, "chr1")
    return found.withColumnsRenamed({"end": "stop", "thickStart": "thick_start", "thickEnd": "thick_end", "itemRgb": "rgb"})


# ---------------------------------------------------------------- labels

VIEW = labels.View(2.0, 1.0, -100.0, 20.0, 1200.0, 160.0)


@query(f"WITH {LAYOUT}, t AS (SELECT CASE WHEN rank = 0 THEN 'Reference (rank 0)' ELSE concat('Rank ', rank) END AS label, CAST(row * 20 + 20 AS DOUBLE) AS y FROM ranks) SELECT label, 6.0::DOUBLE AS x0, round(17 + length(label) * 6.2::DOUBLE, 6) AS x1, y - 9.5::DOUBLE AS y0, y + 9.5::DOUBLE AS y1 FROM t")
def row_label_boxes(spark, sf_dir):
    boxes = labels.row_label_boxes(layout.rank_labels(layout.rank_rows(fx.nodes(spark, sf_dir))), VIEW)
    return boxes.select("label", F.col("left").alias("x0"), F.round("right", 6).alias("x1"), F.col("top").alias("y0"), F.col("bottom").alias("y1"))


@query(
    f"""WITH {fx.SEG}, t AS (SELECT id, len, {format_bp_sql('len')} AS text, (so + len) * 2.0::DOUBLE - 100 AS x, pk * pk % 101 + 20.0::DOUBLE AS y FROM seg),
    h AS (SELECT *, (length(text) * 5.7::DOUBLE + 9) / 2 AS half FROM t)
    SELECT concat('node:', id) AS key, text, x, y, round(x - half, 6) AS x0, round(x + half, 6) AS x1 FROM h WHERE len * 2 >= half AND y + 8 > 0 AND y - 8 < 160"""
)
def node_label_candidates(spark, sf_dir):
    found = labels.node_candidates(fx.nodes(spark, sf_dir), drawn_nodes(spark, sf_dir), VIEW)
    return found.select("key", "text", "x", "y", F.round("left", 6).alias("x0"), F.round("right", 6).alias("x1"))


@query()
def graph_labels(spark, sf_dir):
    """Labels of deletions, alleles and nodes that keep clear of each other and of the labels of rows."""
    nodes, links, drawn = fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), drawn_nodes(spark, sf_dir)
    deletions, runs = spans.deletion_edges(nodes, links), alleles.allele_deletions(projected(spark, sf_dir)[0])
    arcs = edges.edge_curves(links.join(deletions.select("edge_no"), "edge_no", "left_semi"), drawn, 2.0, 1.0, spans.bypassed(deletions, nodes))
    rows = labels.row_label_boxes(layout.rank_labels(layout.rank_rows(nodes)), VIEW)
    return labels.graph_labels(nodes, drawn, VIEW, deletions, arcs, runs, rows)


# ---------------------------------------------------------------- files


@query(f"WITH {fx.SEG} SELECT id, len AS length, sn, so, rank AS sr FROM seg")
def gfa_file_segments(spark, sf_dir):
    """From GFA text files, through the line reader."""
    return gfa.segments(gfa.read_lines(spark, fx.gfa_file(spark, sf_dir))).select("id", "length", "sn", "so", "sr")


@query(f"WITH {fx.GRAPH} SELECT source, source_strand, target, target_strand FROM lnk")
def gfa_file_links(spark, sf_dir):
    return gfa.links(gfa.read_lines(spark, fx.gfa_file(spark, sf_dir))).select("source", "source_strand", "target", "target_strand")


@query(f"WITH {fx.STEPS} SELECT name, step_no, segment, strand FROM steps")
def gfa_file_steps(spark, sf_dir):
    lines = gfa.read_lines(spark, fx.gfa_file(spark, sf_dir))
    return gfa.exploded(gfa.records(gfa.paths(lines), gfa.walks(lines))).select("name", F.col("step_no").cast("long").alias("step_no"), "segment", "strand")


@query(
    f"""WITH {fx.GRAPH},{fx.STEPS}, p AS (SELECT DISTINCT phase, rec_no, name FROM steps),
    r AS (
        SELECT 0 AS band, pk AS spot, 'S' AS kind, id AS name FROM seg UNION ALL SELECT 1, rec_no, 'L', concat(source, '>', target) FROM lnk
        UNION ALL SELECT 2 + phase, rec_no, CASE WHEN phase = 0 THEN 'P' ELSE 'W' END, name FROM p
    )
    SELECT ROW_NUMBER() OVER (ORDER BY band, spot) - 1 AS rec_no, kind, name FROM r"""
)
def gfa_file_order(spark, sf_dir):
    """All records of a folder of files in one load, with their numbers in file order."""
    graph = gfa.load(spark, fx.gfa_file(spark, sf_dir))
    named = {"S": graph.segments.select("rec_no", F.col("id").alias("name")), "L": graph.links.select("rec_no", F.concat("source", F.lit(">"), "target").alias("name"))}
    named |= {"P": graph.paths.select("rec_no", naming.origin_name(F.col("name")).alias("name")), "W": graph.walks.select("rec_no", F.concat_ws("#", "sample", F.col("haplotype").cast("string"), "contig").alias("name"))}
    each = [rows.select("rec_no", F.lit(kind).alias("kind"), "name") for kind, rows in named.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query(
    f"""WITH {CLAIMS}, t AS (SELECT segment, COUNT(*) AS n FROM steps GROUP BY segment)
    SELECT concat(s.id, COALESCE(c.strand, '+')) AS node_id, CAST(GREATEST(COALESCE(t.n, 1), 1) AS DOUBLE) AS depth, s.len AS length FROM seg s LEFT JOIN canon c ON s.id = c.segment LEFT JOIN t ON s.id = t.segment"""
)
def graph_from_files(spark, sf_dir):
    """Nodes with canonical strands, first claims in file order, from files alone."""
    graph = gfa.load(spark, fx.gfa_file(spark, sf_dir))
    steps = gfa.exploded(gfa.records(graph.paths, graph.walks))
    return convert.nodes(graph.segments, graph.links, steps).select("node_id", "depth", "length")


@query(f"WITH {fx.SEG} SELECT id AS name, CASE WHEN pk % 3 = 0 THEN NULL ELSE concat('S', pk % 7, '|', 'S', pk % 5) END AS samples FROM seg")
def node_carriers(spark, sf_dir):
    """The samples that SM tags of parsed S records name, as nodes carry them."""
    tagged = fx.index(spark, sf_dir)[0].select(F.concat_ws("\t", F.lit("S"), "id", F.lit("*"), F.concat(F.lit("LN:i:"), F.col("end") - F.col("start")), "tags").alias("line"))
    segs = gfa.segments(tagged.withColumn("rec_no", F.lit(0).cast("long")))
    none = fx.links(spark, sf_dir).limit(0)
    return convert.nodes(segs, none, fx.steps(spark, sf_dir).limit(0)).select("name", F.array_join("samples", "|").alias("samples"))


def bed_tables(spark, sf_dir):
    return beds.read_prefix(spark, fx.bed_prefix(spark, sf_dir), compressed=False)


@query(f"WITH {fx.SEGS_BED} SELECT id, ref, start, stop, rank, tags FROM segs WHERE {IN_REGION}")
def bed_segments(spark, sf_dir):
    found = beds.in_region(bed_tables(spark, sf_dir)[0], *REGION)
    return found.select("id", "ref", "start", F.col("end").alias("stop"), "rank", "tags")


@query(f"WITH {LINK_ROWS} SELECT ref, start, stop, source, target, source_start, target_start, source_rank, target_rank FROM lrows WHERE {IN_REGION}")
def bed_links(spark, sf_dir):
    found = beds.in_region(bed_tables(spark, sf_dir)[1], *REGION)
    return found.select("ref", "start", F.col("end").alias("stop"), "source", "target", "source_start", "target_start", "source_rank", "target_rank")


@query(f"WITH {fx.BUBBLE} SELECT ref, start, stop, segment_count, path_count, inversion, shortest_length, longest_length FROM bubble WHERE {IN_REGION}")
def bed_bubbles(spark, sf_dir):
    rows = beds.read_bed(spark, beds.locations(fx.bed_prefix(spark, sf_dir), compressed=False)["bubbles"], beds.BUBBLES)
    return beds.in_region(rows, *REGION).select("ref", "start", F.col("end").alias("stop"), "segment_count", "path_count", "inversion", "shortest_length", "longest_length")


@query(f"WITH {cut_sql(1)} SELECT id, ref, start, stop, rank FROM k1")
def subgraph_from_bed(spark, sf_dir):
    return cut.subgraph(*bed_tables(spark, sf_dir), *REGION, context=1)[0].select("id", "ref", "start", F.col("end").alias("stop"), "rank")


@query(
    f"""WITH {fx.SEG}, q AS (SELECT DISTINCT 'hg38' AS assembly, contig FROM seg WHERE rank = 0)
    SELECT 'REF' AS assembly, contig, concat('REF#0#', contig) AS ref FROM q"""
)
def refname_of_assembly(spark, sf_dir):
    """Names of an assembly that stable names call otherwise."""
    asked = fx.segments(spark, sf_dir).where("sr = 0").select(F.lit("hg38").alias("assembly"), naming.pansn_contig(F.col("sn")).alias("contig")).distinct()
    return beds.resolve_names(beds.samples_of_assemblies(asked, {"hg38": "REF"}), fx.index(spark, sf_dir)[0])


# ---------------------------------------------------------------- details and views


@query(
    f"""WITH {NEAR}, {fx.STEPS}, c AS (SELECT segment, string_agg(sample, ', ' ORDER BY sample) AS carried_by FROM (SELECT DISTINCT segment, sample FROM steps) x GROUP BY segment)
    SELECT s.id AS node_id, s.len AS length, s.rank, s.sn AS stable_name, split_part(s.sn, '#', 1) AS contributing_assembly, c.carried_by,
           CASE WHEN p.node_id IS NOT NULL THEN 'chr0' END AS ref, CASE WHEN p.node_id IS NOT NULL THEN 'hg38' END AS assembly, p.start, p.stop
    FROM seg s LEFT JOIN c ON c.segment = s.id LEFT JOIN spans p ON p.node_id = s.id"""
)
def node_details(spark, sf_dir):
    carried = anchor.carriage(fx.steps(spark, sf_dir).select("segment", "sample"))
    found = spans.node_details(fx.nodes(spark, sf_dir), span_rows(spark, sf_dir), carried, ("chr0", "hg38"))
    return found.withColumnRenamed("end", "stop").drop("name", "depth")


@query(f"WITH {NEAR} SELECT node_id, 'chr0' AS ref, 'hg38' AS assembly, start, stop FROM spans")
def hover_highlight(spark, sf_dir):
    return spans.highlights(span_rows(spark, sf_dir), "chr0", "hg38").withColumnRenamed("end", "stop")


@query(f"WITH {fx.SEG} SELECT pk AS point_id FROM seg WHERE concat('REF#0#', contig) = '{REGION[0]}' AND pk * 7 BETWEEN {REGION[1]} AND {REGION[2]}")
def hover_in_region(spark, sf_dir):
    points = fx.nodes(spark, sf_dir).select(F.col("rec_no").alias("point_id"), F.concat(F.lit("REF#0#"), naming.pansn_contig(F.col("sn"))).alias("ref"), (F.col("rec_no") * 7).alias("at"))
    return spans.in_hover_region(points, *REGION).select("point_id")


@query(
    f"""WITH {WALK}, v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY CASE WHEN name = 'C7#1#chr' THEN 0 ELSE 1 END, phase, rec_no, step_no) AS n FROM walk),
    c AS (SELECT segment, string_agg(sample, '|' ORDER BY sample) AS samples FROM (SELECT DISTINCT segment, sample FROM walk) d GROUP BY segment)
    SELECT g.id AS node_id, v.name AS sn, CAST(v.spot AS BIGINT) AS so, CASE WHEN v.name IS NULL THEN NULL ELSE CAST(CASE WHEN v.name = 'C7#1#chr' THEN 0 ELSE 1 END AS BIGINT) END AS sr, c.samples
    FROM seg g LEFT JOIN (SELECT * FROM v WHERE n = 1) v ON v.segment = g.id LEFT JOIN c ON c.segment = g.id"""
)
def anchored_nodes(spark, sf_dir):
    """Coordinates and samples from paths on a graph whose nodes state none."""
    bare = fx.nodes(spark, sf_dir).withColumns({"sn": F.lit(None).cast("string"), "so": F.lit(None).cast("long"), "sr": F.lit(None).cast("long"), "samples": F.lit(None).cast("array<string>")})
    found = anchor.anchored_nodes(bare, visits(spark, sf_dir), "C7#1#chr")
    return found.select("node_id", "sn", F.col("so").cast("long").alias("so"), "sr", F.array_join("samples", "|").alias("samples"))


@query(f"WITH {ALLELES} SELECT string_agg(sample, '|' ORDER BY sample) AS samples FROM (SELECT DISTINCT sample FROM al) x")
def allele_sample_list(spark, sf_dir):
    return alleles.sample_list(projected(spark, sf_dir)[0]).select(F.array_join("samples", "|").alias("samples"))


@query(f"WITH {LAYOUT} SELECT round(MIN(x0), 4) AS min_x, round(MAX(x1) - MIN(x0), 4) AS w, CAST(MIN(r.row * 20) AS DOUBLE) AS min_y, CAST(MAX(r.row * 20) - MIN(r.row * 20) AS DOUBLE) AS h FROM pos p JOIN seg s ON p.id = s.id JOIN ranks r ON r.rank = s.rank")
def layout_bounds(spark, sf_dir):
    found = layout.layout_bounds(layout.anchored_layout(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)))
    return found.select(F.round("min_x", 4).alias("min_x"), F.round("w", 4).alias("w"), "min_y", "h")


X_VIEW = "so <= 2500 AND so + len >= 100"


@query(f"WITH {fx.SEG} SELECT id AS node_id FROM seg WHERE {X_VIEW}")
def nodes_in_view(spark, sf_dir):
    drawn = fx.nodes(spark, sf_dir).select("node_id", F.col("so").cast("double").alias("x0"), (F.col("so") + F.col("length")).cast("double").alias("x1"), F.lit(0.0).alias("y"))
    return layout.in_view(drawn, 100, -20, 2500, 20).select("node_id")


@query(
    f"""WITH {fx.STEPS}, r AS (SELECT phase, rec_no, ROW_NUMBER() OVER (ORDER BY phase, rec_no) - 1 AS slot FROM (SELECT DISTINCT phase, rec_no FROM steps) x)
    SELECT segment, string_agg(CAST(slot AS VARCHAR), '|' ORDER BY slot) AS slots FROM (SELECT DISTINCT s.segment, r.slot FROM steps s JOIN r ON s.phase = r.phase AND s.rec_no = r.rec_no) y GROUP BY segment"""
)
def path_slots(spark, sf_dir):
    return layout.path_slots(fx.steps(spark, sf_dir)).select("segment", F.array_join(F.col("slots").cast("array<string>"), "|").alias("slots"))


@query(f"WITH {fx.SEG}, b AS (SELECT id, pk * pk * len * 50 AS bp FROM seg) SELECT id, CASE WHEN bp >= 1000000 THEN concat({one_decimal_sql('bp', 1000000)}, ' Mb') ELSE concat(CAST(floor(bp / 1000.0::DOUBLE + 0.5) AS BIGINT), ' kb') END AS label FROM b")
def format_span_bp(spark, sf_dir):
    bp = F.col("rec_no") * F.col("rec_no") * F.col("length") * 50
    return fx.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), naming.format_span_bp(bp).alias("label"))


@query(f"WITH {LAYOUT} SELECT CAST(LEAST(600, GREATEST(100, MAX(r.row * 20) - MIN(r.row * 20) + 40)) AS DOUBLE) AS height FROM pos p JOIN seg s ON p.id = s.id JOIN ranks r ON r.rank = s.rank")
def pane_height(spark, sf_dir):
    bounds = layout.row_bounds(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))
    return layout.pane_height(bounds, 1200, 100, 600, 20, True)


@query(
    f"""WITH {WALK}, ref AS (SELECT name FROM steps WHERE sample = 'C7' ORDER BY phase, rec_no LIMIT 1),
    v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY CASE WHEN name = (SELECT name FROM ref) THEN 0 ELSE 1 END, phase, rec_no, step_no) AS n FROM walk)
    SELECT g.id AS node_id, v.name AS sn, CAST(v.spot AS BIGINT) AS so, CASE WHEN v.name IS NULL THEN NULL ELSE CAST(CASE WHEN v.name = (SELECT name FROM ref) THEN 0 ELSE 1 END AS BIGINT) END AS sr
    FROM seg g LEFT JOIN (SELECT * FROM v WHERE n = 1) v ON v.segment = g.id"""
)
def graph_anchoring(spark, sf_dir):
    """Coordinates chosen for a graph that states none: by the path that the region's assembly names."""
    bare = fx.nodes(spark, sf_dir).withColumns({"sn": F.lit(None).cast("string"), "so": F.lit(None).cast("long"), "sr": F.lit(None).cast("long"), "samples": F.lit(None).cast("array<string>")})
    found = anchor.anchor_graph(bare, fx.steps(spark, sf_dir), fx.segments(spark, sf_dir), anchor.preferred_path(None, "C7"))
    return found.select("node_id", "sn", F.col("so").cast("long").alias("so"), "sr")


@query(f"WITH {fx.STEPS}, p AS (SELECT DISTINCT phase, rec_no, name FROM steps) SELECT phase, rec_no, name FROM p WHERE (SELECT COUNT(*) FROM p) BETWEEN 1 AND 16")
def path_key(spark, sf_dir):
    """The key of path colours, which so many paths do not get."""
    return colors.path_key(fx.steps(spark, sf_dir).select("phase", "rec_no", "full_name").distinct()).select("phase", "rec_no", "name")


# ---------------------------------------------------------------- the data source, SQL functions


@query(SQL["gfa_file_order"])
def gfa_source_order(spark, sf_dir):
    """All records through the data source, whose numbers grow in file order, numbered densely."""
    rows = numbered(gfa_source.lines(spark, fx.gfa_file(spark, sf_dir)).withColumnRenamed("rec_no", "place"), "place", name="rec_no")
    f = F.split("line", "\t")
    name = F.when(F.col("record") == "L", F.concat(F.get(f, F.lit(1)), F.lit(">"), F.get(f, F.lit(3)))).when(F.col("record") == "W", F.concat_ws("#", *[F.get(f, F.lit(k)) for k in (1, 2, 3)])).otherwise(naming.origin_name(F.get(f, F.lit(1))))
    return rows.select("rec_no", F.col("record").alias("kind"), name.alias("name"))


@query(SQL["graph_from_files"])
def graph_from_source(spark, sf_dir):
    """Nodes with canonical strands from the data source, a scan for each kind of record."""
    graph = gfa_source.load(spark, fx.gfa_file(spark, sf_dir))
    return convert.nodes(graph.segments, graph.links, gfa.exploded(gfa.records(graph.paths, graph.walks))).select("node_id", "depth", "length")


@query(f"WITH {fx.SEG}, b AS (SELECT *, so * len * 50 AS bp FROM seg) SELECT id, len AS length, sn, split_part(sn, '#', 1) AS sample, CAST(split_part(sn, '#', 2) AS BIGINT) AS haplotype, {format_bp_sql('bp')} AS label FROM b")
def sql_functions(spark, sf_dir):
    """Tags, names and labels by the SQL functions of the session, over the data source."""
    register(spark)
    gfa_source.lines(spark, fx.gfa_file(spark, sf_dir), records="S").createOrReplaceTempView("gfa_segment_lines")
    told = "SELECT split(line, '\t')[1] AS id, CAST(gfa_tag(line, 'LN') AS BIGINT) AS length, CAST(gfa_tag(line, 'SO') AS BIGINT) AS so, gfa_tag(line, 'SN') AS sn FROM gfa_segment_lines"
    return spark.sql(f"SELECT id, length, sn, pansn_sample(sn) AS sample, pansn_haplotype(sn) AS haplotype, format_bp(so * length * 50) AS label FROM ({told})")


@query(f"WITH {fx.STEPS} SELECT phase, name, step_no, segment, strand FROM steps")
def sql_steps(spark, sf_dir):
    """Steps of P and W records by the SQL functions of the session."""
    register(spark)
    gfa_source.lines(spark, fx.gfa_file(spark, sf_dir), records="P,W").createOrReplaceTempView("gfa_step_lines")
    told = "SELECT record, split(line, '\t') AS f FROM gfa_step_lines"
    both = f"SELECT 0 AS phase, path_origin_name(get(f, 1)) AS name, gfa_path(get(f, 2)) AS steps FROM ({told}) WHERE record = 'P' UNION ALL SELECT 1, concat_ws('#', get(f, 1), get(f, 2), get(f, 3)), gfa_walk(get(f, 6)) FROM ({told}) WHERE record = 'W'"
    return spark.sql(f"SELECT phase, name, CAST(pos AS BIGINT) AS step_no, col.segment AS segment, col.strand AS strand FROM ({both}) LATERAL VIEW posexplode(steps) AS pos, col")


# ---------------------------------------------------------------- files of several versions, with ids that come again


def odd_graph(spark, sf_dir):
    graph = gfa.load(spark, fx.odd_files(spark, sf_dir))
    return graph, gfa.exploded(gfa.records(graph.paths, graph.walks))


@query(
    f"""WITH {fx.ODD}, t AS (SELECT segment, COUNT(*) AS n FROM psteps GROUP BY segment), r AS (SELECT id, len, tagged FROM odd UNION ALL SELECT id, 9999, NULL FROM seg WHERE pk % 10 = 0)
    SELECT concat(r.id, COALESCE(c.strand, '+')) AS node_id, CAST(r.len AS BIGINT) AS length, CAST(COALESCE(r.tagged, GREATEST(COALESCE(t.n, 1), 1)) AS DOUBLE) AS depth
    FROM r LEFT JOIN canon c ON r.id = c.segment LEFT JOIN t ON r.id = t.segment"""
)
def odd_nodes(spark, sf_dir):
    """Nodes of records of both versions with depth tags, one for each record."""
    graph, steps = odd_graph(spark, sf_dir)
    return convert.nodes(graph.segments, graph.links, steps).select("node_id", "length", "depth")


@query(
    f"""WITH {fx.ODD}, e AS (SELECT 0 AS f, pk AS n, id AS source, concat('x', pk) AS target FROM seg WHERE pk % 20 = 0 UNION ALL SELECT 1, rec_no, source, target FROM lnk)
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY f, n) AS BIGINT) AS place, concat(e.source, a.strand) AS from_id, concat(e.target, b.strand) AS to_id FROM e JOIN canon a ON e.source = a.segment JOIN canon b ON e.target = b.segment"""
)
def odd_edges(spark, sf_dir):
    """Edges in file order, from links of the first version to undeclared segments and edges of the second."""
    graph, steps = odd_graph(spark, sf_dir)
    made = convert.edges(graph.links, convert.canonical_strands(graph.links, steps), steps)
    return numbered(made, "edge_no", name="place").select((F.col("place") + 1).cast("long").alias("place"), "from_id", "to_id")


@query(f"WITH {fx.ODD} SELECT n.name, n.start, CAST(SUM(o.len) AS BIGINT) AS length, COUNT(*) AS steps FROM psteps p JOIN pname n ON p.rec_no = n.rec_no JOIN odd o ON p.segment = o.id GROUP BY p.rec_no, n.name, n.start")
def odd_path_lengths(spark, sf_dir):
    """Paths over segments of which the last of equal ids counts."""
    graph, steps = odd_graph(spark, sf_dir)
    walked = anchor.visits(steps, graph.segments)
    lengths = walked.groupBy("phase", "rec_no").agg(F.count(F.lit(1)).alias("steps"))
    return anchor.origins(steps, graph.segments).join(lengths, ["phase", "rec_no"]).select("name", "start", "length", "steps")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: alleles of the derived graph."""
    return allele_projection(spark, sf_dir)
