"""Subgraph of a region: its segments, the links over it, and hops through newly reached off-reference segments.

A hop is one range join of the frontier with the link table, by bins, rather than a query for each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.beds import in_region
from ..storage import cut as checkpoint

MAX_REGION_BP = 5_000_000
MAX_NODES = 20_000
BIN = 1 << 14
TAG = r"^[A-Za-z][A-Za-z0-9]:[AifZJHB]:"


def ends(links: DataFrame) -> DataFrame:
    """Both ends of each link row as segment rows."""

    def side(name: str) -> DataFrame:
        return links.select(
            F.col(f"{name}_ref").alias("ref"),
            F.col(f"{name}_start").alias("start"),
            F.col(f"{name}_end").alias("end"),
            F.expr(f"substring({name}, 1, length({name}) - 1)").alias("id"),
            F.col(f"{name}_rank").alias("rank"),
            F.col(f"{name}_tags").alias("tags"),
            F.struct(F.col("ref").alias("on"), F.col("start").alias("from"), F.col("end").alias("to"), F.concat("source", F.lit(" "), "target").alias("key"), F.lit(int(name == "target")).alias("side")).alias("_arrival"),
        )

    return side("source").unionByName(side("target"))


def first_copies(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each segment: the copy of the link that arrives first."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*names), "_arrival").alias("_row")).select("_row.*")


def last_copies(links: DataFrame) -> DataFrame:
    """One row for each link, the one that arrives last: by hop, then by place."""
    names = [c for c in links.columns if c != "_hop"]
    return links.groupBy("source", "target").agg(F.max_by(F.struct(*names), F.struct("_hop", "ref", "start", "end")).alias("_row")).select("_row.*")


def bins(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / BIN), F.floor(F.greatest(end - 1, start) / BIN))


def links_over(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """Link rows that overlap the place of a frontier segment."""
    left = frontier.select("ref", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct().withColumn("_bin", F.explode(bins(F.col("_s"), F.col("_e"))))
    extent = frontier.groupBy("ref").agg(F.min("start").alias("_low"), F.max("end").alias("_high"))
    near = links.join(extent, "ref").where("start <= _high and end >= _low").drop("_low", "_high")  # before rows are dealt to bins
    right = near.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"))))
    hit = ((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))) | ((F.col("start") == F.col("end")) & (F.col("start") >= F.col("_s")) & (F.col("start") < F.col("_e")))
    return right.join(left, ["ref", "_bin"]).where(hit).select(links.columns)


def check_region(start: int, end: int, limit: int = MAX_REGION_BP) -> None:
    if end - start > limit:
        raise ValueError(f"a region of {end - start} bp is over the limit of {limit} bp")


def subgraph(segments: DataFrame, links: DataFrame, ref: str, start: int, end: int, context: int = 0, max_region_bp: int = MAX_REGION_BP) -> tuple[DataFrame, DataFrame]:
    """Segments and links of a region after `context` hops.

    A hop starts only from off-reference segments that the link scan before it reached first.  Of a segment, the last row of the region's own scan
    wins over the copies that links carry, of which the first to arrive wins; of a link, the last.
    """
    check_region(start, end, max_region_bp)
    own = in_region(segments, ref, start, end).select("ref", "start", "end", "id", "rank", "tags")
    names = own.columns
    own = own.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("start", "end", "tags")).alias("_row")).select("_row.*")
    scan = in_region(links, ref, start, end)
    found = scan.withColumn("_hop", F.lit(0))
    known = own
    reached = first_copies(ends(scan), names).join(known.select("id"), "id", "left_anti").select(known.columns)
    for hop in range(context):
        known = checkpoint(known.unionByName(reached))
        frontier = checkpoint(reached.where("rank > 0"))
        new = links_over(links, frontier)
        found = found.unionByName(new.withColumn("_hop", F.lit(hop + 1)))
        reached = first_copies(ends(new), names).join(known.select("id"), "id", "left_anti").select(known.columns)
    return known.unionByName(reached), last_copies(found)


def check_nodes(nodes: DataFrame, limit: int = MAX_NODES) -> None:
    if nodes.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} nodes")


def gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    """part, ref, start, key, line of the subgraph as GFA text: the header, segments by place, links by key."""
    valid = F.filter(F.split(F.coalesce("tags", F.lit("")), " "), lambda t: t.rlike(TAG))
    s = F.concat_ws(
        "\t", F.lit("S"), "id", F.lit("*"), F.concat(F.lit("LN:i:"), (F.col("end") - F.col("start")).cast("string")), F.concat(F.lit("SN:Z:"), "ref"), F.concat(F.lit("SO:i:"), F.col("start").cast("string")), F.concat(F.lit("SR:i:"), F.col("rank").cast("string")), F.when(F.size(valid) > 0, F.array_join(valid, "\t"))
    )

    def cut_end(name: str) -> list[Column]:
        return [F.expr(f"substring({name}, 1, length({name}) - 1)"), F.right(F.col(name), F.lit(1))]

    line = F.concat_ws("\t", F.lit("L"), *cut_end("source"), *cut_end("target"), F.lit("0M"))
    header = segments.sparkSession.sql("select 0 as part, '' as ref, 0L as start, '' as key, 'H\\tVN:Z:1.0' as line")
    return (
        header.unionByName(segments.select(F.lit(1).alias("part"), "ref", "start", F.col("id").alias("key"), s.alias("line")))
        .unionByName(links.select(F.lit(2).alias("part"), F.lit("").alias("ref"), F.lit(0).cast("long").alias("start"), F.concat("source", "target").alias("key"), line.alias("line")))
        .select("part", "ref", "start", "key", "line")
    )


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    """The subgraph as one ordered text file for each range of lines; a region's cut is one file."""
    gfa_lines(segments, links).orderBy("part", "ref", "start", "key").select("line").coalesce(1).write.mode("overwrite").text(path)
