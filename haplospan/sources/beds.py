"""Tabular projections of a graph: segments, links and bubbles by stable coordinate, half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import grouped, pansn_contig, pansn_sample
from ..storage import dealt

SEGMENTS = "ref string, start long, end long, id string, rank long, tags string"
LINKS = (
    "ref string, start long, end long, source string, target string, source_ref string, source_start long, source_end long, source_rank long, "
    "target_ref string, target_start long, target_end long, target_rank long, source_tags string, target_tags string"
)
BUBBLES = (
    "ref string, start long, end long, segment_count long, path_count long, inversion string, shortest_length long, longest_length long, "
    "x1 string, x2 string, x3 string, segments string, shortest string, longest string"
)
#: The largest path count that the producer writes; it stands for more.
SATURATED = 2147483647


def read_bed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)  # a quote is a character like others


def overlaps(start: int, end: int) -> Column:
    """Rows that overlap [start, end); an empty row counts where it stands."""
    s, e = F.col("start"), F.col("end")
    return (s < end) & (e >= start) & ((e > start) | ((s == e) & (s >= start)))  # the first two conjuncts prune files by place


def in_region(rows: DataFrame, ref: str, start: int, end: int) -> DataFrame:
    return rows.where((F.col("ref") == ref) & overlaps(start, end))


def carriers(tag_list: Column) -> Column:
    """Samples of the first SM tag in a list separated by spaces; null when there is none."""
    found = F.get(F.filter(F.split(tag_list, " "), lambda t: F.startswith(t, F.lit("SM:Z:"))), F.lit(0))
    names = F.filter(F.transform(F.split(F.substring(found, 6, 1 << 30), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(names) > 0, names)


def segment_features(segments: DataFrame, ref: str, start: int, end: int) -> DataFrame:
    samples = carriers(F.col("tags"))
    return in_region(segments, ref, start, end).select("id", "ref", "start", "end", "rank", samples.alias("samples"), F.when(samples.isNotNull(), F.size(samples)).cast("long").alias("carriers"))


def bubble_label() -> Column:
    low, high = F.col("shortest_length"), F.col("longest_length")
    return F.when(low == high, F.concat(grouped(low), F.lit(" bp"))).otherwise(F.concat(grouped(low), F.lit("-"), grouped(high), F.lit(" bp")))


def bubble_description() -> Column:
    paths = F.when(F.col("path_count") == SATURATED, F.lit("more paths than gfatools counts")).otherwise(F.concat(F.lit("up to "), grouped(F.col("path_count")), F.lit(" paths")))
    return F.concat_ws(", ", F.concat(F.col("segment_count").cast("string"), F.lit(" segments")), paths, F.when(F.col("inversion") == "1", F.lit("inversion")))


def bubble_features(bubbles: DataFrame, ref: str, start: int, end: int) -> DataFrame:
    return in_region(bubbles, ref, start, end).select(
        "ref",
        "start",
        "end",
        bubble_label().alias("label"),
        bubble_description().alias("description"),
        F.nullif("shortest", F.lit("*")).alias("shortest"),
        F.nullif("longest", F.lit("*")).alias("longest"),
    )


def reference_names(segments: DataFrame, sample: str | None) -> DataFrame:
    """Contigs of a sample's stable names; all stable names if the sample has none."""
    names = segments.select("ref").distinct()
    of = names.where(pansn_sample(F.col("ref")) == F.lit(sample)).select(pansn_contig(F.col("ref")).alias("name"))
    none = of.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return of.unionByName(names.join(none.select(F.lit(True).alias("_all")), how="left_semi", on=F.lit(True)).select(F.col("ref").alias("name")))


def resolve_names(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """requests: assembly, contig.  Adds ref: the stable name of that sample and contig, else the stable name spelt like the contig."""
    names = segments.select("ref").distinct()
    qualified = names.select(pansn_sample(F.col("ref")).alias("assembly"), pansn_contig(F.col("ref")).alias("contig"), F.col("ref").alias("_a")).groupBy("assembly", "contig").agg(F.min("_a").alias("_a"))
    raw = names.select(F.col("ref").alias("contig"), F.col("ref").alias("_b"))
    return requests.join(qualified, ["assembly", "contig"], "left").join(raw, "contig", "left").select("assembly", "contig", F.coalesce("_a", "_b").alias("ref"))


def index_tables(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segment and link tables of a graph's stable coordinates: each link stands under both of its ends; links with an unknown end go.

    segments: id, length, sn, so, sr, tags_text; links: source, source_strand, target, target_strand.
    """
    segs = segments.where("sn is not null").select(F.col("sn").alias("ref"), F.col("so").alias("start"), (F.col("so") + F.col("length")).alias("end"), "id", F.col("sr").alias("rank"), F.col("tags_text").alias("tags"))

    def end_of(side: str) -> DataFrame:
        return segs.select(F.col("id").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in ("ref", "start", "end", "rank", "tags")])

    both = links.join(dealt(end_of("source")), F.col("source") == F.col("_source")).join(dealt(end_of("target")), F.col("target") == F.col("_target"))
    both = both.select(
        F.concat("source", "source_strand").alias("source"),
        F.concat("target", "target_strand").alias("target"),
        *[f"{side}_{c}" for side in ("source", "target") for c in ("ref", "start", "end", "rank")],
        "source_tags",
        "target_tags",
    )
    out = [both.select(F.col(f"{side}_ref").alias("ref"), F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"), *both.columns) for side in ("source", "target")]
    return segs, out[0].unionByName(out[1])


def by_place(table: DataFrame) -> DataFrame:
    """Dealt by ranges of place and sorted, so that a region of the written table reads a few row groups."""
    return table.repartitionByRange("ref", "start").sortWithinPartitions("ref", "start")


def write_index(table: DataFrame, path: str) -> None:
    by_place(table).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, ref: str, start: int, end: int) -> DataFrame:
    """The rows of a written index that overlap a region."""
    return in_region(spark.read.parquet(path), ref, start, end)


def bed_rows(table: DataFrame, schema: str) -> DataFrame:
    """One text column: the columns of a schema of this module in its order, tab-separated, nulls empty."""
    names = [c.split()[0] for c in schema.split(",")]
    return table.select(F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]).alias("value"))


def locations(prefix: str, compressed: bool = True) -> dict[str, str]:
    """The files that a prefix stands for."""
    end = ".bed.gz" if compressed else ".bed"
    return {name: f"{prefix}.{name}{end}" for name in ("segs", "links", "bubbles")}


def read_prefix(spark: SparkSession, prefix: str, compressed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Segment and link tables of the files that a prefix stands for."""
    at = locations(prefix, compressed)
    return read_bed(spark, at["segs"], SEGMENTS), read_bed(spark, at["links"], LINKS)


def samples_of_assemblies(requests: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """requests: assembly, contig.  The assembly under its sample's name in stable names, where the mapping has one; else as it is."""
    if not mapping:
        return requests
    known = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    return requests.withColumn("assembly", F.coalesce(F.try_element_at(known, F.col("assembly")), F.col("assembly")))
