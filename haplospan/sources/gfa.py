"""GFA text as DataFrames, one for each record type.

Order is data in GFA: rec_no carries file order from the scan through every later stage.  Records are told by
their first character.  Types of tags other than i, f and Z are dropped; the last of equal keys wins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import number
from ..storage import cut, partitions, running


#: Fields that a record needs at least, with its type.
FIELDS = {"S": 3, "L": 5, "E": 4, "P": 3, "W": 7}


def read_lines(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """rec_no (dense, from 0), line and file; lines end at line feeds alone, one carriage return before is cut.

    rec_no grows in file order: files by path, whatever their sizes and the splits in which Spark reads them.  The lines of every split are
    counted, and the counts summed in order of file and place.  strict: a record with too few fields ends the job.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("_row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    splits = raw.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    placed = running(splits, "file", "_block", of="_lines", name="_before").select("file", "_block", "_first", "_before")
    lines = raw.join(placed, ["file", "_block"]).select((F.col("_before") + F.col("_row") - F.col("_first")).alias("rec_no"), F.regexp_replace("value", "\r$", "").alias("line"), "file")
    return checked(lines) if strict else lines


def checked(lines: DataFrame) -> DataFrame:
    """The lines; one with fewer fields than its record type needs ends the job with its file and number."""
    fields = F.length("line") - F.length(F.replace("line", F.lit("\t"), F.lit(""))) + 1
    needed = F.try_element_at(F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair]), F.substring("line", 1, 1))
    said = F.concat(F.lit("malformed record "), F.col("rec_no").cast("string"), F.lit(" of "), F.coalesce("file", F.lit("?")) if "file" in lines.columns else F.lit("the input"), F.lit(": "), F.substring("line", 1, 80))
    return lines.withColumn("line", F.when(fields < needed, F.raise_error(said).cast("string")).otherwise(F.col("line")))


class Graph(NamedTuple):
    """The tables of GFA input."""

    segments: DataFrame
    links: DataFrame
    paths: DataFrame
    walks: DataFrame


def load(spark: SparkSession, path: str | list[str]) -> Graph:
    """All records of one or more files, in their order; malformed ones end the job.  The text is read once and kept by lines in the shared folder."""
    lines = cut(read_lines(spark, path, strict=True))
    return Graph(segments(lines), links(lines), paths(lines), walks(lines))


def of_type(lines: DataFrame, letter: str, spread: bool = False) -> DataFrame:
    """rec_no and fields of the records of a type; spread: dealt to all tasks first."""
    found = lines.where(F.startswith(F.col("line"), F.lit(letter))).select("rec_no", "line")
    if spread:
        found = found.repartition(partitions(lines.sparkSession))
    return found.select("rec_no", F.split("line", "\t").alias("f"))


def tags(fields: Column) -> Column:
    """Map of key to (type, value); only the first two colons of a field delimit."""
    parts = F.transform(F.filter(fields, lambda x: x.rlike("^[^:]*:[^:]*:")), lambda x: F.split(x, ":", 3))
    known = F.filter(parts, lambda p: p[1].isin("i", "f", "Z"))
    entry = F.transform(known, lambda p: F.struct(p[0].alias("key"), F.struct(p[1].alias("type"), p[2].alias("value")).alias("tag")))
    last = F.filter(entry, lambda e, k: ~F.exists(F.slice(entry, k + 2, F.size(entry)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def tag_number(of: Column, key: str) -> Column:
    found = F.try_element_at(of, F.lit(key))
    return F.when(found["type"] != "Z", number(found["value"]))


def tag_text(of: Column, key: str) -> Column:
    found = F.try_element_at(of, F.lit(key))
    return F.when(found["type"] == "Z", found["value"])


def rest(fields: Column, start: int) -> Column:
    """Fields from the start-th on (from 1)."""
    return F.when(F.size(fields) >= start, F.slice(fields, start, F.greatest(F.size(fields), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def segments(lines: DataFrame) -> DataFrame:
    """S records of either version: rec_no, id, length, sequence, tags and the stable coordinate (sn, so, sr), if all of it is there."""
    f = F.col("f")
    second = F.get(f, F.lit(2))
    is_two = second.rlike("^[0-9]+$")
    sequence = F.coalesce(F.when(is_two, F.get(f, F.lit(3))).otherwise(second), F.lit("*"))
    base = of_type(lines, "S", spread=True).select(  # short lines that stand together, each with much work on its tags
        "rec_no",
        F.get(f, F.lit(1)).alias("id"),
        sequence.alias("sequence"),
        is_two.alias("_two"),
        second.alias("_second"),
        F.when(is_two, tags(rest(f, 5))).otherwise(tags(rest(f, 4))).alias("tags"),
    )
    plain = F.when(F.col("sequence") == "*", F.lit(0)).otherwise(F.length("sequence"))
    length = F.when(F.col("_two"), F.col("_second").cast("long")).otherwise(F.coalesce(tag_number(F.col("tags"), "LN").cast("long"), plain.cast("long")))
    name, start, rank = tag_text(F.col("tags"), "SN"), tag_number(F.col("tags"), "SO"), tag_number(F.col("tags"), "SR")
    stable = name.isNotNull() & start.isNotNull() & rank.isNotNull()
    return base.select(
        "rec_no",
        "id",
        length.alias("length"),
        "sequence",
        "tags",
        F.when(stable, name).alias("sn"),
        F.when(stable, start.cast("long")).alias("so"),
        F.when(stable, rank.cast("long")).alias("sr"),
    )


def links(lines: DataFrame) -> DataFrame:
    """L and E records: rec_no, source, source_strand, target, target_strand, cigar, tags."""
    f = F.col("f")
    one = of_type(lines, "L").select("rec_no", F.get(f, F.lit(1)).alias("source"), F.get(f, F.lit(2)).alias("source_strand"), F.get(f, F.lit(3)).alias("target"), F.get(f, F.lit(4)).alias("target_strand"), F.get(f, F.lit(5)).alias("cigar"), tags(rest(f, 7)).alias("tags"))

    def end(k: int) -> tuple[Column, Column]:
        return F.expr(f"substring(f[{k}], 1, length(f[{k}]) - 1)"), F.right(F.get(f, F.lit(k)), F.lit(1))

    (s, ss), (t, ts) = end(2), end(3)
    two = of_type(lines, "E").select("rec_no", s.alias("source"), ss.alias("source_strand"), t.alias("target"), ts.alias("target_strand"), F.get(f, F.lit(8)).alias("cigar"), tags(rest(f, 10)).alias("tags"))
    return one.unionByName(two)


STEP = "struct<segment:string,strand:string>"


def paths(lines: DataFrame) -> DataFrame:
    """P records: rec_no, name, steps.  The last character of a step is cut whatever it is; only ``-`` is reverse."""
    f = F.col("f")
    steps = F.transform(F.split(F.get(f, F.lit(2)), ","), lambda s: F.struct(F.substring(s, F.lit(1), F.length(s) - 1).alias("segment"), F.when(F.endswith(s, F.lit("-")), "-").otherwise("+").alias("strand")))
    return of_type(lines, "P").select("rec_no", F.get(f, F.lit(1)).alias("name"), steps.cast(f"array<{STEP}>").alias("steps"))


def walks(lines: DataFrame) -> DataFrame:
    """W records: rec_no, sample, haplotype, contig, start and end (-1 for ``*``), steps, tags."""
    f = F.col("f")
    found = F.regexp_extract_all(F.get(f, F.lit(6)), F.lit("(?:^|[><])[^><]+"), 0)
    steps = F.transform(found, lambda s: F.struct(F.regexp_replace(s, "^[><]", "").alias("segment"), F.when(F.startswith(s, F.lit("<")), "-").otherwise("+").alias("strand")))

    def place(k: int) -> Column:
        return F.when(F.get(f, F.lit(k)) == "*", F.lit(-1).cast("long")).otherwise(number(F.get(f, F.lit(k))).cast("long"))

    return of_type(lines, "W").select(
        "rec_no", F.get(f, F.lit(1)).alias("sample"), number(F.get(f, F.lit(2))).cast("long").alias("haplotype"), F.get(f, F.lit(3)).alias("contig"), place(4).alias("start"), place(5).alias("end"), steps.cast(f"array<{STEP}>").alias("steps"), tags(rest(f, 8)).alias("tags")
    )


def records(path_table: DataFrame, walk_table: DataFrame) -> DataFrame:
    """P and W records in one form: phase (0 for P), rec_no, name, sample, start, steps.  P records come first."""
    from ..functions.naming import origin_name, origin_start, pansn_sample

    p = path_table.select(F.lit(0).alias("phase"), "rec_no", F.col("name").alias("full_name"), origin_name(F.col("name")).alias("name"), origin_start(F.col("name")).alias("start"), "steps").withColumn("sample", pansn_sample(F.col("name")))
    w = walk_table.select(
        F.lit(1).alias("phase"),
        "rec_no",
        F.concat_ws("#", "sample", F.col("haplotype").cast("string"), "contig").alias("full_name"),
        F.concat_ws("#", "sample", F.col("haplotype").cast("string"), "contig").alias("name"),
        F.greatest(F.col("start"), F.lit(0).cast("long")).alias("start"),
        "steps",
        "sample",
    )
    return p.select("phase", "rec_no", "full_name", "name", "sample", "start", "steps").unionByName(w.select("phase", "rec_no", "full_name", "name", "sample", "start", "steps"))


def exploded(recs: DataFrame) -> DataFrame:
    """A row for each step: phase, rec_no, full_name, name, sample, start, step_no, segment, strand."""
    return recs.select("phase", "rec_no", "full_name", "name", "sample", "start", F.posexplode("steps").alias("step_no", "step")).select("phase", "rec_no", "full_name", "name", "sample", "start", "step_no", "step.segment", "step.strand")
