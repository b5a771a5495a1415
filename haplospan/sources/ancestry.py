"""Local ancestry of haplotypes as one BED table: an index of files by sample, a spread choice of samples, and the projection of their rows.

The index is comma-separated text with a header; lines may end in carriage returns and have more or fewer fields than the header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import numbered
from .gfa import read_lines

#: Columns of the projected table, in order.
COLUMNS = ("chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "sample")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """rec_no, sample, haplotype, assembly and location of each line but the header and empty ones, in the order of the file.

    The location is all that follows the third comma; what a short line lacks is null.
    """
    lines = read_lines(spark, path).where("rec_no > 0 and line <> ''")
    f = F.split("line", ",", 4)
    return lines.select("rec_no", *[F.get(f, F.lit(k)).alias(n) for k, n in enumerate(("sample", "haplotype", "assembly", "location"))])


def spread_samples(index: DataFrame, featured: list[str], count: int) -> DataFrame:
    """sample: the featured ones that the index has, and others in even strides along its order, `count` in all if there are so many.

    Samples stand in an index by cohort, so the first ones would be alike.  A sample is taken where the number of whole strides before it
    changes, which its own number tells: no row waits for another.
    """
    order = index.groupBy("sample").agg(F.min("rec_no").alias("first"))
    chosen = order.where(F.col("sample").isin(featured))
    rest = numbered(order.join(chosen.select("sample"), "sample", "left_anti"), "first", "sample")
    need, total = count - chosen.count(), rest.count()
    if need <= 0:
        return chosen.select("sample")
    stride = total / need
    at = F.floor((F.col("number") + 1) / F.lit(stride or 1.0))
    return chosen.select("sample").unionByName(rest.where(at != F.floor(F.col("number") / F.lit(stride or 1.0))).select("sample"))


def projected(index: DataFrame, samples: DataFrame, rows: DataFrame, chrom: str) -> DataFrame:
    """The rows of all files of the samples on one sequence, in ten columns, named by sample and haplotype.

    rows: location (of the file that holds it), chrom, start, end, name, score, itemRgb.  The thick part is all of a row, the strand is left open.
    """
    files = index.join(samples, "sample", "left_semi").select("location", F.concat("sample", F.lit(".h"), "haplotype").alias("sample"))
    here = rows.where(F.col("chrom") == chrom).select("location", "chrom", "start", "end", "name", "score", "itemRgb").join(files, "location")
    return here.withColumns({"strand": F.lit("."), "thickStart": F.col("start"), "thickEnd": F.col("end")}).select(*COLUMNS)


def write_bed(table: DataFrame, path: str) -> None:
    """The table as BED text by place, a folder whose files follow one another, with a header that names the columns."""
    spark = table.sparkSession
    placed = numbered(table.withColumn("_tie", F.monotonically_increasing_id()), "chrom", "start", "end", "sample", "_tie", name="_no")
    lines = placed.select("_no", F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS]).alias("value"))
    head = spark.createDataFrame([(-1, "#" + "\t".join(COLUMNS))], "_no long, value string")
    head.unionByName(lines).repartitionByRange("_no").sortWithinPartitions("_no").select("value").write.text(path)
