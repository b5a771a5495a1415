"""Streaming ingestion of GFA files.  An addition: record decoding is row by row, so it runs on streams as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import gfa


def lines(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """rec_no (a hash of file and line; streams have no order) and line of new files in a folder."""
    raw = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_at_once).load(path)
    line = F.regexp_replace("value", "\r$", "")
    return raw.select(F.xxhash64(F.col("_metadata.file_path"), line).alias("rec_no"), line.alias("line"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    return gfa.segments(lines(spark, path))


def links(spark: SparkSession, path: str) -> DataFrame:
    return gfa.links(lines(spark, path))


def bp_by_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Running segments and bp of each stable sequence."""
    return segments(spark, path).where("sn is not null").groupBy("sn").agg(F.count(F.lit(1)).alias("segments"), F.sum("length").alias("bp"))
