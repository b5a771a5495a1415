"""Regions of a view: the widest block, padding around a segment, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region_of_blocks(blocks: DataFrame) -> DataFrame:
    """blocks: block_no, ref, start, end (doubles).  ref, start, end of the widest block, the first on ties; whole numbers, start not below 0."""
    width = F.struct((F.col("end") - F.col("start")).alias("w"), (-F.col("block_no")).alias("n"))
    of = blocks.agg(*[F.max_by(c, width).alias(c) for c in ("ref", "start", "end")])
    return of.select("ref", F.greatest(F.floor("start"), F.lit(0)).cast("long").alias("start"), F.floor("end").cast("long").alias("end"))


def around(start: Column, end: Column) -> tuple[Column, Column]:
    """A region around a segment: half its length on both sides, at least 10 bp; start not below 0."""
    pad = F.greatest(F.lit(10), F.floor((end - start) * 0.5))
    return F.greatest(start - pad, F.lit(0)).cast("long"), (end + pad).cast("long")
