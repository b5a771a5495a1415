"""Cutting lineage in storage that all executors share, and sums along an order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new local one where that is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def passing(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, of files that go with the application."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task may collect into lists: past the first groups they are sorted, and what memory does not hold is spilled.
MOST = 200_000


def tasks(spark: SparkSession, rows: int) -> int:
    """As many tasks as there are partitions, more where each would get over MOST rows."""
    return max(partitions(spark), -(-rows // MOST))


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read back: survives lost executors, and ends the lineage.

    Unlike a checkpoint it comes with its true size: a checkpoint hands the estimates of its plan on, which in a loop of joins multiply to numbers that
    take longer to work out than the rows.  The files go with the application, or by `discard` before.
    """
    spark = df.sparkSession
    path = passing(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df for a join by shuffle.  For tables that grow with the input: as files of packed numbers they look small enough to be sent to
    every task, but the driver would hold them row by row, those of several joins at a time."""
    return df.hint("merge")


#: Rows of one task where they are sorted for several joins and sums at a time.
ROWS = 20_000


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A table of `cut`, whose rows files count, dealt by key into as many tasks as it has times ROWS.

    What it is joined with by that key is dealt alike.  Shuffles that Spark brings together by packed bytes make a task's memory grow with the input.
    """
    return df.repartition(-(-df.count() // ROWS) or 1, *by)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables of `cut` that no plan reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """Adds the number from 0 of each row in the order of columns that tell all rows apart.

    Rows are dealt out by ranges, numbered inside each range, and shifted by the sizes of the ranges before: no task gets all rows.
    """
    ranged = cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in ranged.groupBy("_range").count().collect())  # one row for each partition
    starts, at = [], 0
    for part, size in sizes:
        starts += [F.lit(part), F.lit(at).cast("long")]
        at += size
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    first = F.element_at(F.create_map(*starts), F.col("_range")) if starts else F.lit(0).cast("long")
    return ranged.withColumn(name, first + inside).drop("_range")


def running(rows: DataFrame, *by: str, of: str, name: str = "before") -> DataFrame:
    """Adds the sum of a column over all rows that come before in the order of columns that tell all rows apart; dealt out as in `numbered`."""
    ranged = cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("_range").agg(F.sum(of)).collect())  # one row for each partition
    starts, at = [], 0
    for part, size in sums:
        starts += [F.lit(part), F.lit(at)]
        at += size or 0
    kind = ranged.schema[of].dataType
    inside = F.coalesce(F.sum(of).over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(kind))
    first = F.element_at(F.create_map(*starts), F.col("_range")).cast(kind) if starts else F.lit(0).cast(kind)
    return ranged.withColumn(name, (first + inside).cast(kind)).drop("_range")
