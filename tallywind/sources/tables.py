"""Partitioned table sinks and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..session import tidy


# The flag that divides a stream's table into records that could be read (1) and those set aside (0).
READABLE = "readable"
COORDINATES = ["kafka_key", "topic", "kafka_partition", "kafka_offset", "kafka_timestamp"]


def stream_rows(spark: SparkSession, path: str) -> DataFrame:
    """The readable records of a stream's table; folders of the others are not listed."""
    return spark.read.parquet(path).filter(F.col(READABLE) == 1).drop(READABLE)


def set_aside(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates of the records a stream could not read."""
    return spark.read.parquet(path).filter(F.col(READABLE) == 0).select(*COORDINATES, "stream", "batch_id")


def balanced(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Gather rows by their target partition before a partitioned write.

    AQE splits a partition that holds too much into several tasks and joins
    small ones, so the number of files follows the data and not tasks x partitions.
    """
    return df.hint("rebalance", *partition_by)


def without_dictionaries(writer: DataFrameWriter, columns: list[str]) -> DataFrameWriter:
    """Write the named columns plainly instead of trying a dictionary in every file first."""
    for name in columns:
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    return writer


def append(df: DataFrame, path: str, partition_by: list[str]) -> None:
    with tidy(df.sparkSession):
        df.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: list[str], touched_only: bool = False) -> None:
    """Replace the table, or with ``touched_only`` just the partitions that occur in ``df``."""
    mode = "dynamic" if touched_only else "static"
    with tidy(df.sparkSession):
        df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*partition_by).parquet(path)


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None, files: int = 1) -> None:
    """Write a result in a given number of files; ``files=0`` keeps the result's own partitioning.

    The rows are moved to the writing tasks, so that one file does not mean one task for the work before.
    """
    if files:
        df = df.repartition(files)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with tidy(df.sparkSession):
        writer.parquet(path)


def read(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """A table; ``merge_schema`` takes the union of columns where files were written with different ones."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


def in_partition(df: DataFrame, year: int, month: int, currency: str | None = None) -> DataFrame:
    """Rows of one month, and currency; on a partitioned table only those folders are listed and read."""
    df = df.filter((F.col("txn_year") == year) & (F.col("txn_month") == month))
    return df.filter(F.col("currency") == currency) if currency else df
