"""Looking at a table: column profile, schema, files and partitions, samples."""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and share of every column: one aggregate over the table, then one row per column."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    share = F.round(F.when(F.col("_rows") > 0, F.col("nulls").cast("decimal(18,0)") * 100 / F.col("_rows").cast("decimal(18,0)")), 2)
    return counts.unpivot(["_rows"], names, "column_name", "nulls").select(
        "column_name", "nulls", F.coalesce(share.cast("double"), F.lit(0.0)).alias("null_pct"))


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def amount_distribution(df: DataFrame, column: str = "amount") -> DataFrame:
    """Minimum, maximum, mean and population standard deviation."""
    return df.agg(F.min(column).alias("min_amount"), F.max(column).alias("max_amount"),
                  F.round(F.avg(column), 2).alias("mean_amount"), F.round(F.stddev_pop(column), 2).alias("stddev_amount"))


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    kind = "position int, column_name string, data_type string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, kind)


DATA_FILES = "*.parquet"


def files(spark: SparkSession, path: str) -> DataFrame:
    """One row per data file: ``file_path, folder, file_size, modified_at``. Files are listed, none is opened.

    ``folder`` is the path from the table's root to the file, empty for files in the root.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", DATA_FILES).option("recursiveFileLookup", "true").load(path)
    inner = path.split("://", 1)[-1].removeprefix("file:").rstrip("/")  # without scheme and host
    inner = quote(inner if inner.startswith("/") else inner[inner.find("/"):], safe="/=") + "/"
    at = F.col("_metadata.file_path")
    below = F.substring(at, F.locate(inner, at) + len(inner), F.length(at))
    return listed.select(
        at.alias("file_path"), F.regexp_replace(below, "/?[^/]*$", "").alias("folder"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"))


def partition_files(spark: SparkSession, path: str, top: int = 50) -> DataFrame:
    """Files per partition folder, the ``top`` fullest."""
    named = files(spark, path).withColumn("partition", F.when(F.col("folder") == "", "(root)").otherwise(F.col("folder")))
    return named.groupBy("partition").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("size_bytes")).orderBy(F.desc("files"), "partition").limit(top)


_PUSHED = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the plans made and run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def counted_from_footers(spark: SparkSession, path: str) -> DataFrame:
    """The row count of a Parquet table as a frame whose plan answers it from the files' footers; to be used inside ``footer_counts``."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))


def footer_counts(spark: SparkSession):
    """Settings under which counts of Parquet tables are pushed into the scan."""
    return settings(spark, _PUSHED)


def table_info(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Files, bytes, rows, columns and partition columns: a listing of the files and a count from their footers."""
    with footer_counts(spark):
        rows = counted_from_footers(spark, path).first().row_count  # one number
    listed = files(spark, path)
    columns = spark.read.parquet(path).columns
    keys = F.regexp_extract_all(F.first("folder"), F.lit("([^/=]+)="), F.lit(1))
    return listed.agg(
        F.count(F.lit(1)).alias("num_files"), F.sum("file_size").alias("size_bytes"), F.lit(rows).cast("long").alias("row_count"),
        F.lit(len(columns)).alias("columns"), F.array_join(keys, ",").alias("partition_columns"), F.lit(version).cast("long").alias("version"))


def history(commits: DataFrame, limit: int = 10) -> DataFrame:
    """The newest commits of a versioned table."""
    return commits.select("version", "committed_at", "operation", "batch_id", "rows").orderBy(F.desc("version")).limit(limit)


def sample(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def compare_schemas(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two tables side by side: match, type differs, or missing on one side."""
    a = schema_table(left).select("column_name", F.col("data_type").alias("left_type"))
    b = schema_table(right).select("column_name", F.col("data_type").alias("right_type"))
    verdict = (F.when(F.col("left_type") == F.col("right_type"), "match")
               .when(F.col("left_type").isNotNull() & F.col("right_type").isNotNull(), "type differs").otherwise("missing"))
    return a.join(b, "column_name", "full_outer").withColumn("verdict", verdict)
