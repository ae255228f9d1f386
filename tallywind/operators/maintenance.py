"""Compaction of small files and selection of expired versions."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import lookup_side, stage, tidy
from .profile import files, settings

TARGET_BYTES = 256 << 20
# What a rewrite reads at a time: its shuffle, a few times that, is on disk until the rows are written.
BYTES_PER_JOB = 1 << 30
# A partition folder's column values stay the text they are in its name.
_AS_NAMED = {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}


def compact(spark: SparkSession, source: str, target: str, partition_by: list[str], rows_per_file: int = 2_000_000,
            drop: list[str] | None = None) -> DataFrame:
    """Rewrite a table into few files per partition; ``drop`` removes a leaf level such as ``batch_id``.

    Rows are gathered by partition; AQE splits a partition that is too large for
    one task, and ``rows_per_file`` bounds the files of the rest. Where the source has a folder level for each of ``partition_by``, as many
    partitions as have about ``BYTES_PER_JOB`` are rewritten at a time, and what they shuffled is removed before the next. The result is a
    new folder: readers of the old one are not disturbed, and switching is up to the caller.
    """
    source = source.rstrip("/")
    everything = spark.read.parquet(source)
    for i, folders in enumerate(_portions(spark, source, partition_by) or [None]):
        part = everything
        if folders is not None:
            part = spark.read.schema(everything.schema).option("basePath", source).parquet(*[f"{source}/{unquote(f)}" for f in folders])
        _rewrite(part.drop(*(drop or [])), target, partition_by, rows_per_file, "append" if i else "overwrite")
    return spark.read.parquet(target)


def _portions(spark: SparkSession, source: str, partition_by: list[str]) -> list[list[str]]:
    """The source's folders in portions of about ``BYTES_PER_JOB``, those of one partition together; none if it has not these levels, or is small."""
    level = [F.regexp_extract("folder", f"(?:^|/){name}=([^/]*)", 1).alias(f"_{i}") for i, name in enumerate(partition_by)]
    listed = files(spark, source).groupBy(*level).agg(F.sum("file_size").alias("size"), F.collect_set("folder").alias("folders")).collect()  # one row per partition
    if sum(r.size for r in listed) <= BYTES_PER_JOB or any("" in r[:len(partition_by)] for r in listed):
        return []
    portions, size = [[]], 0
    for r in sorted(listed, key=lambda r: r[:len(partition_by)]):
        if size and size + r.size > BYTES_PER_JOB:
            portions, size = [*portions, []], 0
        portions[-1] += sorted(r.folders)
        size += r.size
    return portions


def _rewrite(rows: DataFrame, target: str, partition_by: list[str], rows_per_file: int, mode: str) -> None:
    with tidy(rows.sparkSession):
        (rows.hint("rebalance", *partition_by).write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd")
         .partitionBy(*partition_by).parquet(target))


def compaction_plan(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Which files to rewrite together: ``folder, file_path, file_size, bin``, from the files' sizes alone.

    A folder is chosen if packing makes fewer files of it. Its files are packed in order of size, each into the bin where the sum of the
    sizes before it ends, so a bin has about ``target_bytes`` and holds whole files.
    """
    in_folder = Window.partitionBy("folder")
    packed = files(spark, path).withColumn(
        "_before", F.coalesce(F.sum("file_size").over(in_folder.orderBy("file_size", "file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    packed = packed.withColumn("bin", F.floor(F.col("_before") / target_bytes))
    sized = packed.withColumns({"_files": F.count(F.lit(1)).over(in_folder), "_bins": F.size(F.collect_set("bin").over(in_folder))})
    return sized.filter(F.col("_bins") < F.col("_files")).select("folder", "file_path", "file_size", "bin")


def compact_in_place(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Pack the small files of a partitioned table; returns the plan that was carried out. Folders that need nothing keep their files.

    Only the chosen folders are read. Each bin is written by one task, and the chosen folders are replaced by a dynamic partition
    overwrite when all of them are written. A reader that listed the old files has to list again; a folder that grows meanwhile must
    not be compacted at the same time.
    """
    path = path.rstrip("/")
    plan = stage(compaction_plan(spark, path, target_bytes), "compaction-plan")
    folders = [unquote(r.folder) for r in plan.select("folder").distinct().collect()]  # names of chosen folders, as a table listing holds them
    if not folders:
        return plan
    if folders == [""]:
        raise ValueError("a table without partition folders is rewritten by compact()")
    bins = plan.select("folder", "bin").distinct().count()
    with settings(spark, _AS_NAMED):
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
        keys = [part.split("=", 1)[0] for part in folders[0].split("/")]
        side = lookup_side(plan.select(F.col("file_path").alias("_file"), F.xxhash64("folder", "bin").alias("_bin")), "bins")
        packed = rows.withColumn("_file", F.col("_metadata.file_path")).join(side, "_file").drop("_file")
        dealt = packed.repartition(min(bins, 100_000), "_bin").sortWithinPartitions("_bin", *keys)
        dealt.drop("_bin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return plan


def expired_versions(commits: DataFrame, retention_hours: int = 168, key: str | None = None) -> DataFrame:
    """Versions committed before the retention period, counted back from each table's newest commit, which always stays.

    ``key`` names the table a commit belongs to, where one log covers several.
    """
    keys = [key] if key else []
    newest = commits.groupBy(*keys).agg(F.max(F.struct("committed_at", "version")).alias("_newest"))
    joined = commits.join(newest, key) if key else commits.crossJoin(F.broadcast(newest))  # one row
    old = F.col("committed_at") < F.col("_newest.committed_at") - F.expr(f"INTERVAL '{retention_hours}' HOUR")
    return joined.filter(old & (F.col("version") != F.col("_newest.version"))).drop("_newest")
