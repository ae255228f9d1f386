"""Session, job settings and the shared folder for staged intermediate tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup side is broadcast only after measuring it; above this many rows or bytes the
# join stays a shuffle join, which AQE can split on skewed keys.
BROADCAST_ROW_LIMIT = 200_000
BROADCAST_BYTE_LIMIT = 64 << 20

# HotSpot never compiles methods beyond 8,000 bytes, which one fused step over the many columns of a transaction is; and groups with
# texts in them stay in a hash table (about 2 KB each) up to this number of them per task.
FOR_WIDE_ROWS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384"}


@dataclass(frozen=True)
class JobConfig:
    """Settings shared by the stream, back-fill and analytics jobs."""

    app_name: str = "tallywind"
    master: str | None = None
    transactions_topic: str = "financial-transactions"
    accounts_topic: str = "account-updates"
    bootstrap_servers: str = "localhost:9092"
    transactions_path: str = "data/transactions"
    accounts_path: str = "data/accounts"
    analytics_path: str = "data/transactions_analytics"
    checkpoint_path: str = "data/_checkpoints"
    trigger_interval: str = "10 seconds"
    max_transactions_per_batch: int = 500_000
    max_account_events_per_batch: int = 200_000
    shuffle_partitions: int | None = None
    max_partition_bytes: str = "256m"
    advisory_partition_bytes: str = "128m"
    worker_cores: int = 4
    cost_per_core_hour: float = 0.752
    vacuum_retention_hours: int = 168
    metrics_history: int = 200

    @classmethod
    def load(cls, path: str) -> "JobConfig":
        """Read settings from YAML (when a YAML reader is installed) or JSON; unknown keys are refused."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as exc:
                raise RuntimeError("reading YAML settings needs PyYAML; use a .json file instead") from exc
            values = yaml.safe_load(text) or {}
        else:
            values = json.loads(text)
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)


def build_session(cfg: JobConfig | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """Create the session. Shuffle partitions are left to Spark and AQE unless the settings name a number."""
    cfg = cfg or JobConfig()
    builder = (
        SparkSession.builder.appName(cfg.app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", cfg.advisory_partition_bytes)
        .config("spark.sql.files.maxPartitionBytes", cfg.max_partition_bytes)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.schemaInference", "false")
        .config("spark.ui.enabled", "false")
    )
    for key, value in FOR_WIDE_ROWS.items():
        builder = builder.config(key, value)
    if cfg.master:
        builder = builder.master(cfg.master)
    if cfg.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(cfg.shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHARED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, one per application, below ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            root = tempfile.mkdtemp(prefix="tallywind-")
        _SHARED[app] = f"{root.rstrip('/')}/tallywind-{app}-{uuid.uuid4().hex[:8]}"
    return _SHARED[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within are removed when each has ended, not when the driver next happens to collect garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with tidy(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _row_bytes(schema: T.StructType) -> Column:
    """About what a row takes in memory: eight bytes a field, and the contents of those without a fixed size."""
    total = F.lit(16 + 8 * len(schema.fields)).cast("long")
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return total


@dataclass(frozen=True)
class Lookup:
    """A staged lookup table with its size, counted while it was written."""

    frame: DataFrame
    rows: int
    size: int
    max_rows: int
    max_bytes: int

    @property
    def small(self) -> bool:
        return self.rows <= self.max_rows and self.size <= self.max_bytes

    def side(self) -> DataFrame:
        """The table, with a broadcast hint if it is small enough."""
        return F.broadcast(self.frame) if self.small else self.frame


def lookup(df: DataFrame, label: str, max_rows: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> Lookup:
    measured = Observation()
    frame = stage(df.observe(measured, F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df.schema)).alias("size")), label)
    found = measured.get
    return Lookup(frame, found.get("rows") or 0, found.get("size") or 0, max_rows, max_bytes)


def lookup_side(df: DataFrame, label: str, max_rows: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Stage a derived lookup table, measure it, and hint a broadcast only when it is small enough."""
    return lookup(df, label, max_rows, max_bytes).side()


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores; leave any other input alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
