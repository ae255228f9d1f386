"""Per-batch measurements of a stream as an ordinary table.

The sink adds one row per batch, from what Spark observed while it wrote; a listener adds Spark's own timings of the same batches, many to a
file. Both are plain folders by day. Rows are named by (stream, batch), a repeated batch counts as it was last written, and the files of
finished days are merged into one per day and kind.
"""

from __future__ import annotations

import threading
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..session import stage
from .identity import DIRECT

MEASUREMENT = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("unreadable", T.LongType()),
    T.StructField("transform_ms", T.DoubleType()), T.StructField("write_ms", T.DoubleType()), T.StructField("wall_ms", T.DoubleType()),
    T.StructField("completed_at", T.TimestampType()),
])

TIMING = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("rows_read", T.LongType()),
    T.StructField("source_ms", T.LongType()), T.StructField("planning_ms", T.LongType()), T.StructField("process_ms", T.LongType()),
    T.StructField("commit_ms", T.LongType()), T.StructField("trigger_ms", T.LongType()), T.StructField("completed_at", T.TimestampType()),
])

PROGRESS = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("rows_read", T.LongType()),
    T.StructField("source_ms", T.LongType()), T.StructField("planning_ms", T.LongType()),
    T.StructField("write_ms", T.LongType()), T.StructField("commit_ms", T.LongType()),
    T.StructField("wall_ms", T.LongType()),
])

BATCHES, TIMINGS = "batches", "timings"
DAY = T.StructField("day", T.DateType())


def _add(spark: SparkSession, path: str, kind: str, rows: list[tuple], schema: T.StructType) -> None:
    """Append rows to their days: a crash before the end leaves none of them."""
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    frame.withColumn("day", F.to_date("completed_at")).write.mode("append").partitionBy("day").parquet(f"{path}/{kind}")


def _stored(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """All rows of a kind, the last one of each (stream, batch)."""
    rows = spark.read.schema(T.StructType([*schema.fields, DAY])).parquet(f"{path}/{kind}")
    return rows.groupBy("stream", "batch_id").agg(F.max_by(F.struct(*schema.fieldNames()), "completed_at").alias("_last")).select("_last.*")


def record_batch(spark: SparkSession, path: str, batch_id: int, rows: int, transform_ms: float, write_ms: float, wall_ms: float,
                 unreadable: int = 0, stream: str = DIRECT) -> None:
    row = (stream, batch_id, rows, unreadable, float(transform_ms), float(write_ms), float(wall_ms), datetime.now(timezone.utc))
    _add(spark, path, BATCHES, [row], MEASUREMENT)


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch the sink wrote."""
    return _stored(spark, path, BATCHES, MEASUREMENT)


def timings(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch the listener heard of."""
    return _stored(spark, path, TIMINGS, TIMING)


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Batches as the run statistics take them: ``run_id`` is the stream; where the listener knows the batch, its wall time holds from the
    trigger to the commit, so reading the source and planning are in it."""
    both = measurements(spark, path).join(timings(spark, path).drop("completed_at"), ["stream", "batch_id"], "left")
    return both.select(
        F.col("stream").alias("run_id"), "batch_id", "rows", "unreadable", "transform_ms", "write_ms",
        F.greatest(F.coalesce(F.col("trigger_ms").cast("double"), F.col("wall_ms")), F.col("wall_ms")).alias("wall_ms"),
        "source_ms", "planning_ms", "commit_ms", "completed_at")


def merge_days(spark: SparkSession, path: str, before: date | None = None) -> int:
    """Rewrite the days before ``before`` (today) that have several files into one file each; returns how many days that were.

    A day is staged before its folder is replaced, and rows that a crash should leave twice count once.
    """
    merged = 0
    for kind, schema in ((BATCHES, MEASUREMENT), (TIMINGS, TIMING)):
        folder = f"{path}/{kind}"
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).groupBy(F.to_date("day").alias("day")).count()
        due = [r.day for r in names.filter((F.col("day") < F.lit(before or date.today())) & (F.col("count") > 1)).collect()]  # one row per day
        if due:
            rows = spark.read.schema(T.StructType([*schema.fields, DAY])).parquet(folder).filter(F.col("day").isin(due))
            staged = stage(rows, "measured-days")
            staged.repartition(len(due), "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
            merged += len(due)
    return merged


class BatchListener(StreamingQueryListener):
    """Keeps Spark's timings of every batch of the streams it is told of, and writes them to the metrics table.

    Spark itself remembers only the newest ones. Rows are written when ``hold`` of them wait and when a stream ends.
    """

    def __init__(self, spark: SparkSession, hold: int = 100):
        self.spark, self.hold = spark, hold
        self.paths: dict[str, str] = {}
        self.ended: dict[str, threading.Event] = {}
        self.waiting: dict[str, list[tuple]] = {}

    def watch(self, query: StreamingQuery, path: str) -> None:
        self.paths[str(query.id)] = path
        self.ended[str(query.id)] = threading.Event()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> bool:
        """Until the rows of a stream that has ended are written; they arrive a little later than its end."""
        return self.ended[str(query.id)].wait(seconds)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            ms = p.durationMs
            row = (str(p.id), p.batchId, p.numInputRows, ms.get("latestOffset", 0) + ms.get("getBatch", 0), ms.get("queryPlanning", 0), ms.get("addBatch", 0),
                   ms.get("walCommit", 0) + ms.get("commitOffsets", 0), ms.get("triggerExecution", 0), datetime.now(timezone.utc))
            self.waiting.setdefault(str(p.id), []).append(row)
            if len(self.waiting[str(p.id)]) >= self.hold:
                self.flush(str(p.id))

    def onQueryTerminated(self, event) -> None:
        try:
            self.flush(str(event.id))
        finally:
            if str(event.id) in self.ended:
                self.ended[str(event.id)].set()

    def flush(self, stream: str) -> None:
        """Write what waits for a stream; rows of a stream that nobody watches are dropped with it."""
        rows, path = self.waiting.pop(stream, []), self.paths.get(stream)
        if rows and path:
            _add(self.spark, path, TIMINGS, rows, TIMING)


def progress_rows(query: StreamingQuery) -> DataFrame:
    """Spark's own timings of the latest micro-batches (it keeps a bounded number of them).

    ``rows_read`` counts every read of a record, so a batch with two jobs over its input counts it twice.
    """
    rows = []
    for p in query.recentProgress:
        if not p["numInputRows"]:
            continue
        ms = p["durationMs"]
        rows.append((p["batchId"], p["numInputRows"], ms.get("latestOffset", 0) + ms.get("getBatch", 0), ms.get("queryPlanning", 0),
                     ms.get("addBatch", 0), ms.get("walCommit", 0) + ms.get("commitOffsets", 0), ms.get("triggerExecution", 0)))
    return SparkSession.active().createDataFrame(rows, PROGRESS)


def latest(metrics: DataFrame, run: str = "run_id", keep: int = 200) -> DataFrame:
    """The newest ``keep`` measurements per run; the limit is applied before the shuffle."""
    newest = Window.partitionBy(run).orderBy(F.desc("batch_id"))
    return metrics.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).drop("_rn")
