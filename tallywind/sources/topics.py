"""Topic sources: bounded and streaming reads of the record envelope, decoding, and malformed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import ENVELOPE

LARGEST_INT = (1 << 31) - 1


def kafka_options(servers: str, topic: str, max_per_trigger: int | None = None) -> dict[str, str]:
    """Reader options of a topic: from the earliest offset, tolerating records that were already deleted."""
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": topic,
        "startingOffsets": "earliest", "failOnDataLoss": "false",
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_per_trigger: int) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, max_per_trigger)).load()


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Everything in the topic now."""
    return spark.read.format("kafka").options(**kafka_options(servers, topic), endingOffsets="latest").load()


def files_within(spark: SparkSession, path: str, max_rows: int) -> int:
    """How many of the folder's files make up at most ``max_rows`` records whichever they are (one at least); from the files' footers."""
    rows = spark.read.schema(ENVELOPE).parquet(path).groupBy("_metadata.file_path").count().agg(F.max("count")).first()[0]
    return max(1, max_rows // rows) if rows else 1


def stream_files(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int | None = None, max_rows: int | None = None,
                 schema: T.StructType = ENVELOPE) -> DataFrame:
    """The same envelope from a folder of Parquet files, with a limit per micro-batch. A limit of rows is kept in whole files, as large
    as those that are there when the stream starts. Files with another ``schema`` hold what the caller makes the envelope of."""
    if max_rows:
        max_files = min(max_files or LARGEST_INT, files_within(spark, path, max_rows))
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).parquet(path)


def between_offsets(envelope: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records with ``start <= offset < end``; the bound reaches the file scan."""
    if start is not None:
        envelope = envelope.filter(F.col("offset") >= start)
    if end is not None:
        envelope = envelope.filter(F.col("offset") < end)
    return envelope


# Envelope fields that stay beside the payload, with the names they get.
COORDINATES = {"topic": "topic", "partition": "kafka_partition", "offset": "kafka_offset", "timestamp": "kafka_timestamp"}


def _payload(schema: T.StructType) -> Column:
    """The parsed value. It is named twice, so that an expression it is made by stays a step of its own, in compiled code; ``from_json``
    interprets what is below it."""
    return F.when(F.col("value").isNotNull(), F.from_json(F.col("value").cast("string"), schema))


def _fields(parsed: DataFrame) -> DataFrame:
    beside = [F.col(f.name).alias(COORDINATES[f.name]) for f in ENVELOPE.fields if f.name in COORDINATES]
    return parsed.select(F.col("key").cast("string").alias("kafka_key"), "payload.*", *beside)


def decode(envelope: DataFrame, schema: T.StructType) -> DataFrame:
    """Payload fields between the record's key and its coordinates. A record that cannot be read keeps those and has all-null fields."""
    return _fields(envelope.withColumn("payload", _payload(schema)))  # parsed once per record, not once per field


def decode_once(envelope: DataFrame, schema: T.StructType) -> DataFrame:
    """The same rows for a reader that filters them by payload fields: such a filter would be moved below the parsing and parse each record
    again, but is not moved below a generator."""
    return _fields(envelope.withColumn("payload", F.explode(F.array(_payload(schema)))))


def readable(decoded: DataFrame, key: str = "transaction_id") -> DataFrame:
    return decoded.filter(F.col(key).isNotNull())


def unreadable(decoded: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Coordinates of the records to put aside."""
    return decoded.filter(F.col(key).isNull()).select("kafka_key", "topic", "kafka_partition", "kafka_offset", "kafka_timestamp")


def account_updates(envelope: DataFrame, schema: T.StructType) -> DataFrame:
    """Account events without their coordinates; one without a key cannot be merged."""
    return readable(decode_once(envelope, schema), "account_id").select(*schema.fieldNames())


def next_offsets(envelope: DataFrame) -> DataFrame:
    """Where reading goes on: the highest offset + 1 of every topic partition."""
    return envelope.groupBy("topic", F.col("partition").alias("kafka_partition")).agg(
        (F.max("offset") + 1).alias("next_offset"))
