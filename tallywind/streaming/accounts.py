"""The account stream: decode, drop keyless events, merge each batch into the account table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import AccountTable
from ..sources.schemas import ACCOUNT
from ..sources.topics import account_updates
from .identity import Follows
from .metrics import record_batch


class AccountSink(Follows):
    def __init__(self, table: AccountTable, metrics_path: str | None = None):
        self.table, self.metrics_path = table, metrics_path

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        started = time.perf_counter()
        stream = self.stream(self.table.spark)
        records = self.table.apply(events, batch_id, stream)
        if records and self.metrics_path:
            elapsed = (time.perf_counter() - started) * 1000
            record_batch(self.table.spark, self.metrics_path, batch_id, records, transform_ms=0.0, write_ms=elapsed, wall_ms=elapsed, stream=stream)


def start(envelope: DataFrame, sink: AccountSink, checkpoint: str, trigger: dict | None = None,
          schema: T.StructType = ACCOUNT) -> StreamingQuery:
    if isinstance(sink, Follows):
        sink.follow(checkpoint)
    return (
        account_updates(envelope, schema).writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
