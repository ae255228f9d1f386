"""Which stream a micro-batch belongs to: batch numbers start at 0 again with every new checkpoint, so they name a batch only within one."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

DIRECT = "direct"


def stream_of(spark: SparkSession, checkpoint: str | None) -> str:
    """The id that Spark keeps in the checkpoint: the same after a restart, another after a reset. Batches without a stream share one name."""
    if checkpoint is None:
        return DIRECT
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


class Follows:
    """A ``foreachBatch`` target that learns its stream from the checkpoint it was started with."""

    checkpoint: str | None = None
    _stream: str | None = None

    def follow(self, checkpoint: str) -> None:
        self.checkpoint, self._stream = checkpoint, None

    def stream(self, spark: SparkSession) -> str:
        if self._stream is None:
            self._stream = stream_of(spark, self.checkpoint)
        return self._stream
