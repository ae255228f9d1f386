"""One place where an operator's Spark query and its oracle statement are written down together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import FOR_WIDE_ROWS

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    oracle: str | None


# UTC throughout; and AQE may keep small shuffles on all cores, since a partitioned
# write of little data is bound by the number of its files.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    **FOR_WIDE_ROWS,
}

CATALOG: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
            return build(spark, sf_dir)

        CATALOG[name] = Entry(name, run, oracle)
        return build

    return add
