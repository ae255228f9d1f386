"""Quantile sketches per key, merged level by level.

With ten keys, one aggregation would bring the sketches of all partitions of a key into one task. Here partitions are taken in blocks:
a task merges the sketches of one key from at most ``FAN_IN`` partitions, the next level those of ``FAN_IN`` blocks, until one block is
left. A sketch holds every value up to its size and is exact till then; beyond, its rank error is about 0.0001 (``SKETCH_SIZE``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

SKETCH_SIZE, FAN_IN = 65_535, 32


def sketch_per_key(df: DataFrame, key: str, column: str, size: int = SKETCH_SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """``key, _sketch``: one sketch of the key's values, null where it has none. Nulls and NaN are left out."""
    value = F.col(column).cast("double")
    rows = df.select(key, F.when(~F.isnan(value), value).alias("_value"), F.spark_partition_id().alias("_part"))
    level = stage(rows.withColumn("_block", F.expr(f"_part div {fan_in}")).groupBy(key, "_block").agg(
        F.kll_sketch_agg_double("_value", F.lit(size)).alias("_sketch")), "sketches")
    blocks = (level.agg(F.max("_block")).first()[0] or 0) + 1
    while blocks > 1:
        blocks = -(-blocks // fan_in)
        level = stage(level.withColumn("_block", F.expr(f"_block div {fan_in}")).groupBy(key, "_block").agg(
            F.kll_merge_agg_double("_sketch").alias("_sketch")), "sketches")
    has_values = F.col("_sketch").isNotNull() & (F.kll_sketch_get_n_double("_sketch") > 0)
    return level.select(key, F.when(has_values, F.col("_sketch")).alias("_sketch"))


def percentiles_per_key(df: DataFrame, key: str, column: str, names: dict[str, float], size: int = SKETCH_SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """All percentiles of every key: the smallest value whose share of values up to it reaches the percentile."""
    sketches = sketch_per_key(df, key, column, size, fan_in)
    found = F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, names.values())))
    picked = sketches.select(key, F.when(F.col("_sketch").isNotNull(), found).alias("_p"))
    return picked.select(key, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])
