"""Grouped summaries and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..sources.schemas import CATEGORIES, STATUSES, TRANSACTION_TYPES
from .sketches import SKETCH_SIZE, percentiles_per_key


def currency_summary(df: DataFrame) -> DataFrame:
    """Counts, sums, moments and flags per currency, largest volume first."""
    amount = F.col("amount")
    return df.groupBy("currency").agg(
        F.count(F.lit(1)).alias("txn_count"),
        fn.money_sum(amount).alias("total_volume"),
        fn.exact_mean(amount).alias("avg_amount"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        F.round(F.stddev(amount), 2).alias("stddev_amount"),
        fn.exact_mean(F.col("fee")).alias("avg_fee"),
        fn.exact_mean(F.col("risk_score"), 4).alias("avg_risk"),
        F.count_if("is_flagged").alias("flagged_count"),
    ).orderBy(F.desc("total_volume"), "currency")


def distinct_per_group(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Exact distinct count; copies are dropped before the first shuffle."""
    return df.groupBy(key).agg(F.countDistinct(column).alias(name))


def approx_distinct_per_group(df: DataFrame, key: str, column: str, name: str, rsd: float = 0.05) -> DataFrame:
    return df.groupBy(key).agg(F.approx_count_distinct(column, rsd).alias(name))


def approx_percentiles(df: DataFrame, key: str, column: str, names: dict[str, float], size: int = SKETCH_SIZE) -> DataFrame:
    """All percentiles of a group from one sketch, merged in levels: few keys do not mean few tasks."""
    return percentiles_per_key(df, key, column, names, size)


def currency_statistics(df: DataFrame) -> DataFrame:
    """The full currency report. Distinct counts and percentiles run beside the other aggregates: in one ``agg`` Spark would
    keep a sketch per (currency, sender), and all sketches of a currency would meet in one task."""
    base = df.groupBy("currency").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.approx_count_distinct("receiver_account", 0.05).alias("approx_unique_receivers"),
        fn.money_sum(F.col("amount")).alias("total_volume"),
        fn.exact_mean(F.col("amount")).alias("avg_amount"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        F.stddev("amount").alias("stddev_amount"),
        fn.exact_mean(F.col("fee")).alias("avg_fee"),
        fn.exact_mean(F.col("risk_score"), 4).alias("avg_risk"),
        F.count_if("is_flagged").alias("flagged_count"),
    )
    senders = distinct_per_group(df, "currency", "sender_account", "unique_senders").withColumnRenamed("currency", "_sent")
    names = {"median_amount": 0.5, "p95_amount": 0.95, "p99_amount": 0.99}
    percentiles = approx_percentiles(df, "currency", "amount", names).withColumnRenamed("currency", "_on")
    return base.join(senders, base.currency.eqNullSafe(senders["_sent"]), "left").join(
        percentiles, base.currency.eqNullSafe(percentiles["_on"]), "left").select(
        *base.columns, "unique_senders", *names).orderBy(F.desc("total_volume"), "currency")


def cross_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("currency", "transaction_type").agg(
        F.count(F.lit(1)).alias("count"),
        fn.exact_mean(F.col("amount")).alias("avg_amount"),
        fn.money_sum(F.col("amount")).alias("total_amount"),
    ).orderBy("currency", F.desc("total_amount"), "transaction_type")


def hourly_volume(df: DataFrame) -> DataFrame:
    """Count and volume per derived hour; a table without that column is refused."""
    if "txn_hour" not in df.columns:
        raise ValueError("hourly volume needs the column txn_hour of the enrichment")
    return df.groupBy("txn_hour").agg(
        F.count(F.lit(1)).alias("txn_count"), fn.money_sum(F.col("amount")).alias("volume"),
    ).orderBy("txn_hour")


def _pivot(df: DataFrame, row: str, column: str, values: list[str], cell: Column) -> DataFrame:
    """A pivot over a fixed value list needs no pass to find the values."""
    return df.groupBy(row).pivot(column, values).agg(cell).na.fill(0).orderBy(row)


def type_counts(df: DataFrame) -> DataFrame:
    return _pivot(df, "currency", "transaction_type", TRANSACTION_TYPES, F.count(F.lit(1)))


def status_volumes(df: DataFrame) -> DataFrame:
    return _pivot(df, "currency", "status", STATUSES, fn.money_sum(F.col("amount")))


def category_means(df: DataFrame) -> DataFrame:
    return _pivot(df, "channel", "category", CATEGORIES, fn.exact_mean(F.col("amount")))


def risky_senders(df: DataFrame, threshold: float = 0.7, least: int = 2) -> DataFrame:
    """Senders with at least ``least`` transactions at or above the risk threshold."""
    return df.filter(F.col("risk_score") >= threshold).groupBy("sender_account").agg(
        F.count(F.lit(1)).alias("high_risk_txn_count"),
        fn.exact_mean(F.col("risk_score"), 4).alias("avg_risk_score"),
    ).filter(F.col("high_risk_txn_count") >= least)
