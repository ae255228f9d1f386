"""Window analytics: rankings, offsets, running totals and moving averages at any group size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from .ordered import ROWS_PER_SLICE, centred_mean, offset_and_running, rank_columns


def tie_break() -> Column:
    """Rows with equal ordering values are put in the order of this hash."""
    return F.md5("transaction_id")


def event_micros() -> Column:
    return F.unix_micros(fn.event_time(F.col("timestamp")))


def currency_ranks(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, base: DataFrame | None = None) -> DataFrame:
    """Rank rows by amount, largest first, within their currency."""
    ranked = rank_columns(df, ["currency"], F.col("amount"), tie_break(), True, rows_per_slice, base)
    return ranked.withColumnsRenamed({
        "row_number": "rank_by_amount", "rank": "rank_with_ties", "dense_rank": "dense_rank_amount",
    }).withColumn("pct_rank", F.round("percent_rank", 4)).drop("percent_rank")


def sender_history(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, base: DataFrame | None = None) -> DataFrame:
    """Previous and next amount, change and running total of each sender in time order."""
    history = offset_and_running(df, ["sender_account"], event_micros(), tie_break(), "amount",
                                 fn.money(F.col("amount")), rows_per_slice, base)
    amount = F.col("amount")
    return history.withColumnsRenamed({"previous": "prev_amount", "following": "next_amount"}).withColumns({
        "amount_delta": fn.difference(amount, F.coalesce("prev_amount", amount)),
        "running_total": F.col("running").cast("double"),
    }).drop("running")


def moving_average(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, base: DataFrame | None = None) -> DataFrame:
    """Mean amount over five consecutive rows of a currency in time order."""
    return centred_mean(df, ["currency"], event_micros(), tie_break(), fn.money(F.col("amount")),
                        "moving_avg_amount", 2, 2, rows_per_slice, base)


def window_analytics(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """All nine window columns: one shuffle per (key, order) pair."""
    result = df
    for step in (currency_ranks, sender_history, moving_average):
        result = step(result, rows_per_slice, df)
    return result


def top_per_currency(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest amounts per currency. The limit is applied before the shuffle, so hot keys stay small."""
    spec = Window.partitionBy("currency").orderBy(F.desc_nulls_last("amount"), tie_break())
    return df.withColumn("rank_by_amount", F.row_number().over(spec)).filter(F.col("rank_by_amount") <= n)


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row per key as an aggregate: partial results are merged before the shuffle, no sort of the group."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order))
    rows = df.groupBy(F.col(key).alias("_key")).agg(newest.alias("_row"), fn.by_hash().alias("_by_hash"))
    return rows.filter("size(_by_hash) > 0").select("_row.*")
