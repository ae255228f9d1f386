"""Collecting values per sender into arrays, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def currencies_per_sender(df: DataFrame) -> DataFrame:
    """The set of currencies, the transaction types with their counts and the row count of each sender.

    The list of types is kept as (type, n) pairs: counted before the shuffle, so
    a sender with a third of all rows is still a handful of pairs.
    """
    pairs = df.groupBy("sender_account", "currency", "transaction_type").agg(F.count(F.lit(1)).alias("n"))
    types = pairs.groupBy("sender_account", "transaction_type").agg(
        F.sum("n").alias("n"), F.collect_set("currency").alias("_currencies"))
    return types.groupBy("sender_account").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_currencies")))).alias("currencies_used"),
        F.array_sort(F.collect_list(F.when(F.col("transaction_type").isNotNull(), F.struct("transaction_type", "n")))).alias("txn_types"),
        F.sum("n").alias("txn_count"),
    ).withColumns({"num_currencies": F.size("currencies_used"), "num_txn_types": F.size("txn_types")})


def multi_currency_senders(df: DataFrame) -> DataFrame:
    return currencies_per_sender(df).filter(F.col("num_currencies") > 1).orderBy(F.desc("num_currencies"), "sender_account")


def type_lists(df: DataFrame, chunk: int = 1000) -> DataFrame:
    """Every sender's sorted list of transaction types, one row per ``chunk`` elements.

    No row outgrows a chunk: each is cut out of the (type, n) pairs by position.
    """
    pairs = currencies_per_sender(df).select("sender_account", "txn_types", "txn_count")
    # Running end position of every type in the sorted list.
    spans = F.transform("txn_types", lambda t, i: F.struct(
        t["transaction_type"].alias("kind"), t["n"].alias("n"),
        F.aggregate(F.slice("txn_types", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("start")))
    total = F.aggregate("txn_types", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    rows = pairs.select("sender_account", spans.alias("spans"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(total, F.lit(1)) - 1) / chunk))).alias("chunk"))
    low, high = F.col("chunk") * chunk, (F.col("chunk") + 1) * chunk
    inside = F.transform("spans", lambda s: F.array_repeat(s["kind"], F.greatest(
        F.least(s["start"] + s["n"], high) - F.greatest(s["start"], low), F.lit(0)).cast("int")))
    return rows.select("sender_account", "chunk", F.flatten(inside).alias("txn_types_list"))


def sender_currency_rows(df: DataFrame) -> DataFrame:
    """The currency sets of multi-currency senders, back as rows."""
    return multi_currency_senders(df).select("sender_account", F.explode("currencies_used").alias("currency"))


def senders_using(df: DataFrame, currency: str) -> DataFrame:
    return currencies_per_sender(df).select(
        "sender_account", F.array_contains("currencies_used", currency).alias("uses_currency"))
