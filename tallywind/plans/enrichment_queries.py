"""Enrichment and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import sql_functions
from ..operators import enrich as en
from ..sources import fixtures as fx
from .oracle import over_enriched, over_txn
from .registry import query


def _enriched_columns(name: str, columns: list[str]) -> None:
    """Register one group of enriched columns, keyed by transaction; Catalyst prunes all the others."""
    picked = ["transaction_id", *columns]

    @query(name, over_enriched(f"SELECT {', '.join(picked)} FROM enr"))
    def build(spark, sf_dir):
        return en.enrich(fx.transactions(spark, sf_dir)).select(*picked)


_enriched_columns("n1_currency_safe", ["currency_safe"])
_enriched_columns("n2_risk_score_safe", ["risk_score_safe"])
_enriched_columns("n3_memo_clean", ["memo_clean"])
_enriched_columns("n4_null_fills", ["fee", "exchange_rate", "sender_country", "receiver_country"])
_enriched_columns("d2_date_parts", ["txn_year", "txn_month", "txn_day", "txn_quarter"])
_enriched_columns("d3_hour", ["txn_hour"])
_enriched_columns("d4_day_of_week", ["txn_dayofweek"])
_enriched_columns("d5_is_weekend", ["is_weekend"])
_enriched_columns("d6_date_str", ["date_str"])
_enriched_columns("a1_amount_bucket", ["amount_bucket"])
_enriched_columns("a2_net_amount", ["net_amount"])
_enriched_columns("a3_fee_pct", ["fee_pct"])
_enriched_columns("a4_amount_usd", ["amount_usd"])
_enriched_columns("a5_log_amount", ["log_amount"])
_enriched_columns("r1_risk_tier", ["risk_tier"])
_enriched_columns("r2_risk_level", ["risk_level"])
_enriched_columns("r3_needs_review", ["needs_review"])
_enriched_columns("g1_is_cross_border", ["is_cross_border"])
_enriched_columns("g2_corridor", ["corridor"])
_enriched_columns("g3_is_intra_bank", ["is_intra_bank"])
_enriched_columns("p1_name_hashes", ["sender_hash", "receiver_hash"])
_enriched_columns("p2_masked_accounts", ["sender_account_masked", "receiver_account_masked"])
_enriched_columns("p3_ip_anonymized", ["ip_anonymized"])
_enriched_columns("f1_device_short_id", ["device_short_id"])
_enriched_columns("f2_session_prefix", ["session_prefix"])
_enriched_columns("f3_memo_length", ["memo_length"])
_enriched_columns("f4_has_memo", ["has_memo"])
_enriched_columns("f5_row_id", ["row_id"])


@query("d1_transaction_date", over_enriched("SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date FROM enr"))
def transaction_date(spark, sf_dir):
    return en.time_dimensions(fx.transactions(spark, sf_dir)).select(
        "transaction_id", F.col("transaction_date").cast("string").alias("transaction_date"))


# The same instant written in four ISO forms, and once unreadably.
_FORMS = ("CASE CAST(SUBSTR(reference_id, 5) AS BIGINT) % 5 WHEN 0 THEN timestamp WHEN 1 THEN REPLACE(timestamp, '+00:00', 'Z') "
          "WHEN 2 THEN REPLACE(timestamp, '+00:00', '') WHEN 3 THEN REPLACE(timestamp, '+00:00', '.250000-05:00') "
          "ELSE CONCAT('at ', timestamp) END")


@query("d7_timestamp_forms", over_txn("""SELECT transaction_id,
 CASE CAST(SUBSTR(reference_id, 5) AS BIGINT) % 5
  WHEN 4 THEN NULL
  WHEN 3 THEN strftime(CAST(REPLACE(SUBSTR(timestamp, 1, 19), 'T', ' ') AS TIMESTAMP) + INTERVAL '5' HOUR, '%Y-%m-%d %H:%M:%S')
  ELSE REPLACE(SUBSTR(timestamp, 1, 19), 'T', ' ') END AS event_time
 FROM txn"""))
def timestamp_forms(spark, sf_dir):
    txn = fx.transactions(spark, sf_dir).select("transaction_id", F.expr(_FORMS).alias("text"))
    return txn.select("transaction_id", F.date_format(fn.event_time(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("a6_backfill_bucket", over_txn("""SELECT transaction_id, CASE WHEN amount < 100 THEN 'MICRO' WHEN amount < 10000 THEN 'SMALL'
 WHEN amount < 100000 THEN 'MEDIUM' ELSE 'LARGE' END AS amount_bucket FROM txn"""))
def backfill_bucket(spark, sf_dir):
    return en.backfill(fx.transactions(spark, sf_dir)).select("transaction_id", "amount_bucket")


@query("a7_backfill_enrichment", over_enriched("""SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, txn_year, txn_month,
 CASE WHEN amount < 100 THEN 'MICRO' WHEN amount < 10000 THEN 'SMALL' WHEN amount < 100000 THEN 'MEDIUM' ELSE 'LARGE' END AS amount_bucket
 FROM enr"""))
def backfill_enrichment(spark, sf_dir):
    return en.backfill(fx.transactions(spark, sf_dir)).select(
        "transaction_id", F.col("transaction_date").cast("string").alias("transaction_date"),
        "txn_year", "txn_month", "amount_bucket")


@query("x1_enriched_transactions", over_enriched("SELECT * REPLACE (CAST(transaction_date AS VARCHAR) AS transaction_date) FROM enr"))
def enriched_transactions(spark, sf_dir):
    enriched = en.enrich(fx.transactions(spark, sf_dir))
    return enriched.withColumn("transaction_date", F.col("transaction_date").cast("string"))


def _function(name: str, oracle: str, expression: str) -> None:
    """Register a scalar function called by its SQL name."""

    @query(name, over_txn(f"SELECT transaction_id, {oracle} AS result FROM txn"))
    def build(spark, sf_dir) -> DataFrame:
        sql_functions.register(spark)
        return fx.transactions(spark, sf_dir).selectExpr("transaction_id", f"{expression} AS result")


_MASKED = ("CASE WHEN sender_account IS NULL OR LENGTH(sender_account) < 4 THEN '****' "
           "ELSE CONCAT(REPEAT('*', LENGTH(sender_account) - 4), RIGHT(sender_account, 4)) END")
_NET = ("CAST(ROUND((CAST(amount AS DECIMAL(24,8)) - CAST(COALESCE(fee, 0) AS DECIMAL(24,8))) "
        "* CAST(COALESCE(exchange_rate, 1) AS DECIMAL(12,8)), 2) AS DOUBLE)")
_IP = ("CAST(SPLIT_PART(ip_address, '.', 1) AS BIGINT) * 16777216 + CAST(SPLIT_PART(ip_address, '.', 2) AS BIGINT) * 65536 "
       "+ CAST(SPLIT_PART(ip_address, '.', 3) AS BIGINT) * 256 + CAST(SPLIT_PART(ip_address, '.', 4) AS BIGINT)")
_TIER = ("CASE WHEN risk_score IS NULL THEN 'UNKNOWN' WHEN risk_score >= 0.8 THEN 'CRITICAL' WHEN risk_score >= 0.6 THEN 'HIGH' "
         "WHEN risk_score >= 0.4 THEN 'MEDIUM' WHEN risk_score >= 0.2 THEN 'LOW' ELSE 'NEGLIGIBLE' END")

_function("u1_classify_risk", _TIER, "classify_risk(risk_score)")
_function("u2_mask_account", _MASKED, "mask_account(sender_account)")
_function("u3_compute_net_amount", _NET, "compute_net_amount(amount, fee, exchange_rate)")
_function("u4_ip_to_int", _IP, "ip_to_int(ip_address)")
_function("u5_log_amount", "CASE WHEN amount > 0 THEN ROUND(LN(amount), 4) END", "log_amount(amount)")
_function("u6_arrow_function", _MASKED, "mask_account_arrow(sender_account)")
