"""SQL text: the analytics statements, the preset queries of both tables and ad-hoc SQL over a view."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def _sum(column: str) -> str:
    """Sum in decimals, so that the order of the rows does not show and nothing is rounded before it; in doubles where a value has no decimal form."""
    exact = f"TRY_CAST({column} AS DECIMAL(28,8))"
    return f"CASE WHEN COUNT_IF({column} IS NOT NULL AND {exact} IS NULL) = 0 THEN CAST(TRY_SUM({exact}) AS DOUBLE) ELSE SUM({column}) END"


def _mean(column: str, digits: int = 2) -> str:
    exact = f"TRY_CAST({column} AS DECIMAL(28,8))"
    total = f"TRY_CAST(TRY_SUM({exact}) AS DECIMAL(30,8))"
    return (f"CASE WHEN COUNT_IF({column} IS NOT NULL AND {exact} IS NULL) = 0 THEN CAST(ROUND(TRY_DIVIDE({total}, CAST(COUNT({column}) AS DECIMAL(18,0))), {digits}) AS DOUBLE) "
            f"ELSE ROUND(AVG({column}), {digits}) END")


# The analytics statements.
TOP_CORRIDORS = f"""
SELECT sender_country, receiver_country, COUNT(*) AS txn_count,
       {_sum('amount')} AS total_volume, {_mean('amount')} AS avg_amount, {_mean('risk_score', 4)} AS avg_risk
FROM {{txn}}
WHERE sender_country <> receiver_country
GROUP BY sender_country, receiver_country
HAVING COUNT(*) >= 5
ORDER BY total_volume DESC, sender_country, receiver_country
LIMIT 20"""

FLAGGED_BY_CHANNEL = """
SELECT channel, COUNT(1) AS total, COUNT_IF(is_flagged) AS flagged,
       CAST(ROUND(AVG(CAST(IF(is_flagged, 100, 0) AS DECIMAL(18,10))), 2) AS DOUBLE) AS flagged_pct
FROM {txn}
GROUP BY ALL
ORDER BY flagged_pct DESC, channel"""

# Preset name -> statement. Every limited one has a full ordering, so its rows are fixed.
TRANSACTION_PRESETS = {
    "row_count": "SELECT COUNT(*) AS total_rows FROM {txn}",
    "by_currency": f"SELECT currency, COUNT(*) AS cnt, {_mean('amount')} AS avg_amt FROM {{txn}} GROUP BY currency ORDER BY cnt DESC, currency",
    "by_status": "SELECT status, COUNT(*) AS cnt FROM {txn} GROUP BY status ORDER BY cnt DESC, status",
    "by_transaction_type": f"SELECT transaction_type, COUNT(*) AS cnt, {_sum('amount')} AS total_volume "
                           "FROM {txn} GROUP BY transaction_type ORDER BY total_volume DESC, transaction_type",
    "flagged": "SELECT * FROM {txn} WHERE is_flagged = true ORDER BY transaction_id LIMIT 20",
    "top_amounts": "SELECT transaction_id, amount, currency, sender_name, receiver_name FROM {txn} "
                   "ORDER BY amount DESC NULLS LAST, transaction_id LIMIT 20",
    "hourly_volume": "SELECT EXTRACT(HOUR FROM TRY_CAST(timestamp AS TIMESTAMP)) AS hour, COUNT(*) AS cnt FROM {txn} GROUP BY 1 ORDER BY hour",
    "count_by_currency": "SELECT currency, COUNT(*) AS cnt FROM {txn} GROUP BY currency ORDER BY cnt DESC, currency",
}

ACCOUNT_PRESETS = {
    "row_count": "SELECT COUNT(*) AS total_rows FROM {txn}",
    "by_country": "SELECT country, COUNT(*) AS cnt FROM {txn} GROUP BY country ORDER BY cnt DESC, country",
    "by_currency": f"SELECT currency, COUNT(*) AS cnt, {_mean('balance')} AS avg_balance FROM {{txn}} GROUP BY currency ORDER BY cnt DESC, currency",
    "by_account_type": f"SELECT account_type, COUNT(*) AS cnt, {_mean('balance')} AS avg_balance FROM {{txn}} "
                       "GROUP BY account_type ORDER BY cnt DESC, account_type",
    "by_status": "SELECT account_status, COUNT(*) AS cnt FROM {txn} GROUP BY account_status ORDER BY cnt DESC, account_status",
    "top_balances": "SELECT account_id, holder_name, balance, currency, country FROM {txn} ORDER BY balance DESC NULLS LAST, account_id LIMIT 20",
    "high_risk": "SELECT account_id, holder_name, risk_rating, balance, country FROM {txn} WHERE risk_rating > 0.7 "
                 "ORDER BY risk_rating DESC, account_id LIMIT 20",
    "most_transactions": "SELECT account_id, holder_name, transaction_count, total_sent, total_received FROM {txn} "
                         "ORDER BY transaction_count DESC, account_id LIMIT 20",
}


def run_preset(df: DataFrame, statement: str) -> DataFrame:
    """Run a statement with ``{txn}`` standing for the table."""
    return df.sparkSession.sql(statement, txn=df)


def top_corridors(df: DataFrame) -> DataFrame:
    return run_preset(df, TOP_CORRIDORS)


def flagged_by_channel(df: DataFrame) -> DataFrame:
    return run_preset(df, FLAGGED_BY_CHANNEL)


def ad_hoc(spark: SparkSession, df: DataFrame, statement: str, limit: int = 50) -> DataFrame:
    """Run user SQL in which the table is called ``txn``; the shown rows are capped, the query is not."""
    df.createOrReplaceTempView("txn")
    return spark.sql(statement).limit(limit)


def as_view(df: DataFrame, name: str | None = None) -> str:
    """Register a table for SQL under ``name``, or under a fresh one."""
    name = name or f"view_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(name)
    return name
