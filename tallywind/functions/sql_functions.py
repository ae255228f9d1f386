"""The same scalar functions registered under a name for SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SQL_FUNCTIONS = {
    "classify_risk": """(score DOUBLE) RETURNS STRING RETURN CASE
        WHEN score IS NULL THEN 'UNKNOWN' WHEN isnan(score) THEN 'NEGLIGIBLE'
        WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH'
        WHEN score >= 0.4 THEN 'MEDIUM' WHEN score >= 0.2 THEN 'LOW' ELSE 'NEGLIGIBLE' END""",
    "mask_account": """(account STRING) RETURNS STRING RETURN CASE
        WHEN length(account) >= 4 THEN concat(repeat('*', length(account) - 4), right(account, 4)) ELSE '****' END""",
    "compute_net_amount": """(amount DOUBLE, fee DOUBLE, rate DOUBLE) RETURNS DOUBLE RETURN coalesce(
        cast(round((try_cast(amount AS DECIMAL(24,8)) - try_cast(coalesce(fee, 0D) AS DECIMAL(24,8)))
                   * try_cast(coalesce(rate, 1D) AS DECIMAL(12,8)), 2) AS DOUBLE),
        round((amount - coalesce(fee, 0D)) * coalesce(rate, 1D), 2))""",
    "ip_to_int": r"""(ip STRING) RETURNS BIGINT RETURN try_add(try_add(try_add(
        try_multiply(try_cast(get(split(ip, '[.]'), 0) AS BIGINT), 16777216L), try_multiply(try_cast(get(split(ip, '[.]'), 1) AS BIGINT), 65536L)),
        try_multiply(try_cast(get(split(ip, '[.]'), 2) AS BIGINT), 256L)), try_cast(get(split(ip, '[.]'), 3) AS BIGINT))""",
    "log_amount": "(amount DOUBLE) RETURNS DOUBLE RETURN CASE WHEN amount > 0 THEN round(ln(amount), 4) END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the SQL functions in the session, and one Arrow-batched Python variant; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("mask_account_arrow", _arrow_mask())
    return [*SQL_FUNCTIONS, "mask_account_arrow"]


def _arrow_mask():
    """How a Python function is plugged in when no native expression exists: whole Arrow batches, never rows."""
    @F.pandas_udf(T.StringType())
    def mask(accounts: pd.Series) -> pd.Series:
        return accounts.str.replace(r"(?s).(?=.{4})", "*", regex=True).where(accounts.str.len().ge(4), "****")

    return mask
