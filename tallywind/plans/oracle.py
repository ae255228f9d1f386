"""Building blocks of the oracle statements, in the SQL dialect of the checking engine."""

from __future__ import annotations

from ..sources import fixtures as fx


def _cols(items: list[str]) -> str:
    return ",\n  ".join(items)


TXN = f"""base_rows AS (SELECT {_cols(fx.ROW_COLUMNS)}
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
keyed_rows AS (SELECT {_cols(fx.KEY_COLUMNS)} FROM base_rows),
txn AS (SELECT {_cols(fx.TXN_COLUMNS)} FROM keyed_rows)"""

_SIDE = ("SELECT transaction_id, timestamp, amount, {p}_account_id AS account_id, {p}_account AS account_number, "
         "{p}_name AS holder_name, '{d}' AS dir FROM txn")
ACCT = f"""acct_sides AS ({_SIDE.format(p='sender', d='S')} UNION ALL {_SIDE.format(p='receiver', d='R')}),
acct AS (SELECT {_cols(fx.ACCT_COLUMNS)} FROM (SELECT *, CAST(SUBSTR(account_number, 5) AS INT) AS a FROM acct_sides))"""

BATCHES = f"""batch_rows AS (SELECT timestamp, amount, {_cols(fx.BATCH_KEYS)} FROM txn),
batch_sums AS (SELECT run_id, batch_id, {_cols(fx.BATCH_SUMS)} FROM batch_rows GROUP BY run_id, batch_id),
bm AS (SELECT {_cols(fx.BATCH_COLUMNS)} FROM batch_sums)"""

ENRICHED = """filled AS (SELECT * REPLACE (
   COALESCE(fee, 0.0) AS fee, COALESCE(exchange_rate, 1.0) AS exchange_rate,
   COALESCE(sender_country, 'XX') AS sender_country, COALESCE(receiver_country, 'XX') AS receiver_country),
  COALESCE(currency, 'USD') AS currency_safe,
  COALESCE(risk_score, 0.0) AS risk_score_safe,
  CASE WHEN memo IS NULL THEN '(no memo)' ELSE TRIM(memo) END AS memo_clean,
  CAST(REPLACE(SUBSTR(timestamp, 1, 19), 'T', ' ') AS TIMESTAMP) AS moment FROM txn),
enr AS (SELECT * EXCLUDE (moment),
  CAST(moment AS DATE) AS transaction_date, year(moment) AS txn_year, month(moment) AS txn_month, day(moment) AS txn_day,
  hour(moment) AS txn_hour, dayofweek(moment) + 1 AS txn_dayofweek, COALESCE(dayofweek(moment) IN (0, 6), FALSE) AS is_weekend,
  quarter(moment) AS txn_quarter, strftime(moment, '%Y-%m-%d') AS date_str,
  CASE WHEN amount < 100 THEN 'MICRO' WHEN amount < 1000 THEN 'SMALL' WHEN amount < 10000 THEN 'MEDIUM'
       WHEN amount < 100000 THEN 'LARGE' ELSE 'WHALE' END AS amount_bucket,
  CAST(ROUND(CAST(amount AS DECIMAL(24,8)) - CAST(fee AS DECIMAL(24,8)), 2) AS DOUBLE) AS net_amount,
  CASE WHEN amount > 0 THEN ROUND(fee / amount * 100, 4) END AS fee_pct,
  CAST(ROUND(CAST(amount AS DECIMAL(24,8)) * CAST(exchange_rate AS DECIMAL(12,8)), 2) AS DOUBLE) AS amount_usd,
  CASE WHEN amount > 0 THEN ROUND(LN(amount), 4) END AS log_amount,
  CASE WHEN risk_score IS NULL THEN 'UNKNOWN' WHEN risk_score >= 0.8 THEN 'CRITICAL' WHEN risk_score >= 0.6 THEN 'HIGH'
       WHEN risk_score >= 0.4 THEN 'MEDIUM' WHEN risk_score >= 0.2 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS risk_tier,
  CASE WHEN risk_score >= 0.8 THEN 5 WHEN risk_score >= 0.6 THEN 4 WHEN risk_score >= 0.4 THEN 3
       WHEN risk_score >= 0.2 THEN 2 WHEN risk_score >= 0 THEN 1 ELSE 0 END AS risk_level,
  (risk_score >= 0.7 OR is_flagged OR amount >= 100000) AS needs_review,
  sender_country <> receiver_country AS is_cross_border,
  CONCAT(UPPER(sender_country), chr(8594), UPPER(receiver_country)) AS corridor,
  sender_bank_code = receiver_bank_code AS is_intra_bank,
  sha256(sender_name) AS sender_hash, sha256(receiver_name) AS receiver_hash,
  CASE WHEN sender_account IS NULL OR LENGTH(sender_account) < 4 THEN '****'
       ELSE CONCAT(REPEAT('*', LENGTH(sender_account) - 4), RIGHT(sender_account, 4)) END AS sender_account_masked,
  CASE WHEN receiver_account IS NULL OR LENGTH(receiver_account) < 4 THEN '****'
       ELSE CONCAT(REPEAT('*', LENGTH(receiver_account) - 4), RIGHT(receiver_account, 4)) END AS receiver_account_masked,
  regexp_replace(ip_address, '\\.[0-9]+$', '.xxx') AS ip_anonymized,
  SUBSTR(device_fingerprint, 1, 8) AS device_short_id, SUBSTR(session_id, 1, 8) AS session_prefix,
  LENGTH(memo) AS memo_length, (memo IS NOT NULL AND LENGTH(memo) > 0) AS has_memo,
  sha256(transaction_id) AS row_id
 FROM filled)"""


def over_txn(query: str) -> str:
    return f"WITH {TXN}\n{query}"


def over_acct(query: str) -> str:
    """``query`` may begin with further ``name AS (...)`` parts after a comma."""
    return f"WITH {TXN},\n{ACCT}\n{query}"


def over_enriched(query: str) -> str:
    return f"WITH {TXN},\n{ENRICHED}\n{query}"


def over_batches(query: str) -> str:
    return f"WITH {TXN},\n{BATCHES}\n{query}"


def total(expr: str, where: str = "") -> str:
    """Exact sum of a two-digit money column, as a double."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,2))){where} AS DOUBLE)"


def mean(expr: str, digits: int = 2, scale: int = 2) -> str:
    """Mean rounded half up, in integers. ``expr`` has ``scale`` decimal digits and is never negative."""
    unit = f"CAST(SUM(CAST(ROUND({expr} * {10 ** scale}) AS BIGINT)) AS HUGEINT)"
    up, down = (10 ** (digits - scale), 1) if digits >= scale else (1, 10 ** (scale - digits))
    return (f"(CAST((2 * {unit} * {up} + COUNT({expr}) * {down}) // (2 * COUNT({expr}) * {down}) AS DOUBLE) / {10 ** digits}.0)")


# Order used wherever several rows may share the ordering value.
TIE = "MD5(transaction_id)"
