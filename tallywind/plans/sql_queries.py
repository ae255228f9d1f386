"""SQL statements over the transaction and account tables."""

from __future__ import annotations

from ..operators import upsert as up
from ..operators import enrich as en
from ..sources import fixtures as fx
from . import presets
from .oracle import mean, over_acct, over_enriched, over_txn, total
from .registry import query


@query("l1_top_corridors", over_txn(f"""SELECT sender_country, receiver_country, COUNT(*) AS txn_count, {total('amount')} AS total_volume,
 {mean('amount')} AS avg_amount, {mean('risk_score', 4, 3)} AS avg_risk FROM txn WHERE sender_country <> receiver_country
 GROUP BY sender_country, receiver_country HAVING COUNT(*) >= 5 ORDER BY total_volume DESC, sender_country, receiver_country LIMIT 20"""))
def top_corridors(spark, sf_dir):
    return presets.top_corridors(fx.transactions(spark, sf_dir))


@query("l1_enriched_corridors", over_enriched(f"""SELECT sender_country, receiver_country, COUNT(*) AS txn_count, {total('amount')} AS total_volume,
 {mean('amount')} AS avg_amount, {mean('risk_score', 4, 3)} AS avg_risk FROM enr WHERE sender_country <> receiver_country
 GROUP BY sender_country, receiver_country HAVING COUNT(*) >= 5 ORDER BY total_volume DESC, sender_country, receiver_country LIMIT 20"""))
def enriched_corridors(spark, sf_dir):
    return presets.top_corridors(en.enrich(fx.transactions(spark, sf_dir)))


@query("l2_flagged_by_channel", over_txn("""SELECT channel, COUNT(*) AS total, CAST(COUNT(*) FILTER (WHERE is_flagged) AS BIGINT) AS flagged,
 CAST((2 * COUNT(*) FILTER (WHERE is_flagged) * 10000 + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 100 AS flagged_pct FROM txn GROUP BY channel"""))
def flagged_by_channel(spark, sf_dir):
    return presets.flagged_by_channel(fx.transactions(spark, sf_dir))


def _transactions(name: str, preset: str, oracle: str) -> None:
    @query(name, over_txn(oracle))
    def build(spark, sf_dir):
        return presets.run_preset(fx.transactions(spark, sf_dir), presets.TRANSACTION_PRESETS[preset])


_transactions("l3_row_count", "row_count", "SELECT COUNT(*) AS total_rows FROM txn")
_transactions("l4_by_currency", "by_currency", f"SELECT currency, COUNT(*) AS cnt, {mean('amount')} AS avg_amt FROM txn GROUP BY currency")
_transactions("l5_by_status", "by_status", "SELECT status, COUNT(*) AS cnt FROM txn GROUP BY status")
_transactions("l6_by_transaction_type", "by_transaction_type",
              f"SELECT transaction_type, COUNT(*) AS cnt, {total('amount')} AS total_volume FROM txn GROUP BY transaction_type")
_transactions("l7_flagged", "flagged", "SELECT * FROM txn WHERE is_flagged ORDER BY transaction_id LIMIT 20")
_transactions("l8_top_amounts", "top_amounts",
              "SELECT transaction_id, amount, currency, sender_name, receiver_name FROM txn ORDER BY amount DESC NULLS LAST, transaction_id LIMIT 20")
_transactions("l9_hourly_volume", "hourly_volume",
              "SELECT CAST(SUBSTR(timestamp, 12, 2) AS INT) AS hour, COUNT(*) AS cnt FROM txn GROUP BY ALL")
_transactions("l18_count_by_currency", "count_by_currency", "SELECT currency, COUNT(*) AS cnt FROM txn GROUP BY currency")

# The account table as one fold over all events.
_ACCOUNTS = f"""accounts AS (SELECT account_id, ANY_VALUE(holder_name) AS holder_name, ANY_VALUE(country) AS country,
 ANY_VALUE(currency) AS currency, ANY_VALUE(account_type) AS account_type,
 ARG_MAX(account_status, (updated_at, event_id)) AS account_status, ARG_MAX(balance, (updated_at, event_id)) AS balance,
 ARG_MAX(risk_rating, (updated_at, event_id)) AS risk_rating, ARG_MAX(kyc_level, (updated_at, event_id)) AS kyc_level,
 {total('total_sent')} AS total_sent, {total('total_received')} AS total_received, COUNT(*) AS transaction_count FROM acct GROUP BY account_id)"""


def _accounts(name: str, preset: str, oracle: str) -> None:
    @query(name, over_acct(f", {_ACCOUNTS}\n{oracle}"))
    def build(spark, sf_dir):
        return presets.run_preset(up.batch_source(fx.account_events(spark, sf_dir)), presets.ACCOUNT_PRESETS[preset])


_accounts("l3_account_row_count", "row_count", "SELECT COUNT(*) AS total_rows FROM accounts")
_accounts("l10_accounts_by_country", "by_country", "SELECT country, COUNT(*) AS cnt FROM accounts GROUP BY country")
_accounts("l11_accounts_by_currency", "by_currency", f"SELECT currency, COUNT(*) AS cnt, {mean('balance')} AS avg_balance FROM accounts GROUP BY currency")
_accounts("l12_accounts_by_type", "by_account_type",
          f"SELECT account_type, COUNT(*) AS cnt, {mean('balance')} AS avg_balance FROM accounts GROUP BY account_type")
_accounts("l13_accounts_by_status", "by_status", "SELECT account_status, COUNT(*) AS cnt FROM accounts GROUP BY account_status")
_accounts("l14_top_balances", "top_balances",
          "SELECT account_id, holder_name, balance, currency, country FROM accounts ORDER BY balance DESC NULLS LAST, account_id LIMIT 20")
_accounts("l15_high_risk_accounts", "high_risk",
          "SELECT account_id, holder_name, risk_rating, balance, country FROM accounts WHERE risk_rating > 0.7 ORDER BY risk_rating DESC, account_id LIMIT 20")
_accounts("l16_most_transactions", "most_transactions",
          "SELECT account_id, holder_name, transaction_count, total_sent, total_received FROM accounts ORDER BY transaction_count DESC, account_id LIMIT 20")


@query("l17_ad_hoc_sql", over_txn("""SELECT category, channel, COUNT(*) AS n, COUNT(DISTINCT currency) AS currencies
 FROM txn WHERE fee IS NOT NULL GROUP BY category, channel ORDER BY category, channel LIMIT 50"""))
def ad_hoc(spark, sf_dir):
    return presets.ad_hoc(spark, fx.transactions(spark, sf_dir), """SELECT category, channel, COUNT(*) AS n, COUNT(DISTINCT currency) AS currencies
      FROM txn WHERE fee IS NOT NULL GROUP BY category, channel ORDER BY category, channel""", 50)
