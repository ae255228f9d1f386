"""Windows, aggregates, pivots, joins, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import arrays as ar
from ..operators import enrich as en
from ..operators import joins as jn
from ..operators import upsert as up
from ..operators import windows as wn
from ..operators.ordered import quantiles
from ..session import stage
from ..sources import fixtures as fx
from ..sources.schemas import CATEGORIES, STATUSES, TRANSACTION_TYPES
from .oracle import TIE, mean, over_acct, over_enriched, over_txn, total
from .registry import query

# Small slices, so that the checks at every scale go through several cells per key.
SLICE = 10_000

_BY_AMOUNT = f"PARTITION BY currency ORDER BY amount DESC NULLS LAST, {TIE}"
_PEERS = "PARTITION BY currency ORDER BY amount DESC NULLS LAST"
_HISTORY = f"PARTITION BY sender_account ORDER BY timestamp, {TIE}"
_NEARBY = f"PARTITION BY currency ORDER BY timestamp, {TIE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"
_MOVING = (f"CAST((2 * SUM(CAST(ROUND(amount * 100) AS BIGINT)) OVER ({_NEARBY}) + COUNT(amount) OVER ({_NEARBY})) "
           f"// (2 * COUNT(amount) OVER ({_NEARBY})) AS DOUBLE) / 100.0")
_PREV = f"LAG(amount) OVER ({_HISTORY})"
_DELTA = f"CAST(CAST(amount AS DECIMAL(24,8)) - CAST(COALESCE({_PREV}, amount) AS DECIMAL(24,8)) AS DOUBLE)"
_RUNNING = f"CAST(SUM(CAST(amount AS DECIMAL(18,2))) OVER ({_HISTORY} ROWS UNBOUNDED PRECEDING) AS DOUBLE)"


def _window(name: str, operator, columns: dict[str, str]) -> None:
    texts = ", ".join(f"{sql} AS {column}" for column, sql in columns.items())

    @query(name, over_txn(f"SELECT transaction_id, {texts} FROM txn"))
    def build(spark, sf_dir):
        return operator(fx.transactions(spark, sf_dir), SLICE).select("transaction_id", *columns)


_window("w1_row_number", wn.currency_ranks, {"rank_by_amount": f"ROW_NUMBER() OVER ({_BY_AMOUNT})"})
_window("w2_rank", wn.currency_ranks, {"rank_with_ties": f"RANK() OVER ({_PEERS})"})
_window("w3_dense_rank", wn.currency_ranks, {"dense_rank_amount": f"DENSE_RANK() OVER ({_PEERS})"})
_window("w4_lag", wn.sender_history, {"prev_amount": _PREV})
_window("w5_lead", wn.sender_history, {"next_amount": f"LEAD(amount) OVER ({_HISTORY})"})
_window("w6_amount_delta", wn.sender_history, {"amount_delta": _DELTA})
_window("w7_running_total", wn.sender_history, {"running_total": _RUNNING})
_window("w8_moving_average", wn.moving_average, {"moving_avg_amount": _MOVING})
_window("w9_percent_rank", wn.currency_ranks, {"pct_rank": f"ROUND(PERCENT_RANK() OVER ({_PEERS}), 4)"})
_window("w_all_window_columns", wn.window_analytics, {
    "rank_by_amount": f"ROW_NUMBER() OVER ({_BY_AMOUNT})", "rank_with_ties": f"RANK() OVER ({_PEERS})",
    "dense_rank_amount": f"DENSE_RANK() OVER ({_PEERS})", "prev_amount": _PREV,
    "next_amount": f"LEAD(amount) OVER ({_HISTORY})", "amount_delta": _DELTA, "running_total": _RUNNING,
    "moving_avg_amount": _MOVING, "pct_rank": f"ROUND(PERCENT_RANK() OVER ({_PEERS}), 4)"})


@query("w10_top_three_per_currency", over_txn(
    f"SELECT currency, rank_by_amount, transaction_id, amount, transaction_type FROM "
    f"(SELECT *, ROW_NUMBER() OVER ({_BY_AMOUNT}) AS rank_by_amount FROM txn) WHERE rank_by_amount <= 3"))
def top_three(spark, sf_dir):
    return wn.top_per_currency(fx.transactions(spark, sf_dir)).select(
        "currency", "rank_by_amount", "transaction_id", "amount", "transaction_type")


@query("w11_latest_per_account", over_acct(
    "SELECT account_id, event_id, balance, account_status, updated_at FROM (SELECT *, ROW_NUMBER() OVER "
    "(PARTITION BY account_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM acct) WHERE rn = 1"))
def latest_per_account(spark, sf_dir):
    events = fx.account_events(spark, sf_dir).select("account_id", "event_id", "balance", "account_status", "updated_at")
    return wn.latest_per_key(events, "account_id", "updated_at", "event_id")


@query("q1_currency_summary", over_txn(f"""SELECT currency, COUNT(*) AS txn_count, {total('amount')} AS total_volume,
 {mean('amount')} AS avg_amount, MIN(amount) AS min_amount, MAX(amount) AS max_amount, ROUND(STDDEV_SAMP(amount), 2) AS stddev_amount,
 {mean('fee')} AS avg_fee, {mean('risk_score', 4, 3)} AS avg_risk, CAST(COUNT(*) FILTER (WHERE is_flagged) AS BIGINT) AS flagged_count
 FROM txn GROUP BY currency"""))
def currency_summary(spark, sf_dir):
    return ag.currency_summary(fx.transactions(spark, sf_dir))


@query("q2_distinct_senders", over_txn("SELECT currency, COUNT(DISTINCT sender_account) AS unique_senders FROM txn GROUP BY currency"))
def distinct_senders(spark, sf_dir):
    return ag.distinct_per_group(fx.transactions(spark, sf_dir), "currency", "sender_account", "unique_senders")


@query("q3_approx_distinct_receivers", over_txn(
    "SELECT currency, COUNT(DISTINCT receiver_account) AS unique_receivers, TRUE AS approx_within_bound FROM txn GROUP BY currency"))
def approx_distinct_receivers(spark, sf_dir):
    txn = fx.transactions(spark, sf_dir)
    exact = ag.distinct_per_group(txn, "currency", "receiver_account", "unique_receivers")
    approx = ag.approx_distinct_per_group(txn, "currency", "receiver_account", "approx_unique_receivers")
    return exact.join(approx, "currency").select(
        "currency", "unique_receivers",
        (F.abs(F.col("approx_unique_receivers") - F.col("unique_receivers")) <= 3 * 0.05 * F.col("unique_receivers")).alias("approx_within_bound"))


_PERCENTILES = {"median_amount": 0.5, "p95_amount": 0.95, "p99_amount": 0.99}
_DISC = ", ".join(f"QUANTILE_DISC(amount, {p}) AS {n}" for n, p in _PERCENTILES.items())


@query("q4_percentiles", over_txn(f"SELECT currency, {_DISC}, TRUE AS approx_within_bound FROM txn GROUP BY currency"))
def percentiles(spark, sf_dir):
    """The sketch's percentiles, checked against the exact ones: their share of smaller rows is at most 0.001 off."""
    txn = fx.transactions(spark, sf_dir)
    wanted = {n: max(0.0, min(1.0, p + shift)) for name, p in _PERCENTILES.items()
              for n, shift in ((name, 0.0), (f"low_{name}", -0.001), (f"high_{name}", 0.001))}
    exact = quantiles(txn, ["currency"], "amount", wanted, False, SLICE)
    approx = ag.approx_percentiles(txn, "currency", "amount", {f"approx_{n}": p for n, p in _PERCENTILES.items()})
    within = F.lit(True)
    for n in _PERCENTILES:
        within = within & F.col(f"approx_{n}").between(F.col(f"low_{n}"), F.col(f"high_{n}"))
    return exact.join(approx, "currency").select("currency", *_PERCENTILES, within.alias("approx_within_bound"))


@query("q5_currency_by_type", over_txn(f"""SELECT currency, transaction_type, COUNT(*) AS count, {mean('amount')} AS avg_amount,
 {total('amount')} AS total_amount FROM txn GROUP BY currency, transaction_type"""))
def currency_by_type(spark, sf_dir):
    return ag.cross_summary(fx.transactions(spark, sf_dir))


@query("q6_hourly_volume", over_enriched(f"SELECT txn_hour, COUNT(*) AS txn_count, {total('amount')} AS volume FROM enr GROUP BY txn_hour"))
def hourly_volume(spark, sf_dir):
    return ag.hourly_volume(en.time_dimensions(fx.transactions(spark, sf_dir)))


def _pivoted(cell, column, values):
    return ", ".join(f"COALESCE({cell.format(f'''{column} = '{v}' ''')}, 0) AS \"{v}\"" for v in values)


@query("q7_type_count_pivot", over_txn(
    f"SELECT currency, {_pivoted('COUNT(*) FILTER (WHERE {})', 'transaction_type', TRANSACTION_TYPES)} FROM txn GROUP BY currency"))
def type_count_pivot(spark, sf_dir):
    return ag.type_counts(fx.transactions(spark, sf_dir))


@query("q8_status_volume_pivot", over_txn(
    "SELECT currency, " + _pivoted("CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE {}) AS DOUBLE)", "status", STATUSES)
    + " FROM txn GROUP BY currency"))
def status_volume_pivot(spark, sf_dir):
    return ag.status_volumes(fx.transactions(spark, sf_dir))


def _category_mean(value):
    return mean(f"CASE WHEN category = '{value}' THEN amount END") + f' AS "{value}"'


@query("q9_category_mean_pivot", over_txn(f"SELECT channel, {', '.join(_category_mean(v) for v in CATEGORIES)} FROM txn GROUP BY channel"))
def category_mean_pivot(spark, sf_dir):
    return ag.category_means(fx.transactions(spark, sf_dir))


_RISKY = f"""SELECT sender_account, COUNT(*) AS high_risk_txn_count, {mean('risk_score', 4, 3)} AS avg_risk_score
 FROM txn WHERE risk_score >= 0.7 GROUP BY sender_account HAVING COUNT(*) >= 2"""


@query("q10_repeat_risk_senders", over_txn(_RISKY))
def repeat_risk_senders(spark, sf_dir):
    return ag.risky_senders(fx.transactions(spark, sf_dir))


@query("q_currency_statistics", over_txn(f"""SELECT currency, COUNT(*) AS txn_count, COUNT(DISTINCT sender_account) AS unique_senders,
 {total('amount')} AS total_volume, {mean('amount')} AS avg_amount, MIN(amount) AS min_amount, MAX(amount) AS max_amount,
 {mean('fee')} AS avg_fee, {mean('risk_score', 4, 3)} AS avg_risk, CAST(COUNT(*) FILTER (WHERE is_flagged) AS BIGINT) AS flagged_count,
 {_DISC}, ROUND(STDDEV_SAMP(amount), 2) AS stddev_amount, TRUE AS receivers_within_bound
 FROM txn GROUP BY currency"""))
def currency_statistics(spark, sf_dir):
    """Every column of the report; up to the size of a sketch its percentiles are exact."""
    txn = fx.transactions(spark, sf_dir)
    exact = ag.distinct_per_group(txn, "currency", "receiver_account", "receivers")
    near = F.abs(F.col("approx_unique_receivers") - F.col("receivers")) <= 3 * 0.05 * F.col("receivers")
    return ag.currency_statistics(txn).join(exact, "currency").select(
        "currency", "txn_count", "unique_senders", "total_volume", "avg_amount", "min_amount", "max_amount",
        "avg_fee", "avg_risk", "flagged_count", *_PERCENTILES, F.round("stddev_amount", 2).alias("stddev_amount"), near.alias("receivers_within_bound"))


@query("j1_repeat_offender_tag", over_txn(f"""SELECT transaction_id, high_risk_txn_count, avg_risk_score,
 high_risk_txn_count IS NOT NULL AS sender_is_repeat_offender FROM txn LEFT JOIN ({_RISKY}) USING (sender_account)"""))
def repeat_offender_tag(spark, sf_dir):
    return jn.tag_repeat_offenders(fx.transactions(spark, sf_dir)).select(
        "transaction_id", "high_risk_txn_count", "avg_risk_score", "sender_is_repeat_offender")


@query("j2_circular_semi_join", over_txn(
    "SELECT transaction_id, sender_account FROM txn WHERE sender_account IN (SELECT receiver_account FROM txn)"))
def circular_transactions(spark, sf_dir):
    return jn.circular(fx.transactions(spark, sf_dir)).select("transaction_id", "sender_account")


@query("j3_one_way_anti_join", over_txn(
    "SELECT transaction_id, sender_account FROM txn t WHERE NOT EXISTS (SELECT 1 FROM txn r WHERE r.receiver_account = t.sender_account)"))
def one_way_transactions(spark, sf_dir):
    return jn.one_way(fx.transactions(spark, sf_dir)).select("transaction_id", "sender_account")


@query("j4_inner_join_accounts", over_acct("""SELECT transaction_id, account_country, account_type, account_txn_count FROM txn JOIN
 (SELECT account_id, MIN(country) AS account_country, MIN(account_type) AS account_type, COUNT(*) AS account_txn_count FROM acct GROUP BY account_id)
 ON sender_account_id = account_id"""))
def join_accounts(spark, sf_dir):
    accounts = up.batch_source(fx.account_events(spark, sf_dir))
    return jn.with_sender_account(fx.transactions(spark, sf_dir), accounts).select(
        "transaction_id", "account_country", "account_type", "account_txn_count")


@query("j5_self_join_sender_totals", over_txn(f"""SELECT transaction_id, sender_txn_count, sender_volume FROM txn JOIN
 (SELECT sender_account AS s, COUNT(*) AS sender_txn_count, {total('amount')} AS sender_volume FROM txn GROUP BY sender_account) ON sender_account = s"""))
def self_join(spark, sf_dir):
    return jn.with_sender_totals(fx.transactions(spark, sf_dir)).select("transaction_id", "sender_txn_count", "sender_volume")


@query("j7_distinct_receivers", over_txn("SELECT DISTINCT receiver_account AS account FROM txn"))
def distinct_receivers(spark, sf_dir):
    return jn.receiving_accounts(fx.transactions(spark, sf_dir))


@query("j8_global_sort", over_txn("SELECT transaction_id, currency, amount FROM txn ORDER BY currency, amount DESC NULLS LAST, transaction_id"))
def global_sort(spark, sf_dir):
    return fx.transactions(spark, sf_dir).select("transaction_id", "currency", "amount").orderBy(
        "currency", F.desc_nulls_last("amount"), "transaction_id")


@query("j9_top_n", over_txn(
    "SELECT transaction_id, amount, risk_score FROM txn ORDER BY risk_score DESC NULLS LAST, amount DESC NULLS LAST, transaction_id LIMIT 50"))
def top_n(spark, sf_dir):
    return fx.transactions(spark, sf_dir).select("transaction_id", "amount", "risk_score").orderBy(
        F.desc_nulls_last("risk_score"), F.desc_nulls_last("amount"), "transaction_id").limit(50)


def found_rows(table: DataFrame, some: DataFrame) -> DataFrame:
    """How many of some rows are rows of the table, compared in all fields."""
    keyed = lambda df: df.select(F.sha2(F.to_json(F.struct(*table.columns)), 256).alias("_row"))
    found = keyed(some).join(keyed(table).distinct(), "_row", "left_semi")
    return found.agg(F.count(F.lit(1)).cast("int").alias("found")).select(
        F.lit(some.count()).cast("int").alias("rows"), "found", F.lit(table.count()).alias("of_rows"))


@query("j10_limit", over_txn("SELECT 10 AS rows, 10 AS found, COUNT(*) AS of_rows FROM txn"))
def head(spark, sf_dir):
    """Any ten rows of the table."""
    txn = fx.transactions(spark, sf_dir)
    return found_rows(txn, stage(txn.limit(10), "head"))


@query("c1_currency_sets", over_txn(
    "SELECT sender_account, STRING_AGG(DISTINCT currency, ',' ORDER BY currency) AS currencies_used FROM txn GROUP BY sender_account"))
def currency_sets(spark, sf_dir):
    return ar.currencies_per_sender(fx.transactions(spark, sf_dir)).select(
        "sender_account", F.array_join("currencies_used", ",").alias("currencies_used"))


@query("c2_type_lists", over_txn("""SELECT sender_account, chunk, STRING_AGG(transaction_type, ',' ORDER BY transaction_type) AS txn_types_list FROM
 (SELECT sender_account, transaction_type, (ROW_NUMBER() OVER (PARTITION BY sender_account ORDER BY transaction_type) - 1) // 16 AS chunk FROM txn)
 GROUP BY sender_account, chunk"""))
def type_lists(spark, sf_dir):
    return ar.type_lists(fx.transactions(spark, sf_dir), chunk=16).select(
        "sender_account", "chunk", F.array_join("txn_types_list", ",").alias("txn_types_list"))


@query("c3_multi_currency_senders", over_txn("""SELECT sender_account, COUNT(DISTINCT currency) AS num_currencies, COUNT(*) AS txn_count
 FROM txn GROUP BY sender_account HAVING COUNT(DISTINCT currency) > 1"""))
def multi_currency_senders(spark, sf_dir):
    return ar.multi_currency_senders(fx.transactions(spark, sf_dir)).select("sender_account", "num_currencies", "txn_count")


@query("c4_distinct_types", over_txn("SELECT sender_account, COUNT(DISTINCT transaction_type) AS num_txn_types FROM txn GROUP BY sender_account"))
def distinct_types(spark, sf_dir):
    return ar.currencies_per_sender(fx.transactions(spark, sf_dir)).select("sender_account", "num_txn_types")


@query("c5_explode", over_txn("""SELECT DISTINCT sender_account, currency FROM txn WHERE sender_account IN
 (SELECT sender_account FROM txn GROUP BY sender_account HAVING COUNT(DISTINCT currency) > 1)"""))
def exploded(spark, sf_dir):
    return ar.sender_currency_rows(fx.transactions(spark, sf_dir))


@query("c6_array_contains", over_txn("SELECT sender_account, BOOL_OR(currency = 'JPY') AS uses_currency FROM txn GROUP BY sender_account"))
def contains(spark, sf_dir):
    return ar.senders_using(fx.transactions(spark, sf_dir), "JPY")
