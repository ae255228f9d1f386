"""Transaction enrichment: a catalogue of 33 derived columns, each an expression over the record's own fields, and 4 filled fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn

# What stands for a null.
FILLS = {"fee": 0.0, "exchange_rate": 1.0, "sender_country": "XX", "receiver_country": "XX"}
# Fixed names: every part of the instant, with the function that takes it.
CLOCK = {
    "transaction_date": F.to_date, "date_str": lambda at: F.date_format(at, "yyyy-MM-dd"), "is_weekend": lambda at: F.coalesce(F.dayofweek(at).isin(1, 7), F.lit(False)),
    "txn_year": F.year, "txn_quarter": F.quarter, "txn_month": F.month, "txn_day": F.dayofmonth, "txn_dayofweek": F.dayofweek, "txn_hour": F.hour,
}


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(FILLS[name]))


INSTANT = "_instant"


def _with_instant(df: DataFrame) -> DataFrame:
    """The parsed instant as a column of its own: named in nine expressions it would be parsed more than once."""
    return df.withColumn(INSTANT, fn.event_time(F.col("timestamp")))


def clock(names: Iterable[str] = tuple(CLOCK)) -> dict[str, Column]:
    """Every part comes from one parsed instant, read in the session zone (UTC)."""
    return {name: CLOCK[name](F.col(INSTANT)) for name in names}


def catalogue() -> dict[str, Column]:
    """All derived columns by name. None reads another derived one but the instant, so one projection computes them in any order."""
    c, fee, rate = F.col, filled("fee"), filled("exchange_rate")
    ends = [filled(f"{end}_country") for end in ("sender", "receiver")]
    columns = {
        **clock(),
        "currency_safe": F.coalesce(c("currency"), F.lit("USD")), "risk_score_safe": F.coalesce(c("risk_score"), F.lit(0.0)),
        "amount_bucket": fn.amount_bucket(c("amount")), "log_amount": fn.log_amount(c("amount")),
        "net_amount": fn.difference(c("amount"), fee), "amount_usd": fn.product(c("amount"), rate),
        "fee_pct": F.when(c("amount") > 0, F.round(fee / c("amount") * 100, 4)),
        "risk_tier": fn.risk_tier(c("risk_score")), "risk_level": fn.risk_level(c("risk_score")),
        "needs_review": fn.needs_review(c("risk_score"), c("is_flagged"), c("amount")),
        "corridor": F.concat_ws("→", *map(F.upper, ends)), "is_cross_border": ends[0] != ends[1],
        "is_intra_bank": c("sender_bank_code") == c("receiver_bank_code"),
        "memo_clean": F.coalesce(F.trim("memo"), F.lit("(no memo)")), "memo_length": F.length("memo"), "has_memo": F.coalesce(F.length("memo") > 0, F.lit(False)),
        "row_id": F.sha2("transaction_id", 256), "ip_anonymized": fn.anonymize_ip(c("ip_address")),
    }
    for end in ("sender", "receiver"):
        columns |= {f"{end}_hash": F.sha2(f"{end}_name", 256), f"{end}_account_masked": fn.mask_account(c(f"{end}_account"))}
    return columns | {short: F.substring(name, 1, 8) for short, name in (("device_short_id", "device_fingerprint"), ("session_prefix", "session_id"))}


def time_dimensions(df: DataFrame, names: Iterable[str] = tuple(CLOCK)) -> DataFrame:
    return _with_instant(df).withColumns(clock(names)).drop(INSTANT)


def enrich(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """The whole catalogue and the filled fields in one projection, but for the columns to ``keep``, which ``df`` has already."""
    derived = {name: e for name, e in catalogue().items() if name not in set(keep)} | {name: filled(name) for name in FILLS}
    if derived.keys() & CLOCK.keys():
        df = _with_instant(df)
    return df.withColumns(derived).drop(INSTANT)


def backfill(df: DataFrame) -> DataFrame:
    """The light enrichment of the back-fill job: date, year, month and its own amount bucket."""
    at = F.col(INSTANT)
    return _with_instant(df).withColumns({
        "transaction_date": F.to_date(at),
        "txn_year": F.year(at),
        "txn_month": F.month(at),
        "amount_bucket": fn.backfill_bucket(F.col("amount")),
    }).drop(INSTANT)
