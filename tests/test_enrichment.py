"""Edge rows: nulls, blanks, NaN, negative numbers, unreadable times."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import Row

from tallywind.functions import sql_functions
from tallywind.operators.enrich import CLOCK, backfill, catalogue, enrich, time_dimensions
from tallywind.sources.schemas import TRANSACTION

FULL = dict(
    transaction_id="t", timestamp="2026-03-21T23:30:00+00:00", sender_account_id="a", receiver_account_id="b", sender_account="4000123456789012",
    receiver_account="4000999988887777", amount=1234.5, currency="EUR", transaction_type="ACH", status="PENDING", sender_name="Ann", receiver_name="Bo",
    sender_bank_code="B1", receiver_bank_code="B1", sender_country="fr", receiver_country="de", fee=1.25, exchange_rate=1.1, reference_id="REF-1",
    memo=" hello ", risk_score=0.5, is_flagged=False, category="RETAIL", channel="API", ip_address="10.1.2.3", device_fingerprint="abcdef0123456789",
    session_id="12345678-9", )


@pytest.fixture(scope="module")
def one(spark):
    def run(**changes):
        values = {**FULL, **changes}
        df = spark.createDataFrame([Row(*[values[f] for f in TRANSACTION.fieldNames()])], TRANSACTION)
        return enrich(df).first()

    return run


def test_plain_row(one, spark):
    row = one()
    assert len(row) == 27 + 33
    assert (row.corridor, row.is_cross_border, row.is_intra_bank) == ("FR→DE", True, True)
    assert (row.net_amount, row.amount_usd, row.fee_pct, row.amount_bucket) == (1233.25, 1357.95, 0.1013, "MEDIUM")
    assert row.sender_account_masked == "************9012"
    assert row.sender_hash == hashlib.sha256(b"Ann").hexdigest()
    assert (row.ip_anonymized, row.device_short_id, row.session_prefix, row.memo_length, row.has_memo) == ("10.1.2.xxx", "abcdef01", "12345678", 7, True)
    assert (row.txn_year, row.txn_month, row.txn_day, row.txn_hour, row.txn_dayofweek, row.is_weekend) == (2026, 3, 21, 23, 7, True)


def test_missing_values(one):
    row = one(currency=None, risk_score=None, memo=None, fee=None, exchange_rate=None, sender_country=None, receiver_country=None,
              sender_name=None, ip_address=None, device_fingerprint=None, session_id=None, sender_bank_code=None)
    assert (row.currency_safe, row.risk_score_safe, row.memo_clean) == ("USD", 0.0, "(no memo)")
    assert (row.fee, row.exchange_rate, row.sender_country, row.receiver_country) == (0.0, 1.0, "XX", "XX")
    assert (row.currency, row.risk_tier, row.risk_level) == (None, "UNKNOWN", 0)
    assert (row.is_cross_border, row.corridor, row.is_intra_bank) == (False, "XX→XX", None)
    assert (row.sender_hash, row.ip_anonymized, row.device_short_id, row.session_prefix) == (None, None, None, None)
    assert (row.memo_length, row.has_memo) == (None, False)


def test_missing_amount(one):
    row = one(amount=None)
    assert (row.amount_bucket, row.net_amount, row.fee_pct, row.amount_usd, row.log_amount) == ("WHALE", None, None, None, None)


def test_blank_memo_stays_blank(one):
    row = one(memo="   ")
    assert (row.memo_clean, row.memo_length, row.has_memo) == ("", 3, True)
    assert one(memo="").has_memo is False


@pytest.mark.parametrize("score, tier, level", [
    (0.8, "CRITICAL", 5), (0.79, "HIGH", 4), (0.4, "MEDIUM", 3), (0.2, "LOW", 2), (0.0, "NEGLIGIBLE", 1), (-0.1, "NEGLIGIBLE", 0), (math.nan, "NEGLIGIBLE", 5)])
def test_risk_steps(one, score, tier, level):
    row = one(risk_score=score)
    assert (row.risk_tier, row.risk_level) == (tier, level)


@pytest.mark.parametrize("score, flagged, amount, wanted", [
    (None, False, 1.0, None), (None, True, None, True), (0.1, None, 100_000.0, True), (0.1, False, 99_999.99, False), (0.7, None, None, True)])
def test_review_is_three_valued(one, score, flagged, amount, wanted):
    assert one(risk_score=score, is_flagged=flagged, amount=amount).needs_review is wanted


def test_unreadable_time(one):
    row = one(timestamp="yesterday")
    assert (row.transaction_date, row.txn_year, row.txn_hour, row.date_str, row.is_weekend) == (None, None, None, None, False)


def test_times_with_an_offset_are_read_in_utc(one):
    row = one(timestamp="2026-03-21T23:30:00-05:00")
    assert (str(row.transaction_date), row.date_str, row.txn_hour, row.txn_dayofweek) == ("2026-03-22", "2026-03-22", 4, 1)


@pytest.mark.parametrize("amount, fee, net", [(1.005, 0.0, 1.01), (2.675, 0.0, 2.68), (0.0, 0.5, -0.5)])
def test_half_cents_round_up(one, amount, fee, net):
    assert one(amount=amount, fee=fee).net_amount == net


def test_huge_amount_falls_back_to_double(one):
    assert one(amount=1e20, exchange_rate=2.0).amount_usd == 2e20


def test_zero_amount_has_no_log_and_no_share(one):
    row = one(amount=0.0)
    assert (row.log_amount, row.fee_pct, row.amount_bucket) == (None, None, "MICRO")


def test_short_accounts_are_hidden(one):
    assert one(sender_account="123").sender_account_masked == "****"
    assert one(sender_account=None).sender_account_masked == "****"
    assert one(sender_account="1234").sender_account_masked == "1234"


def test_backfill_has_its_own_buckets(spark):
    df = spark.createDataFrame([("2026-01-02T00:00:00Z", a) for a in (50.0, 5_000.0, 50_000.0, 500_000.0, None)], "timestamp string, amount double")
    assert [r.amount_bucket for r in backfill(df).collect()] == ["MICRO", "SMALL", "MEDIUM", "LARGE", "LARGE"]


def test_stage_order_and_skipping(spark, txn):
    assert len(catalogue()) == 33
    once = time_dimensions(txn)
    assert enrich(once, keep=CLOCK).select(sorted(enrich(txn).columns)).exceptAll(enrich(txn).select(sorted(enrich(txn).columns))).isEmpty()


def test_sql_functions(spark):
    sql_functions.register(spark)
    row = spark.sql("""SELECT ip_to_int('200.1.2.3') a, ip_to_int('1.2.x.4') b, ip_to_int('1.2.3') c, ip_to_int(NULL) d, ip_to_int('1.2.3.4.5') e,
      compute_net_amount(10D, NULL, NULL) f, compute_net_amount(NULL, 1D, 1D) g, compute_net_amount(10D, 1D, 1.5D) h,
      log_amount(0D) i, log_amount(1D) j, mask_account('12') k, classify_risk(0.6D) l, mask_account_arrow('123456') m, mask_account_arrow('1') n""").first()
    assert tuple(row) == (3355509251, None, None, None, 16909060, 10.0, None, 13.5, None, 0.0, "****", "HIGH", "**3456", "****")
