"""Values that a two-digit double fixture does not have: more digits, NaN, and numbers beyond any decimal."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallywind.functions import columns as fn
from tallywind.functions.sql_functions import register
from tallywind.operators import aggregates as ag
from tallywind.plans import presets


@pytest.fixture(scope="module")
def odd(spark):
    rows = ([("A", 0.005, 0.7005, True)] * 1000 + [("B", 0.005, 0.7005, False)] * 2 + [("C", 2e17, 0.1, None), ("C", 1e17, 0.1, None)]
            + [("D", float("nan"), 0.2, True), ("D", 1.0, 0.2, False)] + [("E", 1e40, None, None), ("E", 1.0, None, None)] + [("F", None, None, None)])
    return spark.createDataFrame(rows, "currency string, amount double, risk_score double, is_flagged boolean")


def by_currency(df, *aggregates):
    return {r.currency: r for r in df.groupBy("currency").agg(*aggregates).collect()}


def test_sums_and_means_round_once(odd):
    got = by_currency(odd, fn.money_sum(F.col("amount")).alias("s"), fn.exact_mean(F.col("amount"), 3).alias("m"), fn.exact_mean(F.col("risk_score"), 4).alias("r"))
    assert got["A"].s == 5.0 and got["A"].m == 0.005 and got["B"].r == 0.7005
    assert got["C"].s == 3e17 and got["C"].m == 1.5e17
    assert math.isnan(got["D"].s) and math.isnan(got["D"].m)
    assert got["E"].s == 1e40 + 1 and got["F"].s is None and got["F"].m is None


def test_presets_agree_with_the_functions(odd):
    statement = f"SELECT currency, {presets._sum('amount')} AS s, {presets._mean('risk_score', 4)} AS r FROM {{txn}} GROUP BY currency"
    got = {r.currency: r for r in presets.run_preset(odd, statement).collect()}
    want = by_currency(odd, fn.money_sum(F.col("amount")).alias("s"), fn.exact_mean(F.col("risk_score"), 4).alias("r"))
    assert {k: repr((r.s, r.r)) for k, r in got.items()} == {k: repr((r.s, r.r)) for k, r in want.items()}


def test_risky_senders_keep_four_digits(odd):
    df = odd.filter("currency = 'B'").withColumn("sender_account", F.lit("S"))
    assert ag.risky_senders(df).first().avg_risk_score == 0.7005


def test_addresses_and_times_that_cannot_be_read(spark):
    register(spark)
    df = spark.createDataFrame([("999999999999999.1.1.1",), ("1.2.3.4",), ("a.2.3.4",), (None,)], "ip string")
    assert [tuple(r) for r in df.select(fn.ip_to_int(F.col("ip")), F.expr("ip_to_int(ip)")).collect()] == [(None, None), (16909060, 16909060), (None, None), (None, None)]
    times = spark.createDataFrame([("12:30:00",), ("T12:30",), ("2024-03-01T12:30:00Z",), ("nonsense",), (None,)], "timestamp string")
    assert [r[0] is not None for r in times.select(fn.event_time(F.col("timestamp"))).collect()] == [False, False, True, False, False]
    hours = presets.run_preset(times, presets.TRANSACTION_PRESETS["hourly_volume"]).collect()
    assert sum(r.cnt for r in hours) == 5
