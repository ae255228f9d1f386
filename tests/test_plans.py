"""Physical plans: native expressions, pruning, pushdown, checked broadcasts, limits before shuffles."""

from __future__ import annotations

import json

import pytest
from plan_views import plan_text
from pyspark.sql import functions as F

from tallywind import JobConfig
from tallywind.operators import aggregates as ag
from tallywind.operators import joins as jn
from tallywind.operators import windows as wn
from tallywind.operators.enrich import enrich
from tallywind.plans import presets
from tallywind.plans.runner import run_analytics
from tallywind.session import lookup, lookup_side
from tallywind.sources import tables as tb
from tallywind.sources import topics as tp
from tallywind.sources.schemas import TRANSACTION_PARTITIONS


def test_enrichment_stays_in_the_engine(txn):
    text = plan_text(enrich(txn))
    assert "Python" not in text and "Exchange" not in text


def test_projection_prunes_the_scan(txn):
    text = plan_text(enrich(txn).select("transaction_id", "amount_bucket"))
    schema = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "memo" not in schema and "amount" in schema


def test_filter_reaches_the_scan(txn):
    text = plan_text(ag.risky_senders(txn))
    assert "GreaterThanOrEqual(risk_score,0.7)" in text


def test_offset_bounds_reach_the_scan(spark, sf_dir, tmp_path):
    from tallywind.sources.fixtures import transaction_envelope

    transaction_envelope(spark, sf_dir).write.parquet(str(tmp_path / "topic"))
    text = plan_text(tp.between_offsets(tp.read_files(spark, str(tmp_path / "topic")), 10, 20))
    assert "GreaterThanOrEqual(offset,10)" in text and "LessThan(offset,20)" in text


def test_partitions_are_pruned(spark, txn, tmp_path):
    rows = txn.select("transaction_id", "currency", F.year("timestamp").alias("txn_year"), F.month("timestamp").alias("txn_month"))
    path = str(tmp_path / "table")
    tb.overwrite(tb.balanced(rows.filter("txn_month < 3"), TRANSACTION_PARTITIONS), path, TRANSACTION_PARTITIONS)
    text = plan_text(tb.in_partition(tb.read(spark, path), 1997, 1, "EUR"))
    pruned = next(line for line in text.splitlines() if line.startswith("PartitionFilters"))
    assert all(name in pruned for name in TRANSACTION_PARTITIONS) and "Filter (" not in text


def test_broadcast_only_below_the_limit(spark, txn):
    accounts = jn.receiving_accounts(txn)
    rows = accounts.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for limit, wanted in ((rows, "BroadcastHashJoin"), (rows - 1, "SortMergeJoin")):
            side = lookup_side(accounts, "test", limit)
            joined = txn.join(side, txn["sender_account"] == side["account"], "left_semi")
            assert wanted in plan_text(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_only_below_the_byte_limit(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    measured = lookup(wide, "wide", max_bytes=100_000)
    assert measured.rows == 100 and measured.size > 100_000 and not measured.small
    assert lookup(wide, "wide", max_bytes=1 << 20).small


def test_one_result_file_does_not_narrow_the_work(spark, txn, tmp_path):
    wide = txn.repartition(6).select("transaction_id", F.spark_partition_id().alias("task"))
    tb.write_result(wide, str(tmp_path / "out"))
    stored = tb.read(spark, str(tmp_path / "out"))
    assert stored.select("task").distinct().count() == 6 and len(stored.inputFiles()) == 1


def test_top_n_is_limited_before_the_shuffle(txn):
    text = plan_text(wn.top_per_currency(txn))
    assert text.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan_text(presets.run_preset(txn, presets.TRANSACTION_PRESETS["top_amounts"]))


def test_latest_row_needs_no_window(txn):
    text = plan_text(wn.latest_per_key(txn.select("sender_account", "amount", "timestamp"), "sender_account", "timestamp"))
    assert "Window" not in text


def test_hourly_volume_needs_the_hour(txn):
    with pytest.raises(ValueError, match="txn_hour"):
        ag.hourly_volume(txn)
    assert ag.hourly_volume(enrich(txn)).count() == 24


def test_ad_hoc_sql_caps_what_is_shown(spark, txn):
    assert presets.ad_hoc(spark, txn, "SELECT * FROM txn", 7).count() == 7


def test_analytics_runner(spark, txn, tmp_path):
    counts = run_analytics(enrich(txn), str(tmp_path / "out"))
    assert counts["rows"] == 6000 and counts["top_per_currency"] == 30
    assert counts["circular"] + counts["one_way"] == 6000
    assert spark.read.parquet(str(tmp_path / "out" / "pivot_type_by_currency")).count() == 10


def test_settings(tmp_path):
    path = tmp_path / "job.json"
    path.write_text(json.dumps({"worker_cores": 8, "trigger_interval": "5 seconds"}))
    assert JobConfig.load(str(path)).worker_cores == 8
    path.write_text(json.dumps({"wrong": 1}))
    with pytest.raises(ValueError):
        JobConfig.load(str(path))
