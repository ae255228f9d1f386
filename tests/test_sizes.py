"""What the inputs of the queries store and shuffle: the numbers that records are made of, not their text."""

from __future__ import annotations

from pathlib import Path

from tallywind import JobConfig
from tallywind.plans import io_queries as io
from tallywind.plans.catalog import CATALOG
from tallywind.plans.runner import USED
from tallywind.session import shared_dir
from tallywind.sources import fixtures as fx
from tallywind.sources import tables as tb
from tallywind.sources import topics as tp
from tallywind.sources.schemas import TRANSACTION
from tallywind.streaming import jobs
from tallywind.streaming import transactions as txs

from plan_views import plan_text


def stored(spark, label):
    """Folders below the shared one with a label."""
    return {str(p) for p in Path(shared_dir(spark)).glob(f"{label}-*")}


def test_transactions_are_stored_as_numbers(spark, sf_dir):
    rows = fx.staged_rows(spark, sf_dir)
    assert set(rows.columns).isdisjoint(TRANSACTION.fieldNames()) and len(rows.columns) == 11
    plan = plan_text(CATALOG["l6_by_transaction_type"].build(spark, sf_dir))
    assert "l_extendedprice" in plan and "p_name" not in plan


def test_topic_text_is_not_stored(spark, sf_dir):
    before = stored(spark, "txn-topic")
    assert CATALOG["s4_json_decode"].build(spark, sf_dir).count() == 6000
    assert "Exchange" not in plan_text(CATALOG["s4_json_decode"].build(spark, sf_dir))
    run = io.transaction_run(spark, sf_dir)
    assert stored(spark, "txn-topic") == before
    source = spark.read.parquet(io._topic_rows(spark, sf_dir))
    assert "value" not in source.columns and source.count() == 6000 and len(source.inputFiles()) == io.FILES
    assert run["progress"].count() == 3


def test_dumps_are_not_stored(spark, sf_dir):
    assert CATALOG["b11_executor_summary"].build(spark, sf_dir).count() == 5
    assert not stored(spark, "dumps")


def test_account_topic_is_written_by_several_tasks(spark, sf_dir):
    run = io.account_run(spark, sf_dir)
    assert len(spark.read.parquet(run["account-topic"]).inputFiles()) > 8
    merges = run["table"].commits().filter("operation <> 'COMPACT'").orderBy("version").collect()
    assert [r.batch_id for r in merges] == [1, 2, 3]  # no event is older than the first cut


def test_analytics_input_is_staged_narrow(spark, sf_dir):
    before = stored(spark, "analytics-input")
    CATALOG["o2_analytics_runner"].build(spark, sf_dir)
    (new,) = stored(spark, "analytics-input") - before
    assert set(spark.read.parquet(new).columns) == set(USED)


def test_light_rows_are_made_once(spark, sf_dir):
    before = stored(spark, "light-rows")
    assert CATALOG["s8_partitioned_append"].build(spark, sf_dir).count() == 6000
    assert len(stored(spark, "light-rows") - before) == 1


def test_stream_shuffles_only_the_folders_of_the_clock(spark, sf_dir):
    decoded = tp.decode(fx.transaction_envelope(spark, sf_dir), TRANSACTION)
    plan = plan_text(txs.prepared(decoded))
    moved = next(part for part in plan.split("\n\n") if "Exchange" in part and "Input" in part)
    assert "txn_month" in moved and "txn_hour" not in moved and "date_str" not in moved


def test_batches_of_a_restarted_stream_have_a_bound(spark, sf_dir, monkeypatch):
    """Its shuffle is on disk until a batch is written."""
    monkeypatch.setattr(io, "BATCH_ROWS", 1000)
    before = stored(spark, "stream-table")
    assert CATALOG["t2_restart"].build(spark, sf_dir).agg({"records": "sum"}).first()[0] == 6000
    (table,) = stored(spark, "stream-table") - before
    assert tb.stream_rows(spark, table).select("batch_id").distinct().count() == io.FILES


def test_damaged_topic_is_read_in_bounded_batches_and_not_stored(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(io, "BATCH_ROWS", 1000)
    before = {label: stored(spark, label) for label in ("damaged-topic", "damaged-table")}
    assert CATALOG["t4_damaged_stream"].build(spark, sf_dir).agg({"records": "sum"}).first()[0] == 6000
    assert stored(spark, "damaged-topic") == before["damaged-topic"]
    (table,) = stored(spark, "damaged-table") - before["damaged-table"]
    assert spark.read.parquet(table).select("batch_id").distinct().count() == io.FILES


def test_damaged_records_are_parsed_once(spark, sf_dir):
    """Readable and unreadable rows come from one stored reading, without another parse."""
    found = CATALOG["s6_malformed_records"].build(spark, sf_dir)
    assert found.count() == 6000 and "from_json" not in plan_text(found)


def test_backfill_reads_a_sound_topic_once(spark, sf_dir, tmp_path):
    """Records are counted as they leave the source; a second look is for records that could not be read."""
    passed = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    for damage, times in ((False, 1), (True, 2)):
        envelope = fx.transaction_envelope(spark, sf_dir, damage=damage)
        before = passed.value
        path = jobs.run_backfill(spark, JobConfig(), envelope.mapInArrow(counting, envelope.schema), str(tmp_path / f"light-{damage}"))
        aside = spark.read.parquet(f"{path}_quarantine")
        assert spark.read.parquet(path).count() + aside.count() == 6000 and (aside.count() > 0) == damage
        assert passed.value - before == 6000 * times
