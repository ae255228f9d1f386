"""Streams and the account table: replay, restart, quarantine, compaction, order of batches."""

from __future__ import annotations

from datetime import date, datetime, timezone

import pytest
from plan_views import plan_text
from pyspark.sql import functions as F

from tallywind import JobConfig
from tallywind.operators import maintenance as mn
from tallywind.operators import profile as pf
from tallywind.operators import upsert as up
from tallywind.operators.enrich import enrich
from tallywind.sources import fixtures as fx
from tallywind.sources import tables as tb
from tallywind.sources import topics as tp
from tallywind.sources.schemas import ACCOUNT, TRANSACTION, TRANSACTION_PARTITIONS
from tallywind.streaming import accounts as acs
from tallywind.streaming import jobs
from tallywind.streaming import metrics as mt
from tallywind.streaming import transactions as txs


@pytest.fixture(scope="module")
def topic(spark, sf_dir, tmp_path_factory):
    """A few days of records with some damaged ones, in four files."""
    path = str(tmp_path_factory.mktemp("topic") / "txn")
    envelope = fx.transaction_envelope(spark, sf_dir, damage=True).filter(F.month("timestamp") == 3)
    envelope.repartition(4).write.parquet(path)
    return path


def run(spark, topic, tmp_path, sink):
    q = txs.start(tp.stream_files(spark, topic, max_files=2), sink, str(tmp_path / "checkpoint"), {"availableNow": True})
    q.awaitTermination()
    return q


def test_stream_equals_batch_and_restart_adds_nothing(spark, topic, tmp_path):
    table, measured = (str(tmp_path / n) for n in ("table", "metrics"))
    sink = txs.TransactionSink(spark, table, measured)
    query = run(spark, topic, tmp_path, sink)
    decoded = tp.decode(tp.read_files(spark, topic), TRANSACTION)
    wanted = enrich(tp.readable(decoded))
    columns = sorted(wanted.columns)
    stored = tb.stream_rows(spark, table)
    assert len(columns) == 27 + 33 + 5
    assert sorted(stored.columns) == sorted([*columns, "stream", "batch_id"])
    for a, b in ((stored, wanted), (wanted, stored)):
        assert a.select(columns).exceptAll(b.select(columns)).isEmpty()
    bad = tp.unreadable(decoded)
    assert bad.count() > 0
    aside = tb.set_aside(spark, table).select(bad.columns)
    assert aside.exceptAll(bad).isEmpty() and bad.exceptAll(aside).isEmpty()
    timed = mt.measurements(spark, measured)
    assert timed.count() == 2 and timed.agg(F.sum("rows")).first()[0] == decoded.count()
    assert timed.agg(F.sum("unreadable")).first()[0] == bad.count()
    assert all(r.transform_ms > 0 and r.write_ms > 0 and abs(r.wall_ms - r.transform_ms - r.write_ms) < 0.01 for r in timed.collect())
    assert mt.progress_rows(query).count() == 2

    rows = stored.count()
    run(spark, topic, tmp_path, sink)
    assert tb.stream_rows(spark, table).count() == rows
    sink(decoded, 1)  # a batch whose write is repeated, here with other rows: only that batch is replaced
    again = tb.stream_rows(spark, table)
    assert again.filter("batch_id = 1").count() == wanted.count()
    assert again.filter("batch_id = 0").exceptAll(stored.filter("batch_id = 0")).isEmpty()


def test_failed_batch_is_redone(spark, topic, tmp_path):
    """The write succeeds but the batch fails before its offsets are committed: the restart runs it again."""
    table = str(tmp_path / "table")
    sink, calls = txs.TransactionSink(spark, table), []

    def breaks_once(df, batch_id):
        sink(df, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception):
        run(spark, topic, tmp_path, breaks_once)
    run(spark, topic, tmp_path, breaks_once)
    assert calls == [0, 0, 1]
    decoded = tp.decode(tp.read_files(spark, topic), TRANSACTION)
    assert tb.stream_rows(spark, table).count() == tp.readable(decoded).count()


def test_each_record_is_decoded_once(spark, topic, tmp_path):
    """Records are counted as they leave the decoder."""
    passed = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    decoded = tp.decode(tp.read_files(spark, topic), TRANSACTION)
    seen = decoded.mapInArrow(counting, decoded.schema)
    txs.TransactionSink(spark, str(tmp_path / "table"), str(tmp_path / "metrics"))(seen, 0)
    assert passed.value == decoded.count() == mt.measurements(spark, str(tmp_path / "metrics")).first()["rows"]


def test_empty_batch_leaves_nothing(spark, topic, tmp_path):
    sink = txs.TransactionSink(spark, str(tmp_path / "table"), str(tmp_path / "metrics"))
    decoded = tp.decode(tp.read_files(spark, topic), TRANSACTION)
    sink(decoded, 0)
    for batch_id, nothing in ((1, decoded.filter(F.lit(False))), (2, decoded.filter("kafka_offset < 0"))):
        sink(nothing, batch_id)
    assert [r.batch_id for r in tb.stream_rows(spark, str(tmp_path / "table")).select("batch_id").distinct().collect()] == [0]
    assert mt.measurements(spark, str(tmp_path / "metrics")).count() == 1


def test_measurements_are_merged_by_day(spark, tmp_path):
    path = str(tmp_path / "metrics")
    at = lambda day, second: datetime(2026, 1, day, 12, 0, second, tzinfo=timezone.utc)
    rows = [("s", b, 10 * b, 0, 1.0, 2.0, 3.0, at(1 + b // 3, b)) for b in range(6)]
    for row in [*rows, ("s", 1, 99, 0, 1.0, 2.0, 3.0, at(1, 50))]:  # batch 1 was written again
        mt._add(spark, path, mt.BATCHES, [row], mt.MEASUREMENT)
    mt._add(spark, path, mt.TIMINGS, [("s", b, 10 * b, 1, 2, 3, 4, 50, at(3, b)) for b in range(5)], mt.TIMING)
    before = sorted(mt.run_metrics(spark, path).collect())
    assert [r.rows for r in before] == [0, 99, 20, 30, 40, 50] and [r.wall_ms for r in before] == [50.0] * 5 + [3.0]
    assert mt.merge_days(spark, path, date(2026, 1, 2)) == 1  # the second day is not over
    count = lambda kind: sorted(r["count"] for r in pf.files(spark, f"{path}/{kind}").groupBy("folder").count().collect())
    assert count(mt.BATCHES) == [1, 3] and mt.merge_days(spark, path) == 1 and count(mt.BATCHES) == [1, 1]
    assert mt.merge_days(spark, path) == 0
    assert sorted(mt.run_metrics(spark, path).collect()) == before


def test_jobs_from_one_configuration(spark, topic, sf_dir, tmp_path):
    """Both streams, back-fill, analytics, upkeep and report, with the settings they take."""
    cfg = JobConfig(**{f"{n}_path": str(tmp_path / n) for n in ("transactions", "accounts", "analytics", "checkpoint")}, metrics_history=1,
                    vacuum_retention_hours=0, cost_per_core_hour=3600.0, worker_cores=2)
    listener = mt.BatchListener(spark, hold=1)
    spark.streams.addListener(listener)
    try:
        queries = [jobs.run_transactions(spark, cfg, tp.stream_files(spark, topic, max_files=2), once=True, listener=listener)]
        events = str(tmp_path / "events")
        fx.account_envelope(spark, sf_dir, keyless=True).repartition(3).write.parquet(events)
        queries.append(jobs.run_accounts(spark, cfg, tp.stream_files(spark, events, max_files=1), once=True, listener=listener))
        for q in queries:
            q.awaitTermination()
            assert listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    assert mt.timings(spark, jobs.metrics_path(cfg.accounts_path)).count() == 3
    keyed = tp.account_updates(tp.read_files(spark, events), ACCOUNT)
    assert up.AccountTable(spark, cfg.accounts_path).current().agg(F.sum("transaction_count")).first()[0] == keyed.count()
    rows = jobs.run_analytics_job(spark, cfg)["rows"]
    assert rows == tb.stream_rows(spark, cfg.transactions_path).count() and spark.read.parquet(f"{cfg.analytics_path}/currency_stats").count() > 0
    report = jobs.run_report(spark, cfg).first()
    assert report.batches == 1 and report.transform_pct + report.write_pct <= 100.02
    assert report.estimated_cost == pytest.approx(report.wall_clock_seconds * 2, rel=0.01)
    path = jobs.run_backfill(spark, cfg, tp.read_files(spark, topic))
    assert tb.read(spark, path).count() == rows
    expired = [r.version for r in jobs.run_upkeep(spark, cfg).collect()]
    assert sorted(expired) == list(range(len(expired))) and len(expired) == up.AccountTable(spark, cfg.accounts_path).commits().count() - 1


def test_compaction_in_place_keeps_untouched_files(spark, tmp_path):
    path = str(tmp_path / "a table")
    df = spark.range(3000).select("id", F.expr("CASE id % 3 WHEN 0 THEN 'x/y z' WHEN 1 THEN '007' END").alias("b"), (F.col("id") % 2).alias("a"))
    for i in range(3):  # folder a=0/b=007 gets one file, all others three
        part = df.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == i)
        part.filter("a = 1 OR b IS NULL OR b <> '007'").repartition(1).write.mode("append").partitionBy("a", "b").parquet(path)
    df.filter("a = 0 AND b = '007'").repartition(1).write.mode("append").partitionBy("a", "b").parquet(path)
    before = {r.file_path for r in pf.files(spark, path).collect()}
    plan = mn.compact_in_place(spark, path, target_bytes=1 << 20)
    after = pf.files(spark, path).collect()
    assert len(before) == 16 and plan.count() == 15 and len(after) == 6 and len(before & {r.file_path for r in after}) == 1
    stored = spark.read.schema("id long, a long, b string").parquet(path).select(df.columns)
    assert stored.exceptAll(df).isEmpty() and stored.count() == 3000
    assert mn.compact_in_place(spark, path, target_bytes=1 << 20).count() == 0
    sizes = [r.file_size for r in after]
    assert mn.compaction_plan(spark, path, target_bytes=min(sizes)).count() == 0  # nothing to gain


def test_files_are_listed_and_rows_counted_from_footers(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(100).withColumn("k", F.col("id") % 4).repartition(2).write.partitionBy("k").parquet(path)
    text = plan_text(pf.files(spark, path))
    assert "binaryFile" in text and "ReadSchema: struct<>" in text
    with pf.footer_counts(spark):
        assert "PushedAggregation: [COUNT(*)]" in plan_text(pf.counted_from_footers(spark, path))
    assert "PushedAggregation" not in plan_text(pf.counted_from_footers(spark, path))
    info = pf.table_info(spark, path, 3).first()
    assert (info.num_files, info.row_count, info.columns, info.partition_columns, info.version) == (8, 100, 2, "k", 3)


def test_compaction_keeps_rows_and_files_shrink(spark, topic, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    decoded = tp.decode(tp.read_files(spark, topic), TRANSACTION)
    sink = txs.TransactionSink(spark, source)
    for i in range(2):
        sink(decoded.filter(F.col("kafka_offset") % 2 == i), i)
    before = spark.read.parquet(source)
    after = mn.compact(spark, source, target, TRANSACTION_PARTITIONS, drop=["stream", "batch_id", "readable"])
    assert after.exceptAll(before.select(after.columns)).isEmpty() and after.count() == before.count()
    assert pf.files(spark, target).count() < pf.files(spark, source).count()
    listed = pf.partition_files(spark, target).first()
    assert listed["partition"].startswith("txn_year=") and listed["files"] == 1
    info = pf.table_info(spark, target, 3).first()
    assert (info.row_count, info.version, info.columns, info.partition_columns) == (before.count(), 3, len(after.columns), ",".join(TRANSACTION_PARTITIONS))


def test_compaction_goes_in_portions(spark, tmp_path, monkeypatch):
    """A portion's shuffle is gone before the next begins; a partition is in one portion, so it still gets one file."""
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    rows = spark.range(400).select(
        "id", F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 2).alias("batch_id"), (F.col("id") % 3).cast("int").alias("txn_year"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("c:/"), F.col("id") % 5)).alias("currency"))
    rows.repartition(3).write.partitionBy("batch_id", "txn_year", "currency").parquet(source)
    jobs_run, rewrite = [], mn._rewrite
    monkeypatch.setattr(mn, "_rewrite", lambda part, *more: jobs_run.append(part.count()) or rewrite(part, *more))
    monkeypatch.setattr(mn, "BYTES_PER_JOB", 20_000)
    after = mn.compact(spark, source, target, ["txn_year", "currency"], drop=["batch_id"])
    wanted = rows.drop("batch_id")
    assert after.schema["currency"].dataType == wanted.schema["currency"].dataType and after.count() == 400
    assert after.select(wanted.columns).exceptAll(wanted).isEmpty()
    assert len(jobs_run) > 2 and sum(jobs_run) == 400
    assert [r["count"] for r in pf.files(spark, target).groupBy("folder").count().collect()] == [1] * 15
    flat = str(tmp_path / "flat")
    wanted.write.parquet(flat)
    assert mn.compact(spark, flat, str(tmp_path / "of-flat"), ["txn_year", "currency"]).count() == 400


def event(account, at, sent=0.0, received=0.0, status="ACTIVE", balance=1.0, **more):
    values = dict(account_id=account, account_number="n", holder_name="h", bank_code="b", country="FR", currency="EUR", account_type="T", account_status=status,
                  balance=balance, total_sent=sent, total_received=received, transaction_count=1, risk_rating=0.1, kyc_level="FULL",
                  last_transaction_time=at, updated_at=at, created_at=at)
    return tuple({**values, **more}[f] for f in ACCOUNT.fieldNames())


def frame(spark, *events):
    return spark.createDataFrame(list(events), ACCOUNT)


@pytest.mark.parametrize("compact_every", [1, 2, 100])
def test_account_rules(spark, tmp_path, compact_every):
    table = up.AccountTable(spark, str(tmp_path / "accounts"), compact_every)
    assert table.current().count() == 0
    assert table.apply(frame(spark, event("a", "2026-01-02", 10.0, holder_name="first"), event("a", "2026-01-01", 5.5, status="CLOSED"), event("b", "2026-01-01", None, None)), 0) == 3
    assert table.apply(frame(spark, event("a", "2026-01-03", 1.0, 2.0, "DORMANT", 9.0, holder_name="second", last_transaction_time=None),
                             event("b", "2026-01-02", None, None), event("c", "2026-01-01", None, 4.0)), 1) == 3
    assert table.apply(frame(spark, event("a", "2026-01-03", 100.0)), 1) is None and table.apply(frame(spark).limit(0), 7) == 0
    assert table.apply(frame(spark, event("a", "2025-12-31", 0.1, 0.2, "ACTIVE", 3.0)), 2) == 1
    rows = {r.account_id: r for r in table.current().collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a.total_sent, a.total_received, a.transaction_count) == (16.6, 2.2, 4)
    assert (a.holder_name, a.account_status, a.balance, a.updated_at, a.last_transaction_time) == ("first", "ACTIVE", 3.0, "2025-12-31", "2026-01-02")
    assert (b.total_sent, b.total_received, b.transaction_count) == (0.0, 0.0, 2)
    assert (c.total_sent, c.total_received, c.transaction_count) == (None, 4.0, 1)
    operations = [r.operation for r in table.commits().orderBy("version").collect()]
    assert operations[0] == "CREATE" and operations.count("MERGE") == 2
    assert operations.count("COMPACT") == {1: 3, 2: 1, 100: 0}[compact_every]
    assert pf.history(table.commits(), 2).count() == 2


def test_compaction_rewrites_only_met_buckets(spark, tmp_path):
    table = up.AccountTable(spark, str(tmp_path / "accounts"), compact_every=100, buckets=16)
    table.apply(frame(spark, *(event(f"a{i}", "2026-01-01", 1.0) for i in range(200))), 0)
    assert table.compact() == list(range(16))
    stored = lambda: {r.file_path for r in pf.files(spark, f"{table.path}/snapshots").collect()}
    before = stored()
    again = up.AccountTable(spark, table.path, compact_every=100, buckets=3)  # the table keeps its number of buckets
    again.apply(frame(spark, event("a7", "2026-01-02", 5.0), event("a7", "2026-01-03", 6.0), event("a8", "2026-01-02")), 1)
    met = again.compact()
    assert 1 <= len(met) <= 2 and again.buckets == 16
    added = stored() - before
    assert before < stored() and {int(f.split("bucket=")[1].split("/")[0]) for f in added} == set(met)
    rows = {r.account_id: r for r in table.current().collect()}
    assert len(rows) == 200 and rows["a7"].total_sent == 12.0 and rows["a7"].transaction_count == 3 and rows["a9"].total_sent == 1.0
    again.apply(frame(spark, event("a9", "2026-01-04", 1.0), event("new", "2026-01-04", 1.0)), 2)  # not compacted yet
    assert table.current().count() == 201 and table.current().filter("account_id = 'a9'").first().total_sent == 2.0


def test_snapshot_of_a_lost_compaction_is_not_read(spark, tmp_path):
    """Files of a version that no compaction committed: another commit takes the version's number."""
    table = up.AccountTable(spark, str(tmp_path / "accounts"), compact_every=100, buckets=4)
    table.apply(frame(spark, event("a", "2026-01-01", 1.0)), 0)
    table.compact()
    lost = table.current().withColumn("total_sent", F.lit(99.0)).withColumn("bucket", table._bucket())
    lost.write.partitionBy("bucket").parquet(f"{table.path}/snapshots/of=4/v={2:012d}")
    assert table.current().first().total_sent == 1.0
    table.apply(frame(spark, event("a", "2026-01-02", 1.0)), 1)  # version 2
    assert table.current().first().total_sent == 2.0
    table.compact()
    assert table.current().first().total_sent == 2.0


def test_late_batches_can_be_guarded(spark, tmp_path):
    for compact_every in (1, 100):
        table = up.AccountTable(spark, str(tmp_path / f"guarded{compact_every}"), compact_every, event_time_guard=True)
        table.apply(frame(spark, event("a", "2026-01-02", 1.0, balance=5.0)), 0)
        table.apply(frame(spark, event("a", "2026-01-01", 1.0, balance=4.0)), 1)
        row = table.current().first()
        assert (row.total_sent, row.balance, row.updated_at) == (2.0, 5.0, "2026-01-02")


def test_uncommitted_delta_is_not_read(spark, tmp_path):
    table = up.AccountTable(spark, str(tmp_path / "accounts"))
    table.apply(frame(spark, event("a", "2026-01-01", 1.0)), 0)
    up.batch_source(frame(spark, event("a", "2026-01-02", 5.0))).write.parquet(f"{table.path}/deltas/version=1")
    assert table.current().first().total_sent == 1.0
    assert table.apply(frame(spark, event("a", "2026-01-02", 7.0)), 1) == 1
    assert table.current().first().total_sent == 8.0


def test_account_stream(spark, sf_dir, tmp_path):
    path = str(tmp_path / "topic")
    fx.account_envelope(spark, sf_dir, keyless=True).repartition(2).write.parquet(path)
    table = up.AccountTable(spark, str(tmp_path / "accounts"))
    sink = acs.AccountSink(table, str(tmp_path / "metrics"))
    acs.start(tp.stream_files(spark, path, max_files=1), sink, str(tmp_path / "checkpoint"), {"availableNow": True}).awaitTermination()
    keyed = tp.account_updates(tp.read_files(spark, path), ACCOUNT)
    assert table.current().agg(F.sum("transaction_count")).first()[0] == keyed.count()
    assert mt.measurements(spark, str(tmp_path / "metrics")).agg(F.sum("rows")).first()[0] == keyed.count()


def test_kafka_options():
    assert tp.kafka_options("h:1", "t", 5) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "5"}


def test_new_checkpoint_loses_and_repeats_nothing(spark, topic, tmp_path):
    """The checkpoint is lost after half the topic: the next stream starts at batch 0 again, on the same table."""
    table, sink_of = str(tmp_path / "table"), lambda: txs.TransactionSink(spark, str(tmp_path / "table"))
    envelope = tp.read_files(spark, topic)
    for i in range(2):
        part, checkpoint = str(tmp_path / f"part{i}"), str(tmp_path / f"checkpoint{i}")
        envelope.filter(F.col("offset") % 2 == i).repartition(2).write.parquet(part)
        for _ in range(2):  # the second start on the same checkpoint has nothing to do
            txs.start(tp.stream_files(spark, part, max_files=1), sink_of(), checkpoint, {"availableNow": True}).awaitTermination()
    decoded = tp.decode(envelope, TRANSACTION)
    stored, aside = tb.stream_rows(spark, table), tb.set_aside(spark, table)
    assert stored.select("stream").distinct().count() == 2 and stored.filter("batch_id = 0").select("stream").distinct().count() == 2
    assert stored.count() == tp.readable(decoded).count() and aside.count() == tp.unreadable(decoded).count() > 0
    where = ["topic", "kafka_partition", "kafka_offset"]
    assert stored.select(where).unionByName(aside.select(where)).exceptAll(decoded.select(where)).isEmpty()


def test_account_batches_of_two_streams(spark, tmp_path):
    table = up.AccountTable(spark, str(tmp_path / "accounts"), compact_every=2)
    assert table.apply(frame(spark, event("a", "2026-01-01", 1.0)), 0, "one") == 1
    assert table.apply(frame(spark, event("b", "2026-01-01", 2.0)), 0, "two") == 1
    assert table.apply(frame(spark, event("a", "2026-01-01", 1.0)), 0, "one") is None
    assert table.apply(frame(spark, event("a", "2026-01-02", 4.0)), 1, "one") == 1
    assert {r.account_id: r.total_sent for r in table.current().collect()} == {"a": 5.0, "b": 2.0}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        table._commit(0, 9, -1, "MERGE", 1, [0], {})
