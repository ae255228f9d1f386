"""Headline timings: prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the input and the cores."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from tallywind import JobConfig, build_session
from tallywind.operators import aggregates as ag
from tallywind.operators import arrays as ar
from tallywind.operators import enrich as en
from tallywind.operators import joins as jn
from tallywind.operators import parity as pr
from tallywind.operators import runstats as rs
from tallywind.operators import upsert as up
from tallywind.operators import windows as wn
from tallywind.plans import presets
from tallywind.plans.io_queries import transaction_topic
from tallywind.session import scratch_path
from tallywind.sources import fixtures as fx
from tallywind.sources import topics as tp
from tallywind.sources.schemas import TRANSACTION
from tallywind.streaming import jobs
from tallywind.streaming.transactions import TransactionSink


def consume(df) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def parity(spark, sf_dir):
    left = en.enrich(fx.transactions(spark, sf_dir))
    return pr.compare(left, left.withColumn("amount_usd", left.amount_usd + 0.05))


def parity_equal(spark, sf_dir):
    """Two tables that agree: one pass over each side and no join."""
    left = en.enrich(fx.transactions(spark, sf_dir))
    return pr.compare(left, left.select("*"))


def backfill(spark, sf_dir):
    """The back-fill job over the whole topic into the overwritten table."""
    cfg = JobConfig(transactions_path=scratch_path(spark, "bench-backfill"))
    jobs.run_backfill(spark, cfg, tp.read_files(spark, transaction_topic(spark, sf_dir)))


def upsert_batch(spark, sf_dir):
    up.AccountTable(spark, scratch_path(spark, "bench-accounts")).apply(fx.account_events(spark, sf_dir), 0)


def enrich_and_write(spark, sf_dir):
    """One micro-batch of the transaction stream: JSON decode, enrichment, partitioned write."""
    decoded = tp.decode(tp.read_files(spark, transaction_topic(spark, sf_dir)), TRANSACTION)
    TransactionSink(spark, scratch_path(spark, "bench-table"))(decoded, 0)


WORK = {
    "enrich_and_write": enrich_and_write,
    "enrich": lambda s, d: consume(en.enrich(fx.transactions(s, d))),
    "top_corridors": lambda s, d: consume(presets.top_corridors(fx.transactions(s, d))),
    "currency_statistics": lambda s, d: consume(ag.currency_statistics(fx.transactions(s, d))),
    "pivot_counts": lambda s, d: consume(ag.type_counts(fx.transactions(s, d))),
    "window_columns": lambda s, d: consume(wn.window_analytics(fx.transactions(s, d))),
    "window_columns_sliced": lambda s, d: consume(wn.window_analytics(fx.transactions(s, d), rows_per_slice=100_000)),
    "top_three": lambda s, d: consume(wn.top_per_currency(fx.transactions(s, d))),
    "repeat_offenders": lambda s, d: consume(jn.tag_repeat_offenders(fx.transactions(s, d))),
    "circular": lambda s, d: consume(jn.circular(fx.transactions(s, d))),
    "currency_sets": lambda s, d: consume(ar.multi_currency_senders(fx.transactions(s, d))),
    "upsert_batch": upsert_batch,
    "parity": lambda s, d: consume(parity(s, d)),
    "parity_equal": lambda s, d: consume(parity_equal(s, d)),
    "percentiles": lambda s, d: consume(ag.approx_percentiles(fx.transactions(s, d), "currency", "amount", {"p50": 0.5, "p99": 0.99})),
    "backfill": backfill,
    "run_distribution": lambda s, d: consume(rs.distribution(rs.batch_records(fx.batch_metrics(s, d)), ["total_ms", "write_ms"])),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(JobConfig(master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else None),
                          {"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    warm = Path(sf_dir).parent / "sf0.001"
    if warm.exists():
        for work in WORK.values():
            work(spark, str(warm))
    start = time.perf_counter()
    rows = fx.transactions(spark, sf_dir).count()
    transaction_topic(spark, sf_dir)
    setup = time.perf_counter() - start
    seconds = {}
    for name, work in WORK.items():
        start = time.perf_counter()
        work(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "transactions": rows, "setup_sec": round(setup, 3),
        "enrich_and_write_rows_per_sec": round(rows / seconds["enrich_and_write"]),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
