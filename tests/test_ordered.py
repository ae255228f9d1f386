"""Sliced windows against brute force, on data where one key, one value or missing values hold a third of all rows."""

from __future__ import annotations

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywind.operators.ordered import (OrderedRows, centred_mean, offset_and_running, quantiles, rank_columns, row_numbers,
                                         running_total)

ROWS, SLICE = 3000, 100


def rows(kind: str):
    rng = random.Random(7)
    out = []
    for i in range(ROWS):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}"
        value = round(rng.random() * 50, 1)
        if kind == "hot_value" and rng.random() < 0.4:
            value = 7.5
        if kind == "hot_null" and rng.random() < 0.4:
            value = None
        if kind == "null_key" and rng.random() < 0.4:
            key = None
        out.append((f"id{i}", key, value, None if rng.random() < 0.05 else round(rng.random() * 900, 2)))
    return out


@pytest.fixture(scope="module", params=["hot_key", "hot_value", "hot_null", "null_key"])
def data(request, spark, tmp_path_factory):
    source = rows(request.param)
    path = str(tmp_path_factory.mktemp("ordered") / request.param)
    spark.createDataFrame(source, "id string, key string, value double, amount double").repartition(5).write.parquet(path)
    groups = {}
    for row in source:
        groups.setdefault(row[1], []).append(row)
    return spark.read.parquet(path), groups


def tie(ident: str) -> str:
    return hashlib.md5(ident.encode()).hexdigest()


def ascending(group):
    return sorted(group, key=lambda r: (r[2] is not None, r[2] or 0.0, tie(r[0])))


def descending(group):
    return sorted(group, key=lambda r: (r[2] is None, -(r[2] or 0.0), tie(r[0])))


def money(x):
    return None if x is None else Decimal(str(x))


def test_no_cell_outgrows_a_few_slices(data):
    df, _ = data
    ordered = OrderedRows(df, ["key"], F.col("value"), F.md5("id"), False, SLICE)
    sizes = [r["n"] for r in ordered.summary(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == ROWS and len(sizes) > 20 and max(sizes) <= 3 * SLICE


def test_cells_follow_the_rows(spark, tmp_path):
    """Many keys and many slices: not a cell per key and slice."""
    path = str(tmp_path / "many")
    spark.range(4000).selectExpr("CAST(id AS STRING) AS id", "IF(id % 4 = 0, 'hot', CONCAT('k', id % 40)) AS key", "CAST(id * 7919 % 4000 AS DOUBLE) AS value").write.parquet(path)
    df = spark.read.parquet(path)
    ordered = OrderedRows(df, ["key"], F.col("value"), F.md5("id"), False, 50)
    sizes = [r["n"] for r in ordered.summary(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) <= 8 * 4000 / 50 and max(sizes) <= 8 * 50
    small = OrderedRows(df, ["key"], F.col("value"), F.md5("id"), False, 101).summary(F.count(F.lit(1)).alias("n")).filter("_key0 <> '=hot'")
    assert {r["n"] for r in small.collect()} == {100}  # a key that fits a slice is one cell
    for falling in (True, False):
        got, wanted = (rank_columns(df, ["key"], F.col("value"), F.md5("id"), falling, size) for size in (50, 10 ** 6))
        assert sorted(got.select("id", "row_number").collect()) == sorted(wanted.select("id", "row_number").collect())


@pytest.mark.parametrize("slice_rows", [SLICE, 10_000])
def test_ranks(data, slice_rows):
    df, groups = data
    got = {r["id"]: (r["row_number"], r["rank"], r["dense_rank"], round(r["percent_rank"], 9))
           for r in rank_columns(df, ["key"], F.col("value"), F.md5("id"), True, slice_rows).collect()}
    for group in groups.values():
        ordered, rank, dense = descending(group), 0, 0
        for i, row in enumerate(ordered):
            if i == 0 or row[2] != ordered[i - 1][2]:
                rank, dense = i + 1, dense + 1
            share = (rank - 1) / (len(group) - 1) if len(group) > 1 else 0.0
            assert got[row[0]] == (i + 1, rank, dense, round(share, 9))


@pytest.mark.parametrize("slice_rows", [SLICE, 10_000])
def test_row_numbers(data, slice_rows):
    df, groups = data
    got = {r["id"]: (r["row_number"], r["group_rows"]) for r in row_numbers(df, ["key"], F.col("value"), F.md5("id"), False, slice_rows).collect()}
    for group in groups.values():
        for i, row in enumerate(ascending(group)):
            assert got[row[0]] == (i + 1, len(group))


@pytest.mark.parametrize("slice_rows", [SLICE, 10_000])
def test_offsets_and_totals(data, slice_rows):
    df, groups = data
    total = F.col("amount").cast("decimal(18,2)")
    history = offset_and_running(df, ["key"], F.col("value"), F.md5("id"), "amount", total, slice_rows)
    got = {r["id"]: (r["previous"], r["following"], r["running"]) for r in history.collect()}
    again = {r["id"]: (r["upto"], r["whole"]) for r in running_total(
        df, ["key"], F.col("value"), F.md5("id"), total, "upto", slice_rows, "whole").collect()}
    for group in groups.values():
        ordered, running = ascending(group), None
        whole = sum(money(r[3]) for r in group if r[3] is not None)
        for i, row in enumerate(ordered):
            if row[3] is not None:
                running = (running or 0) + money(row[3])
            before = ordered[i - 1][3] if i else None
            after = ordered[i + 1][3] if i + 1 < len(ordered) else None
            assert got[row[0]] == (before, after, running)
            assert again[row[0]] == (running, whole)


@pytest.mark.parametrize("slice_rows", [SLICE, 10_000])
def test_centred_mean(data, slice_rows):
    df, groups = data
    frame = centred_mean(df, ["key"], F.col("value"), F.md5("id"), F.col("amount").cast("decimal(18,2)"), "mean", 2, 2, slice_rows)
    got = {r["id"]: r["mean"] for r in frame.collect()}
    for group in groups.values():
        ordered = ascending(group)
        for i, row in enumerate(ordered):
            near = [int(round(r[3] * 100)) for r in ordered[max(0, i - 2):i + 3] if r[3] is not None]
            assert got[row[0]] == ((2 * sum(near) + len(near)) // (2 * len(near)) / 100 if near else None)


@pytest.mark.parametrize("interpolate", [True, False])
def test_quantiles(data, interpolate):
    df, groups = data
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["key"]: r for r in quantiles(df, ["key"], "value", shares, interpolate, SLICE).collect()}
    for key, group in groups.items():
        values = sorted(r[2] for r in group if r[2] is not None)
        for name, p in shares.items():
            if interpolate:
                at = p * (len(values) - 1)
                low = int(at)
                high = min(low + 1, len(values) - 1)
                wanted = values[low] + (values[high] - values[low]) * (at - low)
            else:
                wanted = values[max(-int(-p * len(values) // 1), 1) - 1]
            assert got[key][name] == pytest.approx(wanted, abs=1e-9)


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    """Null ids, null, NaN and repeated values, and null keys, each of them often."""
    rng = random.Random(11)
    out = []
    for i in range(1500):
        value = rng.choice([None, float("nan"), 50.0, round(rng.random() * 99, 1)])
        out.append((None if rng.random() < 0.3 else f"id{i}", rng.choice([None, "a", "b"]), value))
    path = str(tmp_path_factory.mktemp("ordered") / "gaps")
    spark.createDataFrame(out, "id string, key string, value double").repartition(7).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("falling", [True, False])
def test_slices_do_not_change_ranks(gaps, falling):
    def ranks(size):
        df = rank_columns(gaps, ["key"], F.col("value"), F.md5("id"), falling, size)
        return sorted(map(repr, df.select("id", "key", "value", "rank", "dense_rank", "percent_rank").collect()))

    assert ranks(20) == ranks(10 ** 6)
    numbered = rank_columns(gaps, ["key"], F.col("value"), F.md5("id"), falling, 20)
    for row in numbered.groupBy("key").agg(F.sort_array(F.collect_list("row_number")).alias("n")).collect():
        assert row.n == list(range(1, len(row.n) + 1))


def test_one_row_shuffle_per_step(spark, gaps, monkeypatch):
    from tallywind.operators import ordered

    monkeypatch.setattr(ordered, "lookup_side", lambda df, label: ordered.stage(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = rank_columns(gaps, ["key"], F.col("value"), F.md5("id"), True, 100)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # the rows and the summary, and none between join and windows


def test_no_values_at_all(spark):
    df = spark.createDataFrame([(str(i), "a", None) for i in range(50)], "id string, key string, value double")
    got = sorted((r["row_number"], r["rank"]) for r in rank_columns(df, ["key"], F.col("value"), F.md5("id"), True, 5).collect())
    assert got == [(i + 1, 1) for i in range(50)]
    assert rank_columns(df.limit(0), ["key"], F.col("value"), F.md5("id"), True, 5).count() == 0
