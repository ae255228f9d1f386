"""Joins on either side of the broadcast limits, the bitmap before large lookups, and sketches merged in levels."""

from __future__ import annotations

import random
import time

import pytest
from plan_views import plan_text
from pyspark.sql import functions as F

from tallywind.operators import joins as jn
from tallywind.operators import sketches as sk
from tallywind.session import TIDY, lookup, stage
from tallywind.sources import tables


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(6)
    left = [(i, None if i % 50 == 0 else f"k{draw.randrange(3000)}") for i in range(5000)]
    right = [(f"k{i}", i) for i in range(0, 3000, 7)] + [(None, -1)]
    return spark.createDataFrame(left, "id long, at string").repartition(4), spark.createDataFrame(right, "key string, found long")


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_large_lookups_equal_plain_joins(sides, how):
    left, right = sides
    wanted = left.join(right, left["at"] == right["key"], how).drop("key")
    for limit in (10, 10_000):
        got = jn.lookup_join(left, "at", lookup(right, "side", limit), "key", how).drop("key")
        assert got.columns == wanted.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_bitmap_stands_before_large_lookups_only(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        small, large = (plan_text(jn.lookup_join(left, "at", lookup(right, "side", n), "key", "left_semi")) for n in (10_000, 10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small and "bit_get" not in small
    assert "SortMergeJoin" in large and "bit_get" in large


def test_bitmap_lets_few_strangers_through(spark):
    keys, others = (spark.range(a, a + 20_000).select(F.concat(F.lit("x"), "id").alias("k")) for a in (0, 50_000))
    bitmap = jn.key_bitmap(keys, "k")
    assert bitmap.count() <= jn.BITMAP_BITS // jn.ROW_BITS
    assert jn.with_partner_flag(keys, F.col("k"), bitmap).filter("_may_match").count() == 20_000
    assert jn.with_partner_flag(others, F.col("k"), bitmap).filter("_may_match").count() < 20


def test_empty_lookups(sides):
    left, right = sides
    none = lookup(right.limit(0), "none", -1)
    assert not none.small and none.rows == 0
    assert jn.lookup_join(left, "at", none, "key", "left_anti").count() == left.count()
    assert jn.lookup_join(left, "at", none, "key", "left_semi").count() == 0


@pytest.mark.parametrize("fan_in", [2, 32])
def test_percentiles_are_exact_up_to_the_sketch_size(spark, fan_in, monkeypatch):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, float("nan"), round(draw.uniform(-9, 9), 2)])) for _ in range(4000)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(11)
    staged = []
    monkeypatch.setattr(sk, "stage", lambda frame, label, inner=sk.stage: staged.append(inner(frame, label)) or staged[-1])
    got = {r.k: r for r in sk.percentiles_per_key(df, "k", "x", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, fan_in=fan_in).collect()}
    for key in ("a", "b", None):
        values = sorted(x for k, x in rows if k == key and x is not None and x == x)
        for name, p in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            assert got[key][name] == values[max(-(-int(p * 10_000) * len(values) // 10_000) - 1, 0)]
    assert got["empty"].p50 is None
    blocks = [s.select("_block").distinct().count() for s in staged]  # eleven partitions, halved until one is left
    assert blocks == ([6, 3, 2, 1] if fan_in == 2 else [1])


def test_small_sketches_keep_their_rank_error(spark):
    df = spark.range(200_000, numPartitions=9).select(F.lit("k").alias("k"), F.rand(3).alias("x"))
    row = sk.percentiles_per_key(df, "k", "x", {"p50": 0.5, "p99": 0.99}, size=2000, fan_in=3).first()
    shares = df.agg(F.avg((F.col("x") <= row.p50).cast("int")), F.avg((F.col("x") <= row.p99).cast("int"))).first()
    assert abs(shares[0] - 0.5) < 0.005 and abs(shares[1] - 0.99) < 0.005


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("write", ["stage", "overwrite"])
def test_writes_leave_no_shuffle_files(spark, tmp_path, write):
    df = spark.range(20_000).selectExpr("id", "md5(CAST(id AS STRING)) AS h", "id % 3 AS part").repartition(5, "h")
    setting, before = spark.conf.get(TIDY, None), _shuffle_files(spark)
    if write == "stage":
        assert len(stage(df, "tidy").collect()) == 20_000
    else:
        tables.overwrite(tables.balanced(df, ["part"]), str(tmp_path / "t"), ["part"])
        assert len(tables.read(spark, str(tmp_path / "t")).collect()) == 20_000
    left = 20
    while left and {f for f in _shuffle_files(spark) - before if f.endswith(".data")}:
        time.sleep(0.25)
        left -= 1
    assert left
    assert spark.conf.get(TIDY, None) == setting
