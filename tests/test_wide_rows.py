"""Steps over wide rows: records are parsed once, and newest rows are found without sorting all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallywind.plans.catalog import CATALOG
from tallywind.sources import topics as tp
from tallywind.sources.schemas import ACCOUNT

from plan_views import plan_text

RECORDS = [("a", '{"account_id": "a", "balance": 1.5}'), ("b", '{"balance": 2.0}'), ("c", '{"account_id": "c", "bal'), ("d", None), ("e", '{"account_id": null}')]


def envelope(spark):
    rows = spark.createDataFrame(RECORDS, "key string, value string")
    return rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
                       F.lit(1).cast("long").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"))


def test_a_record_is_parsed_once_where_it_is_filtered(spark, sf_dir):
    plan = plan_text(CATALOG["s7_keyless_events"].build(spark, sf_dir))
    assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator(") == 1


def test_both_ways_of_decoding_give_the_same_rows(spark):
    plain, once = (sorted(map(str, f(envelope(spark), ACCOUNT).collect())) for f in (tp.decode, tp.decode_once))
    assert plain == once and len(once) == len(RECORDS)
    assert [r.account_id for r in tp.account_updates(envelope(spark), ACCOUNT).collect()] == ["a"]


@pytest.mark.parametrize("name", ["m2_merge_source", "w11_latest_per_account"])
def test_newest_rows_need_no_sort(spark, sf_dir, name):
    plan = plan_text(CATALOG[name].build(spark, sf_dir))
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_wide_steps_are_left_to_methods_that_are_compiled(spark, sf_dir):
    CATALOG["x1_enriched_transactions"].build(spark, sf_dir)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
