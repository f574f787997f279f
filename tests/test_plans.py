"""What the optimizer makes of the plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from courierlens import plans
from courierlens.operators.joins import semi_in
from courierlens.plans.restaurant_funnel import transaction_events
from courierlens.registry.marts import RESULTS
from courierlens.sources.sample import TRAFFIC, sample_catalog
from rows import catalog

SF_DIR = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_no_nested_loops_and_no_python(spark, name):
    plan = physical(entry_points.queries()[name](spark, SF_DIR))
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct|Python|ExistenceJoin|Expand", plan)


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_joins_sort_merge_beyond_the_broadcast_limit(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(entry_points.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in plan


def test_a_hot_key_is_split_beyond_the_broadcast_limit(spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "8",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {name: spark.conf.get(name, None) for name in small}
    orders = spark.range(0, 300000, 1, 4).select(
        F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("k"))
    listed = spark.range(5000).select(F.concat(F.lit("v"), F.col("id")).alias("m")).union(spark.sql("SELECT 'hot'"))
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        counted = semi_in(orders, "k", listed, "m").groupBy("k").agg(F.count("o").alias("n"))
        assert counted.agg(F.sum("n"), F.max("n")).first() == (300000, 100000)
        counted.collect()
        assert "skew=true" in physical(counted)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    columns = {"sessions": [{"ga_session_id": "s"}], "session_verticals": [{"ga_session_id": "s"}]}
    frames = catalog(spark, **columns)
    for name in columns:
        frames[name].write.parquet(str(tmp_path / name))
    from courierlens import Catalog
    from courierlens.plans.conversion import restaurant_sessions
    text = formatted(restaurant_sessions(Catalog.from_parquet(spark, str(tmp_path)), TRAFFIC))
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*?)\]", text))
    for expected in ("EqualTo(entity,home)", "GreaterThanOrEqual(session_start_timestamp_utc,2023-11-29T16:00)",
                     "LessThan(session_start_timestamp_utc,2024-01-31T16:00)", "GreaterThanOrEqual(partition_date,2023-11-30)",
                     "IsNotNull(lg_zone_name)", "EqualTo(expedition_type,delivery)"):
        assert expected in pushed
    read = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert any("expedition_type" in r and "lg_zone" not in r for r in read)


def test_best_row_is_limited_before_the_shuffle(spark):
    plan = physical(transaction_events(sample_catalog(spark, SF_DIR, "traffic"), TRAFFIC))
    assert plan.count("WindowGroupLimit") == 2


def test_member_list_is_shuffled_once(spark):
    df = entry_points.queries()["surge_order_profit"](spark, SF_DIR)
    df.collect()
    assert "ReusedExchange" in physical(df)


def test_observations_are_shuffled_once(spark):
    df = entry_points.queries()["delay_validity"](spark, SF_DIR)
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet") == 2  # events, zones


def test_active_count_reads_spans_once(spark):
    df = entry_points.queries()["active_count"](spark, SF_DIR)
    assert physical(df).count("FileScan parquet") == 2  # orders, customer


def test_events_are_read_twice_at_most(spark):
    df = plans.daily_restaurant_conversion_funnel(sample_catalog(spark, SF_DIR, "traffic"), TRAFFIC)
    # browsing rows, transaction rows, and the orders derived from the same file
    assert physical(df).split("== Initial Plan ==")[-1].count("FileScan parquet") == 4
