"""Co-located tables, sums without an order, and the account of refused rows."""

from __future__ import annotations

import math
import random
import struct
import uuid
from dataclasses import replace
from datetime import date, datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from courierlens import Params, plans
from courierlens.functions.accounts import Account
from courierlens.functions.measures import exact_sum
from courierlens.plans import conversion
from courierlens.registry.layouts import co_located
from courierlens.sources.catalog import Catalog
from courierlens.sources.layout import Placement, write_table
from courierlens.sources.sample import COMMERCE, TRAFFIC, sample_catalog
from rows import catalog, result

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_joins_of_co_located_tables_have_no_exchange(spark):
    given = sample_catalog(spark, SF_DIR, "traffic")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # As for tables too large to be broadcast.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tables = co_located(given, ("shop_orders", "order_vouchers", "order_discounts"))
        flags = conversion.order_fee_flags(tables, TRAFFIC)
        assert "Exchange" not in plan_of(flags) and "SortMergeJoin" in plan_of(flags)
        assert "Exchange" in plan_of(conversion.order_fee_flags(given, TRAFFIC))
        assert result(flags) == result(conversion.order_fee_flags(given, TRAFFIC))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_key_is_looked_up_in_one_bucket_of_each_day(spark, tmp_path):
    rows = spark.range(2000).select(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 4).cast("int")).alias("day"), F.concat(F.lit("k"), F.col("id") % 50).alias("key"), "id")
    name = f"t_{uuid.uuid4().hex[:8]}"
    write_table(rows, name, Placement("day", "key"), 4, f"file://{tmp_path}")
    found = spark.table(name).filter("key = 'k7' and day = date'2024-01-04'")
    # Without joins Spark reads buckets like other files; the plan shows which only where that is turned off.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan_of(found) and "PartitionFilters: [isnotnull(day" in plan_of(found)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert result(found, "id") == result(rows.filter("key = 'k7' and day = date'2024-01-04'"), "id")
    files = {r[0] for r in spark.table(name).select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 16 and spark.table(name).count() == 2000
    sizes = spark.table(name).withColumn("f", F.input_file_name()).groupBy("f").agg((F.count_distinct("key") >= 1).alias("ok"), F.collect_list("key").alias("keys")).collect()
    assert all(r["keys"] == sorted(r["keys"]) for r in sizes)


def bits(value):
    return None if value is None else struct.pack("<d", value)


def test_exact_sums_are_exact_and_have_no_order(spark):
    rng = random.Random(7)
    groups = {
        "money": [rng.randrange(-10**7, 10**7) / 100 for _ in range(800)], "thirds": [rng.random() / 3 for _ in range(500)],
        "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-15, 18) for _ in range(500)], "cancel": [1e20, 1.0, -1e20, 3.5e-9] * 20, "one": [0.1],
        "none": [None, None], "some": [None, 0.25, None, -0.75], "zero": [0.0, -0.0]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    found = set()
    for parts in (1, 3, 50):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
        found.add(tuple(sorted((r["k"], bits(r["s"])) for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect())))
    assert len(found) == 1
    for k, s in found.pop():
        values = [v for v in groups[k] if v is not None]
        if not values:
            assert s is None
            continue
        want = sum(map(Fraction, values))
        assert abs(Fraction(struct.unpack("<d", s)[0]) - want) <= max(abs(want) / 2**52, Fraction(len(values), 2**72))
    odd = spark.createDataFrame([("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), ("nan", 1.0), ("big", 1e300), ("big", 1e300), ("big", 2.0)], "k string, v double")
    got = {r["k"]: r["s"] for r in odd.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got["inf"] == math.inf and math.isnan(got["nan"]) and got["big"] == 2e300


@pytest.mark.parametrize("name", ["daily_orders", "daily_conversion_by_shrink", "daily_conversion_by_surge"])
def test_results_are_the_same_bit_for_bit_at_any_partitioning(spark, name):
    """Amounts in thirds, so that plain sums do depend on the order."""
    edition, params = ("commerce", COMMERCE) if name == "daily_orders" else ("traffic", TRAFFIC)
    given = sample_catalog(spark, SF_DIR, edition)
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def uneven(table):
        rows = given[table]
        amounts = [c for c, kind in rows.dtypes if kind == "double" and c in ("gpo_excl_wastage", "gmv_local", "ad_rev_per_order", "value_local", "discount_amount_local", "total_value_local")]
        return rows.withColumns({c: F.col(c) / 3 + F.col(c) * 1e-9 for c in amounts})

    def rows(parts, exact):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        tables = Catalog(lambda table: uneven(table).repartition(parts))
        got = getattr(plans, name)(tables, replace(params, exact_sums=exact)).collect()
        return sorted(tuple(bits(v) if isinstance(v, float) else str(v) for v in r) for r in got)

    try:
        first = rows(1, True)
        assert first and all(rows(parts, True) == first for parts in (8, 40))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_is_refused_is_counted_in_the_same_pass(spark):
    p = Params(entity="home", as_of=date(2024, 2, 1))
    order = {"uuid": "u", "code": "c", "vendor_code": "v", "total_value_local": 20.0, "delivery_fee_original_local": 3.0}
    c = catalog(spark, shop_orders=[order, {**order, "entity": "away"}, {**order, "entity": None, "is_test_order": True}, {**order, "minimum_delivery_value_local": None},
                                    {**order, "minimum_delivery_value_local": 25.0}, {**order, "expected_delivery_at_local": datetime(2020, 1, 1)}],
                order_vouchers=[{"uuid": "u"}], order_discounts=[{"uuid": "u"}, {"uuid": "u", "created_date_utc": None}],
                order_profit=[{"order_code": "c", "zone_name": "north"}, {"order_code": "c", "vendor_business_type": None}], vendor_types=[{"vendor_code": "v"}])
    account = Account()
    counted = plans.daily_orders(c, p, account)
    assert plan_of(counted).count("CollectMetrics [") + plan_of(counted).count("CollectMetrics (") >= 1
    assert result(counted) == result(plans.daily_orders(c, p))
    rows = {(table, condition): counts for table, condition, *counts in account.rows()}
    assert rows["shop_orders", "tenant"] == [6, 1, 1] and rows["shop_orders", "no test"] == [6, 1, 0]
    assert rows["shop_orders", "other minimum"] == [6, 1, 1] and rows["shop_orders", "delivered since"] == [6, 1, 0] and rows["shop_orders", "valid"] == [6, 0, 0]
    assert rows["order_discounts", "created before"] == [2, 0, 1] and rows["order_profit", "restaurant"] == [2, 0, 1] and len(rows) == 14
