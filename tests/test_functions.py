from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from courierlens import Catalog, Params
from courierlens.functions import clock, measures, rules
from courierlens.params import months_before


@pytest.mark.parametrize("day, months, expected", [
    (date(2024, 1, 31), 2, date(2023, 11, 30)),
    (date(2024, 4, 30), 2, date(2024, 2, 29)),
    (date(2023, 3, 1), 14, date(2022, 1, 1)),
    (date(2024, 2, 29), 12, date(2023, 2, 28)),
])
def test_months_before_clips(spark, day, months, expected):
    assert months_before(day, months) == expected
    assert spark.range(1).select(F.add_months(F.lit(day), -months)).first()[0] == expected


def test_window_of_params():
    p = Params(entity="x", as_of=date(2024, 5, 1))
    assert (p.lookback_start, p.last_day) == (date(2024, 2, 29), date(2024, 4, 30))


@pytest.mark.parametrize("late, wait, clean, planned, picked, expected", [
    (1, 301, 90, None, None, 1.5),
    (599, 301, 90, None, None, 1.5),
    (600, 301, 90, None, None, None),
    (1, 300, 90, None, None, None),
    (0, 301, 90, "2024-01-10 12:00:00", "2024-01-10 12:01:00", 1.0),
    (-5, 0, 90, "2024-01-10 12:00:00", "2024-01-10 12:00:00", None),
    (-5, 0, 90, "2024-01-10 12:00:00", "2024-01-10 11:59:00", None),
    # Second boundaries count: 0.3 s apart across one boundary is one second.
    (0, 0, 0, "2024-01-10 12:00:00.9", "2024-01-10 12:00:06.1", 0.1),
    (0, 0, 0, "2024-01-10 12:00:00.1", "2024-01-10 12:00:00.9", 0.0),
    (None, 301, 90, "2024-01-10 12:00:00", "2024-01-10 12:01:00", None),
])
def test_lateness_boundaries(spark, late, wait, clean, planned, picked, expected):
    df = spark.createDataFrame([(late, wait, clean, planned, picked)],
                               "late bigint, wait bigint, clean bigint, planned string, picked string")
    minutes = rules.lateness_minutes(F.col("late"), F.col("wait"), F.col("clean"),
                                     F.col("planned").cast("timestamp_ntz"), F.col("picked").cast("timestamp_ntz"))
    assert df.select(minutes).first()[0] == expected


def test_truncation_keeps_wall_clock(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:59:59.999999' AS ts")
    row = df.select(clock.minute_of(F.col("ts")), clock.hour_of(F.col("ts")), clock.second_of(F.col("ts")),
                    clock.to_local(F.col("ts"), 8)).first()
    assert list(row) == [datetime(2024, 3, 31, 2, 59), datetime(2024, 3, 31, 2), datetime(2024, 3, 31, 2, 59, 59),
                         datetime(2024, 3, 31, 10, 59, 59, 999999)]
    assert dict(df.select(clock.minute_of(F.col("ts")).alias("m")).dtypes) == {"m": "timestamp_ntz"}


def test_day_bounds_equal_date_comparison(spark):
    df = spark.sql("""SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00', TIMESTAMP_NTZ '2024-01-06 00:00',
                                     INTERVAL 7 HOURS)) AS ts""")
    first, last = date(2024, 1, 2), date(2024, 1, 4)
    direct = F.to_date("ts").between(F.lit(first), F.lit(last))
    local = F.to_date(clock.to_local(F.col("ts"), 8)).between(F.lit(first), F.lit(last))
    assert df.filter(direct != clock.day_between(F.col("ts"), first, last)).count() == 0
    assert df.filter(local != clock.local_day_between(F.col("ts"), 8, first, last)).count() == 0


def test_first_matching_label_wins_and_underscore_is_a_wildcard(spark):
    p = Params(entity="x")
    df = spark.createDataFrame([("SHRINK_1 and close",), ("shrinkX2",), ("Close",), ("shrinkage",), (None,)], "t string")
    labels = [r[0] for r in df.select(rules.classify_like(F.col("t"), p.shrink_labels, p.no_shrink)).collect()]
    assert labels == ["shrink_1", "shrink_2", "close", "no_shrink", "no_shrink"]


def test_null_name_is_not_allowed(spark):
    df = spark.createDataFrame([("Good",), ("An ISLANDWIDE one",), (None,)], "n string")
    assert [r[0] for r in df.filter(rules.name_allowed(F.col("n"), ["%islandwide%"])).collect()] == ["Good"]


def test_net_fee_floor_keeps_null(spark):
    df = spark.createDataFrame([(-0.5,), (1.005,), (None,)], "x double")
    assert [r[0] for r in df.select(rules.floor_zero(F.col("x"), 2)).collect()] == [0.0, 1.01, None]


def test_ratio_is_null_on_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(measures.ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25, None]


def test_catalog_checks_columns(spark):
    short = spark.sql("SELECT 'a' AS zone, TIMESTAMP_NTZ '2024-01-01 00:00' AS ts")
    with pytest.raises(ValueError, match="rainfall_mm: missing"):
        Catalog.from_frames({"rain": short})["rain"]
    with pytest.raises(KeyError, match="unknown"):
        Catalog.from_frames({})["nope"]


def test_catalog_rejects_float32_fees(spark):
    rain = spark.sql("SELECT 'a' AS zone, TIMESTAMP_NTZ '2024-01-01 00:00' AS ts, CAST(1 AS FLOAT) AS rainfall_mm")
    with pytest.raises(ValueError, match="float32"):
        Catalog.from_frames({"rain": rain})["rain"]


def test_catalog_reads_instants_as_wall_clock(spark):
    orders = spark.sql("""
        SELECT 'home' AS entity, 'v' AS vendor_code, 'o' AS order_code, DATE '2024-01-10' AS created_date_local,
               DATE '2024-01-10' AS created_date_utc, named_struct(
                 'promised_delivery_at_local', TIMESTAMP '2024-01-10 12:00', 'rider_late_in_seconds', 1L,
                 'at_vendor_time_in_seconds', 1L, 'at_vendor_time_cleaned_in_seconds', 1L,
                 'original_scheduled_pickup_at_local', TIMESTAMP '2024-01-10 12:00') AS rider,
               named_struct('picked_up_at_local', TIMESTAMP '2024-01-10 12:01') AS vendor""")
    read = Catalog.from_frames({"logistics_orders": orders})["logistics_orders"]
    assert "timestamp," not in read.schema.simpleString().replace("timestamp_ntz", "")
    assert read.select("rider.promised_delivery_at_local").first()[0] == datetime(2024, 1, 10, 12)


def test_catalog_reads_parquet_and_tables(spark, tmp_path):
    rain = spark.sql("SELECT 'a' AS zone, TIMESTAMP_NTZ '2024-01-01 00:00' AS ts, CAST(1 AS DOUBLE) AS rainfall_mm, 1 AS more")
    rain.write.parquet(str(tmp_path / "rain"))
    assert Catalog.from_parquet(spark, str(tmp_path))["rain"].count() == 1
    rain.createOrReplaceTempView("warehouse_rain")
    assert Catalog.from_tables(spark, {"rain": "warehouse_rain"})["rain"].count() == 1
