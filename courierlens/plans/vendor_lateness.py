"""Minutes of vendor lateness per vendor, zone and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions.clock import on_or_after
from courierlens.functions.measures import sum_or_zero
from courierlens.functions.rules import lateness_minutes
from courierlens.params import Params
from courierlens.plans.dimensions import vendor_list, vendor_zones
from courierlens.sources.catalog import Catalog


def late_orders(catalog: Catalog, params: Params) -> DataFrame:
    """Distinct (vendor, order, date, lateness) of the window, whether the vendor is listed or not.

    Hardly any row repeats another, so folding them ahead of the shuffle would only fill a task's memory
    with all rows of its split. They are dealt by order instead, to a fixed number of partitions, because merged ones
    would grow with the table.
    """
    o = catalog["logistics_orders"]
    late = lateness_minutes(
        o.rider.rider_late_in_seconds,
        o.rider.at_vendor_time_in_seconds,
        o.rider.at_vendor_time_cleaned_in_seconds,
        o.rider.original_scheduled_pickup_at_local,
        o.vendor.picked_up_at_local)
    promised = o.rider.promised_delivery_at_local
    orders = o.filter(
        (o.entity == params.entity)
        & (o.created_date_local >= F.lit(params.history_from))
        & (o.created_date_utc < F.lit(params.as_of))
        & on_or_after(promised, params.history_from)
        & o.vendor_code.isNotNull()
    ).select("vendor_code", "order_code", F.to_date(promised).alias("date_local"),
             late.alias("vendor_lateness_in_min"))
    return dealt(orders, "vendor_code", "order_code", "date_local").distinct()


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to all shuffle partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lateness_rows(catalog: Catalog, params: Params) -> DataFrame:
    """Distinct (vendor, name, order, chain, date, lateness)."""
    return late_orders(catalog, params).join(vendor_list(catalog, params).distinct(), "vendor_code").select(
        "vendor_code", F.col("name").alias("vendor_name"), "order_code", "chain_name", "date_local",
        "vendor_lateness_in_min")


def daily_vendor_lateness(catalog: Catalog, params: Params) -> DataFrame:
    """Totals per vendor and day first; a vendor's names and its distinct zone list then repeat them.

    Of a vendor that is listed under several chains every distinct row counts once per chain.
    """
    per_order = late_orders(catalog, params).groupBy("vendor_code", "date_local", "order_code").agg(
        sum_or_zero(F.col("vendor_lateness_in_min")).alias("late"))
    totals = dealt(per_order, "vendor_code", "date_local").groupBy("vendor_code", "date_local").agg(
        F.sum("late").alias("late"), F.count("order_code").alias("total_order_count"))
    named = vendor_list(catalog, params).distinct().groupBy("vendor_code", F.col("name").alias("vendor_name")).agg(
        F.count(F.lit(1)).alias("chains"))
    return totals.join(named, "vendor_code").join(vendor_zones(catalog, params), "vendor_code", "left").select(
        "vendor_code", "vendor_name", "zone_name", "date_local", (F.col("late") * F.col("chains")).alias("total_vendor_lateness"),
        "total_order_count")
