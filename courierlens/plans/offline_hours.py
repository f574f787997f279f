"""Open and unavailable hours per vendor, date and zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions.rules import hours_of
from courierlens.operators.nested import explode_structs
from courierlens.params import Params
from courierlens.plans.dimensions import vendor_list, vendor_zones
from courierlens.sources.catalog import Catalog


def availability_slots(catalog: Catalog, params: Params) -> DataFrame:
    """Distinct (vendor, date, open, unavailable seconds) of slots with open time.

    The open-time filter rejects what an outer unnest would keep, so the unnest is inner.
    """
    a = catalog["vendor_offline"]
    rows = a.filter((a.entity == params.entity) & (a.report_date >= F.lit(params.history_from)))
    slots = explode_structs(
        rows, "availabilities",
        {"total_open_seconds": "total_open_seconds", "total_unavailable_seconds": "total_unavailable_seconds"},
        ["vendor_code", "report_date"])
    return (slots.filter(F.col("total_open_seconds") != 0)
            .withColumn("total_unavailable_seconds", F.coalesce("total_unavailable_seconds", F.lit(0)))
            .distinct())


def vendor_hours(catalog: Catalog, params: Params) -> DataFrame:
    """Listed vendors with their slots in hours; a vendor without slots keeps a NULL date."""
    slots = availability_slots(catalog, params)
    return vendor_list(catalog, params).join(slots, "vendor_code", "left").select(
        "vendor_code", "chain_name", "name", "report_date",
        hours_of(F.col("total_open_seconds")).alias("total_open_hour"),
        hours_of(F.col("total_unavailable_seconds")).alias("total_unavailable_hour"))


def daily_offline_hours(catalog: Catalog, params: Params) -> DataFrame:
    """Rounded hours are summed per vendor and day before anything repeats them.

    A vendor listed several times under one name (other chains) counts its hours as
    often; the distinct zones only repeat the totals.
    """
    per_day = availability_slots(catalog, params).groupBy("vendor_code", "report_date").agg(
        F.sum(hours_of(F.col("total_unavailable_seconds"))).alias("unavailable"),
        F.sum(hours_of(F.col("total_open_seconds"))).alias("open"))
    vendors = vendor_list(catalog, params).groupBy("vendor_code", "name").agg(F.count(F.lit(1)).alias("listed"))
    return (vendors.join(per_day, "vendor_code", "left")
            .join(vendor_zones(catalog, params), "vendor_code", "left")
            .select("vendor_code", F.col("name").alias("vendor_name"), F.col("report_date").alias("date_local"),
                    "zone_name", (F.col("unavailable") * F.col("listed")).alias("total_unavailable_hour"),
                    (F.col("open") * F.col("listed")).alias("total_open_hour"))
            .orderBy("vendor_code", "vendor_name", "date_local", "zone_name"))
