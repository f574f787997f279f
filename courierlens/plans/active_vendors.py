"""Vendors under contract per date and zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.operators.intervals import active_count
from courierlens.operators.joins import semi_in
from courierlens.operators.spines import date_spine
from courierlens.params import Params
from courierlens.plans.dimensions import real_vendors, vendor_zones
from courierlens.sources.catalog import Catalog


def contract_spans(catalog: Catalog, params: Params) -> DataFrame:
    """Per (vendor, zone): latest start and latest end over all contracts, taken apart.

    An open contract ends on ``open_contract_end``. Vendors without account or contract
    are rejected by the tenant filters on those tables, so both joins are inner.
    """
    a, c = catalog["crm_accounts"], catalog["crm_contracts"]
    accounts = a.filter(a.entity == params.entity).select("id", "vendor_code").distinct()
    contracts = c.filter(c.entity == params.entity).select(
        F.col("sf_account_id").alias("id"), "start_date_local",
        F.coalesce("end_date_local", F.lit(params.open_contract_end)).alias("end_date_local"))

    # Maxima do not mind repeats, so each level is reduced before the next join.
    def latest(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.max("start_date_local").alias("start_date_local"),
                                   F.max("end_date_local").alias("end_date_local"))

    per_vendor = latest(accounts.join(latest(contracts, "id"), "id"), "vendor_code")
    spans = semi_in(per_vendor, "vendor_code", real_vendors(catalog, params), "vendor_code")
    return spans.join(vendor_zones(catalog, params), "vendor_code", "left").select(
        "vendor_code", "zone_name", "start_date_local", "end_date_local")


def vendor_days(catalog: Catalog, params: Params) -> DataFrame:
    """The spans spelled out: every (vendor, zone) on every date, with whether it is in force.

    Kept for callers that want the rows; the count below does not need them.
    """
    days = date_spine(contract_spans(catalog, params), F.lit(params.history_from), F.lit(params.last_day))
    inside = F.col("date_local").between(F.col("start_date_local"), F.col("end_date_local"))
    return days.withColumn("is_active", F.coalesce(inside, F.lit(False)))


def daily_active_vendors(catalog: Catalog, params: Params) -> DataFrame:
    """(vendor, zone) occurs once in the spans, so counting spans counts distinct vendors."""
    spans = contract_spans(catalog, params).filter(F.col("zone_name").isNotNull())
    return active_count(spans, "zone_name", "start_date_local", "end_date_local",
                        params.history_from, params.last_day, name="active_vendors"
                        ).orderBy("date_local", "zone_name")
