"""Queries over tables that are laid out for their joins, and what a result's conditions turn away."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from courierlens.functions.accounts import Account
from courierlens.params import Params
from courierlens.plans import conversion
from courierlens.plans.order_economics import daily_orders
from courierlens.sources.catalog import Catalog
from courierlens.sources.layout import laid_out, write_layout
from courierlens.sources.session import shared_folder

BUCKETS = 8


def co_located(catalog: Catalog, names: tuple[str, ...]) -> Catalog:
    """The catalog with some of its tables written by their placements, under names of their own."""
    spark, own = catalog[names[0]].sparkSession, uuid.uuid4().hex[:12]
    tables = {name: f"{name}_{own}" for name in names}
    write_layout(catalog, tables, BUCKETS, shared_folder(spark, "layout"))
    return laid_out(spark, tables, catalog)


def fee_flags_co_located(catalog: Catalog, params: Params) -> DataFrame:
    tables = co_located(catalog, ("shop_orders", "order_vouchers", "order_discounts"))
    return conversion.order_fee_flags(tables, params).select("uuid", "code", "is_low_fee", "is_fee_incentivised")


def restaurant_sessions_co_located(catalog: Catalog, params: Params) -> DataFrame:
    tables = co_located(catalog, ("sessions", "session_verticals"))
    return conversion.restaurant_sessions(tables, params)


def refused_orders(catalog: Catalog, params: Params) -> DataFrame:
    """A row per condition of the order economics, counted while these are computed."""
    account = Account()
    daily_orders(catalog, params, account).write.format("noop").mode("overwrite").save()
    return catalog["shop_orders"].sparkSession.createDataFrame(account.rows(), Account.SCHEMA)


def _counted(name: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS input, '{label}' AS condition, count(*) AS rows, count(*) FILTER (NOT ({test})) AS refused, "
        f"count(*) FILTER (({test}) IS NULL) AS unknown FROM {name}" for label, test in conditions.items())


def refused_sql(p: Params) -> str:
    tenant, before = f"entity = '{p.entity}'", f"created_date_utc < DATE '{p.as_of}'"
    return " UNION ALL ".join([
        _counted("shop_orders", {
            "tenant": tenant, "delivered since": f"expected_delivery_at_local >= TIMESTAMP '{p.economics_from}'", "created before": before,
            "no test": "NOT is_test_order", "valid": "is_valid_order", "by delivery": f"expedition_type = '{p.delivery}'",
            "other minimum": f"minimum_delivery_value_local <> {p.wide_area_minimum}"}),
        _counted("vendor_types", {"tenant": tenant, "other store": f"business_type_apac <> '{p.excluded_store_type}'"}),
        _counted("order_vouchers", {"tenant": tenant, "created before": before}),
        _counted("order_discounts", {"tenant": tenant, "created before": before}),
        _counted("order_profit", {"restaurant": f"vendor_business_type = '{p.restaurant_type}'"})])
