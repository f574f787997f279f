"""Parts shared by the two conversion results (by shrink level and by surge level)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions.clock import day_between, local_day_between, lookback, to_local
from courierlens.functions.measures import ever
from courierlens.functions.rules import any_like, flag, fully_platform_funded
from courierlens.operators.joins import not_in, semi_in
from courierlens.params import Params
from courierlens.sources.catalog import Catalog


class Facts(NamedTuple):
    """What both results are computed from: sessions as of ``restaurant_sessions``, profit rows of all
    restaurant orders, and those of them whose delivery fee was not cut."""

    sessions: DataFrame
    profit: DataFrame
    full_fee: DataFrame


def facts(catalog: Catalog, params: Params) -> Facts:
    """The window's facts, straight from the input tables."""
    return Facts(restaurant_sessions(catalog, params), restaurant_profit(catalog, params), full_fee_profit(catalog, params))


def order_fee_flags(catalog: Catalog, params: Params) -> DataFrame:
    """Orders of the window, whether their fee was low at the platform's cost, or cut at all.

    A fee is cut by a platform-funded low fee or by free delivery. An order counts if any pairing of its voucher and discount rows does, and it needs
    one of each. The test is an OR of a voucher part and a discount part, so each side
    is reduced to one row per order before the joins: pairings are never formed, and
    a key with many rows, copies of an order included, shrinks before the shuffle.
    """
    o, v, d = catalog["shop_orders"], catalog["order_vouchers"], catalog["order_discounts"]
    pattern = [f"%{params.free_delivery}%"]
    orders = o.filter(
        (o.entity == params.entity)
        & day_between(o.expected_delivery_at_local, params.lookback_start, params.last_day)
        & lookback(o.created_date_utc, params)
    ).select("uuid", "code", o.delivery_fee_local.isin(*params.low_fees).alias("low_fee")).distinct()
    vouchers = (v.filter((v.entity == params.entity) & lookback(v.created_date_utc, params))
                .groupBy("uuid").agg(ever(any_like(v.type, pattern)).alias("voucher_free")))
    discounts = (d.filter((d.entity == params.entity) & lookback(d.created_date_utc, params))
                 .groupBy("uuid").agg(ever(any_like(d.discount_type, pattern)).alias("discount_free"),
                                      ever(fully_platform_funded(d.platform_share_pct)).alias("funded")))
    return joined_fee_flags(orders, vouchers, discounts)


def joined_fee_flags(orders: DataFrame, vouchers: DataFrame, discounts: DataFrame) -> DataFrame:
    """Flags from distinct (uuid, code, low_fee), and one row per uuid of vouchers and of discounts."""
    low = F.col("low_fee") & F.col("funded")
    cut = F.col("discount_free") | F.col("voucher_free") | low
    return orders.join(vouchers, "uuid").join(discounts, "uuid").select(
        "uuid", "code", flag(low).alias("is_low_fee"), flag(cut).alias("is_fee_incentivised"))


def fee_incentivised_codes(catalog: Catalog, params: Params) -> DataFrame:
    """Codes of the orders whose delivery fee was cut."""
    return order_fee_flags(catalog, params).filter(F.col("is_fee_incentivised") == 1).select("code")


def restaurant_sessions(catalog: Catalog, params: Params) -> DataFrame:
    """Sessions of the window, in local time, that saw restaurants for delivery.

    Everything downstream counts distinct sessions, so the vertical table only has to
    confirm a session: a semi join, which cannot multiply rows.
    """
    s, v = catalog["sessions"], catalog["session_verticals"]
    hours = params.utc_offset_hours
    sessions = s.filter(
        (s.entity == params.entity)
        & local_day_between(s.session_start_timestamp_utc, hours, params.lookback_start, params.last_day)
        & lookback(s.partition_date, params)
        & s.lg_zone_name.isNotNull()
    )
    verticals = v.filter(
        (v.entity == params.entity)
        & lookback(v.partition_date, params)
        & (v.expedition_type == params.delivery)
        & v.has_restaurants_impression
    )
    local = to_local(F.col("session_start_timestamp_utc"), hours)
    return semi_in(sessions, "ga_session_id", verticals, "ga_session_id").select(
        F.to_date(local).alias("date_"),
        F.hour(local).alias("hour_"),
        local.alias("local_ts"),
        "ga_session_id",
        "lg_zone_uuid",
        "lg_zone_name",
        F.coalesce("is_transaction", F.lit(False)).alias("is_transaction"))


def session_counts(sessions: DataFrame, label: str) -> DataFrame:
    """Distinct sessions, and those with a transaction, per date, hour, zone and label."""
    keys = ["date_", "hour_", "lg_zone_name", label]
    per_session = sessions.groupBy(*keys, "ga_session_id").agg(F.max("is_transaction").alias("_bought"))
    return per_session.groupBy(*keys).agg(
        F.count_if(F.col("_bought") & F.col("ga_session_id").isNotNull()).alias("total_transaction"),
        F.count("ga_session_id").alias("total_session"))


def restaurant_profit(catalog: Catalog, params: Params) -> DataFrame:
    """Profit rows of restaurant orders in the window."""
    p = catalog["order_profit"]
    return p.filter((p.vendor_business_type == params.restaurant_type) & lookback(p.date_local, params)).select(
        "date_local", F.hour("expected_delivery_at_local").alias("hour_"), "expected_delivery_at_local",
        "zone_name", "order_code", "gpo_excl_wastage", "ad_rev_per_order", "sub_rev_per_order", "surge_event")


def full_fee_profit(catalog: Catalog, params: Params) -> DataFrame:
    """Those of them whose delivery fee was not cut."""
    return not_in(restaurant_profit(catalog, params), "order_code", fee_incentivised_codes(catalog, params), "code")
