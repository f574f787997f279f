"""Order economics per zone, date and hour: counts, profit, subsidies, ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions.accounts import Account, keep
from courierlens.functions.clock import on_or_after
from courierlens.functions.measures import ratio, total
from courierlens.functions.rules import any_positive, flag, floor_zero, subsidy_split
from courierlens.params import Params
from courierlens.sources.catalog import Catalog


def eligible_orders(catalog: Catalog, params: Params, account: Account | None = None) -> DataFrame:
    """Valid delivered orders with their vendor type; an unknown vendor drops the order."""
    o, t = catalog["shop_orders"], catalog["vendor_types"]
    orders = keep(o, "shop_orders", {
        "tenant": o.entity == params.entity,
        "delivered since": on_or_after(o.expected_delivery_at_local, params.economics_from),
        "created before": o.created_date_utc < F.lit(params.as_of),
        "no test": ~o.is_test_order,
        "valid": o.is_valid_order,
        "by delivery": o.expedition_type == params.delivery,
        "other minimum": o.minimum_delivery_value_local != params.wide_area_minimum,
    }, account).select("uuid", "code", "vendor_code", "expected_delivery_at_local", "minimum_delivery_value_local",
             "total_value_local", "delivery_fee_original_local", "delivery_fee_vat_rate")
    types = keep(t, "vendor_types", {"tenant": t.entity == params.entity, "other store": t.business_type_apac != params.excluded_store_type},
                 account).select("vendor_code", "business_type_apac", "is_kitchens")
    expected, fee = F.col("expected_delivery_at_local"), F.col("delivery_fee_original_local")
    kind, kitchens = F.col("business_type_apac"), F.col("is_kitchens")
    return orders.join(types, "vendor_code").select(
        F.to_date(expected).alias("date_local"),
        F.hour(expected).alias("hour"),
        "uuid",
        "code",
        F.when(kitchens, "k&c").otherwise(kind).alias("vendor_business_type"),
        ((kind != params.quick_store_type) & ~kitchens).alias("partner"),
        "minimum_delivery_value_local",
        "total_value_local",
        fee.alias("delivery_fee_original_local"),
        (fee / (F.col("delivery_fee_vat_rate") / 100 + 1)).alias("fee_before_tax"),
        flag(fee.isin(*params.low_fees)).alias("is_low_fee"))


def _subsidies(rows: DataFrame, name: str, kind: str, amount: str, params: Params, account: Account | None) -> DataFrame:
    vendor, platform = subsidy_split(F.col(amount), F.col("platform_share_pct"))
    conditions = {"tenant": rows.entity == params.entity, "created before": rows.created_date_utc < F.lit(params.as_of)}
    split = keep(rows, f"order_{name}s", conditions, account).select(
        "uuid", F.col(kind).alias("_kind"), vendor.alias(f"vendor_{name}"), platform.alias(f"platform_{name}"))
    free = F.col("_kind") == params.free_delivery
    paid = any_positive(F.col(f"vendor_{name}"), F.col(f"platform_{name}"))
    return split.select(
        "uuid", f"vendor_{name}", f"platform_{name}",
        F.when(free, F.abs(F.col(f"platform_{name}"))).otherwise(F.lit(0.0)).alias(f"{name}_free"),
        flag(paid).alias(f"{name}_paid"))


def voucher_rows(catalog: Catalog, params: Params, account: Account | None = None) -> DataFrame:
    """Vouchers split by payer: both parts, the free-delivery amount, whether anything was paid."""
    return _subsidies(catalog["order_vouchers"], "voucher", "type", "value_local", params, account)


def discount_rows(catalog: Catalog, params: Params, account: Account | None = None) -> DataFrame:
    """The same of discounts."""
    return _subsidies(catalog["order_discounts"], "discount", "discount_type", "discount_amount_local", params, account)


def with_net_fee(rows: DataFrame) -> DataFrame:
    """Adds the waivers of partner vendors and the fee before tax less both, never negative."""
    rows = rows.withColumns({
        f"{name}_waiver": F.when(F.col("partner"), F.col(f"{name}_free")).otherwise(F.lit(0.0))
        for name in ("voucher", "discount")
    })
    net = F.col("fee_before_tax") - F.col("voucher_waiver") - F.col("discount_waiver")
    return rows.withColumn("net_delivery_fee", floor_zero(net, 2))


def order_rows(catalog: Catalog, params: Params) -> DataFrame:
    """One row per order, voucher row and discount row, with flags and net fee.

    An order needs a voucher row and a discount row to appear (the creation-date filters
    reject the unmatched ones), so all joins are inner. Kept for callers that want the
    rows; the result below does not form the pairings.
    """
    rows = (eligible_orders(catalog, params).join(voucher_rows(catalog, params), "uuid")
            .join(discount_rows(catalog, params), "uuid"))
    paid = (F.col("voucher_paid") == 1) | (F.col("discount_paid") == 1)
    low = F.col("is_low_fee") == 1
    return with_net_fee(rows).withColumns({
        "is_incentivised": flag(paid),
        "is_incentivised_or_low_fee": flag(paid | low),
        "is_incentivised_and_low_fee": flag(paid & low),
    })


def _per_order(rows: DataFrame, name: str, params: Params) -> DataFrame:
    """Subsidy rows of an order that waive the same amount, as one row with their count."""
    return rows.groupBy("uuid", f"{name}_free").agg(
        F.count(F.lit(1)).alias(f"{name}_rows"),
        F.sum(f"{name}_paid").alias(f"{name}_paid"),
        total(F.col(f"vendor_{name}"), params).alias(f"vendor_{name}"),
        total(F.col(f"platform_{name}"), params).alias(f"platform_{name}"))


def order_totals(catalog: Catalog, params: Params, account: Account | None = None) -> DataFrame:
    """Sums over all pairings of an order's voucher and discount rows, per code, date and hour.

    Only the net fee depends on a pairing, and only through the two waived amounts. So
    either side is reduced to one row per order and amount before the joins, and sums over
    pairings follow from the counts: a side's sum times the rows of the other side, and
    for "paid by either" all pairings less those paid by neither.
    """
    pairs = with_net_fee(
        eligible_orders(catalog, params, account).filter(F.col("code").isNotNull())
        .join(_per_order(voucher_rows(catalog, params, account), "voucher", params), "uuid")
        .join(_per_order(discount_rows(catalog, params, account), "discount", params), "uuid"))
    vouchers, discounts = F.col("voucher_rows"), F.col("discount_rows")
    copies = vouchers * discounts
    paid = copies - (vouchers - F.col("voucher_paid")) * (discounts - F.col("discount_paid"))
    low = F.col("is_low_fee")
    return pairs.groupBy("code", "date_local", "hour").agg(
        F.sum(copies).alias("copies"),
        F.sum(paid).alias("paid"),
        F.sum(low * copies).alias("low"),
        F.sum(F.when(low == 1, copies).otherwise(paid)).alias("paid_or_low"),
        F.sum(low * paid).alias("paid_and_low"),
        total(F.col("total_value_local") * copies, params).alias("total_value"),
        total(F.col("minimum_delivery_value_local") * copies, params).alias("minimum_value"),
        # Net fees have two decimals, so they are added exactly, whatever the row order.
        F.sum(F.col("net_delivery_fee").cast("decimal(18,2)") * copies).alias("net_fee"),
        total(F.col("vendor_discount") * vouchers, params).alias("vendor_discount"),
        total(F.col("platform_discount") * vouchers, params).alias("platform_discount"),
        total(F.col("vendor_voucher") * discounts, params).alias("vendor_voucher"),
        total(F.col("platform_voucher") * discounts, params).alias("platform_voucher"))


def daily_orders(catalog: Catalog, params: Params, account: Account | None = None) -> DataFrame:
    """Both sides of the profit join are reduced to one row per code and group first.

    Each code then meets a zone, date and hour once, so counting rows counts distinct
    orders; sums of one side are weighted with the row count of the other.
    """
    p = catalog["order_profit"]
    restaurants = keep(p, "order_profit", {"restaurant": p.vendor_business_type == params.restaurant_type}, account)
    profit = restaurants.groupBy("order_code", "zone_name").agg(
        F.count(F.lit(1)).alias("profit_rows"), total(F.col("gpo_excl_wastage"), params).alias("gp"), total(F.col("gmv_local"), params).alias("gmv"))
    joined = order_totals(catalog, params, account).join(profit, F.col("code") == F.col("order_code"))

    exact = {"net_fee", "paid", "low", "paid_or_low", "paid_and_low"}  # whole numbers and decimals

    def of_orders(name: str):
        weighted = F.col(name) * F.col("profit_rows")
        return F.sum(weighted) if name in exact else total(weighted, params)

    def of_profit(name: str):
        return total(F.col(name) * F.col("copies"), params)

    orders, gmv = F.count("order_code"), of_profit("gmv")
    return joined.groupBy("zone_name", "date_local", "hour").agg(
        orders.alias("number_of_orders"),
        of_orders("paid").alias("number_of_incentive_orders"),
        of_orders("low").alias("number_of_low_fee_orders"),
        of_orders("paid_or_low").alias("number_incentivised_or_low_fee"),
        of_orders("paid_and_low").alias("number_incentivised_and_low_fee"),
        F.round(of_profit("gp"), 2).alias("total_gp"),
        F.round(of_orders("total_value"), 2).alias("total_order_value"),
        F.round(gmv, 2).alias("gmv_local"),
        of_orders("vendor_discount").alias("vendor_discount"),
        of_orders("platform_discount").alias("platform_discount"),
        of_orders("vendor_voucher").alias("vendor_voucher"),
        of_orders("platform_voucher").alias("platform_voucher"),
        ratio(of_orders("minimum_value"), orders, 2).alias("avg_min_order_value"),
        ratio(of_orders("net_fee"), orders, 2).cast("double").alias("avg_delivery_fee"),
        ratio(of_orders("vendor_discount"), gmv, 2).alias("vendor_discount_prop"),
        ratio(of_orders("platform_discount"), gmv, 2).alias("platform_discount_prop"),
        ratio(of_orders("platform_discount"), of_orders("vendor_discount")).alias("platform_vendor_discount_ratio"),
        ratio(of_orders("vendor_voucher"), gmv, 2).alias("vendor_voucher_prop"),
        ratio(of_orders("platform_voucher"), gmv, 2).alias("platform_voucher_prop"),
        ratio(of_orders("platform_voucher"), of_orders("vendor_voucher")).alias("platform_vendor_voucher_ratio"),
    ).orderBy("zone_name", "date_local", "hour")
