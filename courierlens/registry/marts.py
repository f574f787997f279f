"""The eight results and every intermediate relation they are made of."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens import plans
from courierlens.functions.measures import sum_or_zero, without_ads
from courierlens.operators.bitmaps import distinct_counts
from courierlens.operators.dyadic import attribute_cells
from courierlens.operators.intervals import coverage_segments, validity_intervals
from courierlens.operators.joins import band_join, spread_band_join
from courierlens.operators.spines import densify, minute_spine
from courierlens.params import Params
from courierlens.plans import active_vendors, conversion, dimensions
from courierlens.plans import offline_hours, order_economics, restaurant_funnel, shrink_conversion, surge_conversion
from courierlens.plans import vendor_lateness
from courierlens.registry.entries import Entry
from courierlens.registry.layouts import fee_flags_co_located, refused_orders, refused_sql, restaurant_sessions_co_located
from courierlens.registry.refreshes import shrink_refreshed, surge_refreshed
from courierlens.registry.relations import GROUP_KEYS
from courierlens.sources.catalog import Catalog
from courierlens.sources.sample import COMMERCE, CONTRACTS, TRAFFIC

PROFIT = ("total_gp", "total_gp_wo_ad")
HOURS = ("total_open_hour", "total_unavailable_hour")
ECONOMICS = (
    "total_gp", "total_order_value", "gmv_local", "vendor_discount", "platform_discount", "vendor_voucher",
    "platform_voucher", "avg_min_order_value", "avg_delivery_fee", "vendor_discount_prop",
    "platform_discount_prop", "platform_vendor_discount_ratio", "vendor_voucher_prop", "platform_voucher_prop",
    "platform_vendor_voucher_ratio",
)
ORDER_ROW = ["date_local", "hour", "uuid", "code", "vendor_business_type", "minimum_delivery_value_local",
             "total_value_local", "vendor_discount", "platform_discount", "vendor_voucher", "platform_voucher",
             "fee_before_tax", "voucher_waiver", "discount_waiver", "is_incentivised", "is_low_fee",
             "is_incentivised_or_low_fee", "is_incentivised_and_low_fee", "net_delivery_fee"]
STEP_COLUMNS = ", ".join(restaurant_funnel.STEP_PAIRS)
SESSION_ROW = ["date_", "hour_", "ga_session_id", "lg_zone_name", "is_transaction"]


def _traffic(build, select, doubles=()):
    return Entry(build, TRAFFIC, "traffic", select, doubles)


def _commerce(build, select, doubles=()):
    return Entry(build, COMMERCE, "commerce", select, doubles)


def _contracts(build, select, doubles=()):
    return Entry(build, CONTRACTS, "commerce", select, doubles)


def order_rows_net_fee(c: Catalog, p: Params) -> DataFrame:
    return order_economics.order_rows(c, p).select(*ORDER_ROW)


def shrink_event_minutes(c: Catalog, p: Params) -> DataFrame:
    return shrink_conversion.shrink_minutes(c, p).select("uuid", "zone_name", "title", "minute")


def shrink_coverage(c: Catalog, p: Params) -> DataFrame:
    segments = coverage_segments(shrink_conversion.shrink_spans(c, p), ["lg_zone_uuid", "shrink_event"],
                                 "first_minute", "last_minute")
    return minute_spine(segments, F.col("first_minute"), F.col("last_minute")).select(
        "lg_zone_uuid", "shrink_event", "day", "minute", "covering")


def shrink_labelled_sessions(c: Catalog, p: Params) -> DataFrame:
    return shrink_conversion.shrink_sessions(c, p).select(*SESSION_ROW, "shrink_event").distinct()


def shrink_sessions_by_cells(c: Catalog, p: Params) -> DataFrame:
    """The same labels from raw spans, looked up by dyadic cells."""
    labelled = attribute_cells(conversion.restaurant_sessions(c, p), shrink_conversion.shrink_spans(c, p), {"lg_zone_uuid": "lg_zone_uuid"},
                               F.col("local_ts"), "first_minute", "last_minute", ["shrink_event"], covering="covering")
    return labelled.withColumn("shrink_event", F.coalesce("shrink_event", F.lit(p.no_shrink))).select(*SESSION_ROW, "shrink_event").distinct()


def shrink_profit_by_cells(c: Catalog, p: Params) -> DataFrame:
    """Orders and profit per label, an order once per event that holds its minute, looked up by dyadic cells."""
    spans = shrink_conversion.shrink_spans(c, p).withColumnRenamed("zone_name", "event_zone")
    labelled = attribute_cells(conversion.full_fee_profit(c, p), spans, {"zone_name": "event_zone"},
                               F.col("expected_delivery_at_local"), "first_minute", "last_minute", ["shrink_event"], covering="covering")
    copies = F.coalesce("covering", F.lit(1))
    net = without_ads(F.col("gpo_excl_wastage"), F.col("ad_rev_per_order"), F.col("sub_rev_per_order"))
    return (labelled.withColumn("shrink_event", F.coalesce("shrink_event", F.lit(p.no_shrink)))
            .groupBy("date_local", "hour_", "zone_name", "shrink_event")
            .agg(F.count_distinct("order_code").alias("total_orders"), sum_or_zero(F.col("gpo_excl_wastage") * copies).alias("total_gp"),
                 F.sum(net * copies).alias("total_gp_wo_ad")))


def shrink_session_counts(c: Catalog, p: Params) -> DataFrame:
    return conversion.session_counts(shrink_conversion.shrink_sessions(c, p), "shrink_event")


def zone_delays(c: Catalog, p: Params) -> DataFrame:
    return surge_conversion.delay_observations(c, p).distinct()


def zone_limits(c: Catalog, p: Params) -> DataFrame:
    return surge_conversion.zone_limits(surge_conversion.delay_observations(c, p))


def zone_minute_spine(c: Catalog, p: Params) -> DataFrame:
    return densify(surge_conversion.delay_observations(c, p), "zone_name", "minute")


def filled_delays(c: Catalog, p: Params) -> DataFrame:
    return surge_conversion.filled_delays(surge_conversion.delay_observations(c, p))


def delay_validity(c: Catalog, p: Params) -> DataFrame:
    """Validity intervals, laid out by minute again."""
    known = (surge_conversion.delay_observations(c, p).groupBy("zone_name", "minute")
             .agg(F.max("mean_delay").alias("mean_delay")))
    pieces = validity_intervals(known, "zone_name", "minute", "mean_delay")
    return minute_spine(pieces, F.col("start_minute"), F.col("end_minute")).select("zone_name", "day", "minute", "mean_delay")


def delay_bands(c: Catalog, p: Params) -> DataFrame:
    known = (surge_conversion.delay_observations(c, p).withColumn("day", F.to_date("minute"))
             .groupBy("zone_name", "day", "minute").agg(F.max("mean_delay").alias("mean_delay")))
    return band_join(known, surge_conversion.surge_bands(c, p), {"zone_name": "zone_name", "day": "date_updated"},
                     "mean_delay", "mean_delay_start", "mean_delay_end", ["surge_event", "surge_fee"])


def delay_bands_by_buckets(c: Catalog, p: Params) -> DataFrame:
    """The same rows with a bucket for every two bands."""
    known = (surge_conversion.delay_observations(c, p).withColumn("day", F.to_date("minute"))
             .groupBy("zone_name", "day", "minute").agg(F.max("mean_delay").alias("mean_delay")))
    return spread_band_join(known, surge_conversion.surge_bands(c, p), {"zone_name": "zone_name", "day": "date_updated"},
                            "mean_delay", "mean_delay_start", "mean_delay_end", ["surge_event", "surge_fee"], per_bucket=2)


def sessions_by_grain(c: Catalog, p: Params) -> DataFrame:
    """Distinct sessions and buying sessions per hour, day and zone and in all, from one shuffle of the events."""
    events = restaurant_funnel.browsing_events(c, p).unionByName(restaurant_funnel.transaction_events(c, p))
    return distinct_counts(events, "ga_session_id", [["zone_name", "date_local", "hour_"], ["zone_name", "date_local"], ["zone_name"], []],
                           {"sessions": F.lit(True), "buyers": F.col("event_action") == p.transaction})


def surge_segment_labels(c: Catalog, p: Params) -> DataFrame:
    """Labels from validity segments, laid out by minute again."""
    minutes = minute_spine(surge_conversion.surge_segments(c, p), F.col("start_minute"), F.col("end_minute"))
    return minutes.select("zone_name", "day", "minute", "surge_event").distinct()


def surge_labelled_sessions(c: Catalog, p: Params) -> DataFrame:
    return surge_conversion.surge_sessions(c, p).select(*SESSION_ROW, "surge_event").distinct()


def surge_session_counts(c: Catalog, p: Params) -> DataFrame:
    return conversion.session_counts(surge_conversion.surge_sessions(c, p), "surge_event")


def order_fee_flags(c: Catalog, p: Params) -> DataFrame:
    return conversion.order_fee_flags(c, p).select("uuid", "code", "is_low_fee", "is_fee_incentivised")


def session_steps(c: Catalog, p: Params) -> DataFrame:
    flags = restaurant_funnel.flagged_sessions(restaurant_funnel.ordered_events(c, p), p)
    return flags.select(*restaurant_funnel.KEYS, "ga_session_id", "home", "list", "details", "checkout", "transaction")


def platform_steps(c: Catalog, p: Params) -> DataFrame:
    return restaurant_funnel.funnel_counts(c, p).select(
        *restaurant_funnel.KEYS, *restaurant_funnel.STEP_PAIRS, "cvr_denominator", "cvr_numerator")


def _vertical(name: str):
    def build(c: Catalog, p: Params) -> DataFrame:
        return restaurant_funnel.layout(restaurant_funnel.funnel_counts(c, p)).filter(F.col("vertical") == name)
    return build


def _of_counts(part):
    return lambda c, p: part(restaurant_funnel.funnel_counts(c, p))


def _moved(build, select, doubles=(), **changed):
    """The same with another window or other floors, so that rows lie outside of them."""
    return Entry(build, replace(TRAFFIC, **changed), "traffic", select, doubles)


RESULTS: dict[str, Entry] = {
    "daily_orders": _commerce(plans.daily_orders, "order_economics", ECONOMICS),
    "daily_rainfall": _traffic(
        plans.daily_rainfall,
        "SELECT zone AS zone_name, CAST(ts AS DATE) AS date_local, CAST(hour(ts) AS INTEGER) AS hour_, "
        "sum(rainfall_mm) AS total_rainfall FROM rain GROUP BY 1, 2, 3", ("total_rainfall",)),
    "daily_offline_hours": _commerce(plans.daily_offline_hours, "offline_hours", HOURS),
    "daily_vendor_lateness": _commerce(plans.daily_vendor_lateness, "lateness", ("total_vendor_lateness",)),
    "daily_active_vendors": _contracts(plans.daily_active_vendors, "active"),
    "daily_conversion_by_shrink": _traffic(plans.daily_conversion_by_shrink, "shrink_result", PROFIT),
    "daily_conversion_by_surge": _traffic(plans.daily_conversion_by_surge, "surge_result", PROFIT),
    "daily_restaurant_conversion_funnel": _traffic(plans.daily_restaurant_conversion_funnel, "funnel_rows"),
}

#: All events are of January 2024. A window that starts in the middle of it folds history in, one that
#: ends there leaves later rows out, and later floors cut the sources.
LATE, EARLY = date(2024, 3, 21), date(2024, 1, 21)
WINDOWS: dict[str, Entry] = {
    "conversion_by_shrink_late_window": _moved(plans.daily_conversion_by_shrink, "shrink_result", PROFIT, as_of=LATE),
    "conversion_by_shrink_early_window": _moved(plans.daily_conversion_by_shrink, "shrink_result", PROFIT, as_of=EARLY),
    "conversion_by_surge_late_window": _moved(plans.daily_conversion_by_surge, "surge_result", PROFIT, as_of=LATE),
    "conversion_by_surge_early_window": _moved(plans.daily_conversion_by_surge, "surge_result", PROFIT, as_of=EARLY),
    "conversion_by_surge_late_floors": _moved(
        plans.daily_conversion_by_surge, "surge_result", PROFIT, as_of=LATE, zone_stats_from=date(2024, 1, 25),
        surge_bands_from=date(2024, 1, 24)),
    "daily_orders_exact_sums": Entry(plans.daily_orders, replace(COMMERCE, exact_sums=True), "commerce", "order_economics", ECONOMICS),
    "conversion_by_shrink_exact_sums": _moved(plans.daily_conversion_by_shrink, "shrink_result", PROFIT, exact_sums=True),
    "conversion_by_surge_exact_sums": _moved(plans.daily_conversion_by_surge, "surge_result", PROFIT, exact_sums=True),
    "conversion_by_shrink_refreshed": _traffic(shrink_refreshed, "shrink_result", PROFIT),
    "conversion_by_surge_refreshed": _traffic(surge_refreshed, "surge_result", PROFIT),
    "conversion_by_surge_refreshed_late_window": _moved(surge_refreshed, "surge_result", PROFIT, as_of=LATE),
    "restaurant_funnel_late_floor": _moved(
        plans.daily_restaurant_conversion_funnel, "funnel_rows", history_from=date(2024, 1, 12)),
}

FEE_FLAGS = (
    "SELECT uuid, code, CAST(max(CAST(low_and_funded AS INTEGER)) AS INTEGER) AS is_low_fee, "
    "CAST(max(CAST(low_and_funded OR discount_free OR voucher_free AS INTEGER)) AS INTEGER) "
    "AS is_fee_incentivised FROM cut_pairs GROUP BY uuid, code")
IN_BAND = ("SELECT k.zone_name, CAST(k.minute AS DATE) AS day, k.minute, k.mean_delay, b.surge_event, "
           "b.surge_fee FROM known_delays k LEFT JOIN bands b ON b.zone_name = k.zone_name "
           "AND b.date_updated = CAST(k.minute AS DATE) AND k.mean_delay BETWEEN b.mean_delay_start AND b.mean_delay_end")

INTERMEDIATE: dict[str, Entry] = {
    "vendor_list": _commerce(dimensions.vendor_list, "listed_vendors"),
    "vendor_zone_bridge": _commerce(dimensions.vendor_zones, "zone_bridge"),
    "zone_list": _traffic(dimensions.all_zones, "zone_dim"),
    "order_rows_net_fee": _commerce(
        order_rows_net_fee, f"SELECT {', '.join(ORDER_ROW)} FROM order_net",
        ("vendor_discount", "platform_discount", "vendor_voucher", "platform_voucher", "fee_before_tax",
         "voucher_waiver", "discount_waiver", "net_delivery_fee")),
    "availability_slots": _commerce(offline_hours.availability_slots, "open_slots"),
    "vendor_hours": _commerce(offline_hours.vendor_hours, "slot_hours", HOURS),
    "lateness_rows": _commerce(vendor_lateness.lateness_rows, "late_orders", ("vendor_lateness_in_min",)),
    "contract_spans": _contracts(active_vendors.contract_spans, "spans"),
    "contract_days_expanded": _contracts(
        active_vendors.vendor_days, "SELECT s.*, k.day AS date_local, coalesce(k.day >= s.start_date_local "
        "AND k.day <= s.end_date_local, false) AS is_active FROM spans s, calendar k"),
    "area_events_with_zone": _traffic(shrink_conversion.area_events, "zone_events"),
    "shrink_event_minutes": _traffic(shrink_event_minutes, "SELECT uuid, zone_name, title, minute FROM event_minutes"),
    "shrink_coverage": _traffic(
        shrink_coverage, "SELECT lg_zone_uuid, shrink_event, CAST(minute AS DATE) AS day, minute, count(*) AS covering "
        "FROM event_minutes WHERE minute IS NOT NULL GROUP BY lg_zone_uuid, shrink_event, minute"),
    "order_fee_flags": _traffic(order_fee_flags, FEE_FLAGS),
    "order_fee_flags_co_located": _traffic(fee_flags_co_located, FEE_FLAGS),
    "restaurant_sessions_co_located": _traffic(
        lambda c, p: restaurant_sessions_co_located(c, p).select("ga_session_id", "lg_zone_uuid", "lg_zone_name", "is_transaction", "local_ts").distinct(),
        "SELECT DISTINCT ga_session_id, lg_zone_uuid, lg_zone_name, is_transaction, local_ts FROM seen"),
    "order_conditions_refused": _commerce(refused_orders, refused_sql(COMMERCE)),
    "fee_incentivised_codes": _traffic(
        lambda c, p: conversion.fee_incentivised_codes(c, p).distinct(), "SELECT DISTINCT code FROM cut_codes"),
    "shrink_labelled_sessions": _traffic(
        shrink_labelled_sessions, f"SELECT DISTINCT {', '.join(SESSION_ROW)}, shrink_event FROM shrink_seen"),
    "shrink_sessions_by_cells": _traffic(
        shrink_sessions_by_cells, f"SELECT DISTINCT {', '.join(SESSION_ROW)}, shrink_event FROM shrink_seen"),
    "shrink_profit_by_cells": _traffic(shrink_profit_by_cells, "shrink_order_sums", PROFIT),
    "shrink_session_counts": _traffic(shrink_session_counts, "shrink_session_counts"),
    "shrink_order_profit": _traffic(shrink_conversion.shrink_orders, "shrink_order_sums", PROFIT),
    "zone_delays": _traffic(zone_delays, "SELECT DISTINCT * FROM delays", ("mean_delay",)),
    "zone_delay_limits": _traffic(zone_limits, "delay_limits"),
    "zone_minute_spine": _traffic(zone_minute_spine, "SELECT zone_name, minute FROM minute_axis"),
    "filled_delays": _traffic(filled_delays, "SELECT * FROM filled", ("mean_delay",)),
    "delay_validity": _traffic(
        delay_validity, "SELECT zone_name, created_date_local AS day, minute, mean_delay FROM filled "
        "WHERE mean_delay IS NOT NULL", ("mean_delay",)),
    "surge_bands": _traffic(surge_conversion.surge_bands, "SELECT * FROM bands"),
    "cheapest_surge_labels": _traffic(
        lambda c, p: surge_conversion.cheapest_labels(surge_conversion.surge_bands(c, p)), "cheapest"),
    "dearest_surge_labels": _traffic(
        lambda c, p: surge_conversion.dearest_labels(surge_conversion.surge_bands(c, p)), "dearest"),
    "delay_band_join": _traffic(delay_bands, IN_BAND, ("mean_delay", "surge_fee")),
    "delay_band_join_by_buckets": _traffic(delay_bands_by_buckets, IN_BAND, ("mean_delay", "surge_fee")),
    "surge_minute_labels": _traffic(surge_conversion.surge_minutes, "SELECT * FROM minute_labels", ("mean_delay",)),
    "surge_segment_labels": _traffic(
        surge_segment_labels, "SELECT DISTINCT zone_name, created_date_local AS day, minute, surge_event FROM minute_labels "
        f"WHERE mean_delay IS NOT NULL AND created_date_local < DATE '{TRAFFIC.as_of}' AND created_date_local >= "
        f"DATE '{TRAFFIC.as_of}' - INTERVAL 1 DAY - INTERVAL {TRAFFIC.lookback_months} MONTH"),
    "surge_labelled_sessions": _traffic(
        surge_labelled_sessions, f"SELECT DISTINCT {', '.join(SESSION_ROW)}, surge_event FROM surge_seen"),
    "surge_session_counts": _traffic(surge_session_counts, "surge_session_counts"),
    "surge_order_profit": _traffic(surge_conversion.surge_orders, "surge_order_sums", PROFIT),
    "web_events_deduplicated": _traffic(restaurant_funnel.web_events, "dedup_events"),
    "valid_orders": _traffic(restaurant_funnel.valid_orders, "good_orders"),
    "sessions_by_grain": _traffic(
        sessions_by_grain, """SELECT CASE WHEN grouping(zone_name) = 1 THEN '' WHEN grouping(date_local) = 1 THEN 'zone_name'
            WHEN grouping(hour_) = 1 THEN 'zone_name,date_local' ELSE 'zone_name,date_local,hour_' END AS grain, zone_name, date_local, hour_,
       count(DISTINCT ga_session_id) AS sessions, count(DISTINCT ga_session_id) FILTER (event_action = 'transaction') AS buyers
FROM dedup_events WHERE ga_session_id IS NOT NULL
GROUP BY GROUPING SETS ((zone_name, date_local, hour_), (zone_name, date_local), (zone_name), ())"""),
    "session_step_flags": _traffic(
        session_steps, f"""SELECT {GROUP_KEYS}, ga_session_id,
       coalesce(bool_or(event_action = 'home_screen.loaded'), false) AS home,
       coalesce(bool_or(event_action IN ('shop_list.loaded', 'shop_list.updated')), false) AS list,
       coalesce(bool_or(event_action = 'shop_details.loaded'), false) AS details,
       coalesce(bool_or(event_action = 'checkout.loaded'), false) AS checkout,
       coalesce(bool_or(event_action = 'transaction'), false) AS transaction
FROM dedup_events GROUP BY {GROUP_KEYS}, ga_session_id"""),
    "restaurant_session_counts": _traffic(
        _of_counts(restaurant_funnel.restaurant_session_counts), "resto_session_counts"),
    "restaurant_step_counts": _traffic(
        _of_counts(restaurant_funnel.restaurant_step_counts), f"SELECT {GROUP_KEYS}, {STEP_COLUMNS} FROM resto_steps"),
    "restaurant_conversion": _traffic(_vertical("restaurants"), "resto_rows"),
    "platform_orders": _traffic(_of_counts(restaurant_funnel.platform_orders), "platform_order_counts"),
    "platform_step_counts": _traffic(
        platform_steps, f"SELECT {GROUP_KEYS}, {STEP_COLUMNS}, sessions AS cvr_denominator, "
        "buyers AS cvr_numerator FROM platform_steps"),
    "platform_conversion": _traffic(_vertical("platform"), "platform_rows"),
}
