"""Conversion and profit per date, hour, zone and delivery-area shrink level."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions.clock import at, lookback, minute_of, shift
from courierlens.functions.measures import total, without_ads
from courierlens.functions.rules import any_like, classify_like
from courierlens.operators.intervals import attribute_minute, coverage_segments
from courierlens.operators.joins import stats_join
from courierlens.operators.spines import minute_spine
from courierlens.params import Params
from courierlens.plans.conversion import Facts, full_fee_profit, restaurant_profit, restaurant_sessions, session_counts
from courierlens.plans.dimensions import all_zones
from courierlens.sources.catalog import Catalog


def area_events(catalog: Catalog, params: Params) -> DataFrame:
    """Automatic delivery-area events of the window with their zone name (NULL if unknown)."""
    e = catalog["area_events"]
    events = e.filter(
        lookback(e.created_date_utc, params)
        & (e.entity == params.entity)
        & (e.activation_type == params.area_activation)
        & e.is_active
        & e.is_shape_in_sync
    ).select("uuid", "lg_zone_uuid", "activation_threshold", "deactivation_threshold", "title",
             "start_at_local", "end_at_local")
    return events.join(all_zones(catalog, params).select("zone_name", "lg_zone_uuid"), "lg_zone_uuid", "left")


def shrink_spans(catalog: Catalog, params: Params) -> DataFrame:
    """Shrink and close events with the first and last whole minute they were in force."""
    events = area_events(catalog, params).filter(any_like(F.col("title"), params.area_title_patterns))
    return events.withColumns({
        "first_minute": minute_of(shift(F.col("start_at_local"), minutes=1)),
        "last_minute": minute_of(shift(F.col("end_at_local"), minutes=-1)),
        "shrink_event": classify_like(F.col("title"), params.shrink_labels, params.no_shrink),
    })


def shrink_minutes(catalog: Catalog, params: Params) -> DataFrame:
    """The spans spelled out, one row per event and minute (one with NULL if it has none).

    Kept for callers that want the rows; the results below work on spans.
    """
    return minute_spine(shrink_spans(catalog, params), F.col("first_minute"), F.col("last_minute"),
                        "minute", keep_empty=True).drop("first_minute", "last_minute", "shrink_event")


def shrink_sessions(catalog: Catalog, params: Params, spans: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Sessions labelled by the events of their zone id at their start minute.

    All sessions start within the window, so spans are clipped to it before they are cut by day.
    """
    spans = shrink_spans(catalog, params) if spans is None else spans
    window = at(datetime.combine(params.last_day, time(23, 59)))
    bounded = spans.filter(F.col("first_minute").isNotNull() & F.col("last_minute").isNotNull()).withColumns({
        "first_minute": F.greatest("first_minute", at(params.lookback_start)), "last_minute": F.least("last_minute", window)})
    segments = coverage_segments(bounded, ["lg_zone_uuid", "shrink_event"], "first_minute", "last_minute")
    sessions = restaurant_sessions(catalog, params) if sessions is None else sessions
    labelled = attribute_minute(sessions, segments,
                                {"lg_zone_uuid": "lg_zone_uuid"}, F.col("local_ts"),
                                "first_minute", "last_minute", ["shrink_event"])
    return labelled.withColumn("shrink_event", F.coalesce("shrink_event", F.lit(params.no_shrink)))


def order_segments(spans: DataFrame, profit: DataFrame) -> DataFrame:
    """How many events of each label are in force, on the days on which a zone's orders are delivered.

    An order may be delivered on another day than the one it is booked on, so the days are read
    off the orders, whichever they are; an event that is open for centuries has segments on those alone.
    """
    days = profit.select("zone_name", F.to_date("expected_delivery_at_local").alias("day")).distinct()
    named = spans.filter(F.col("zone_name").isNotNull()).withColumnRenamed("zone_name", "event_zone")
    return coverage_segments(named, ["event_zone", "shrink_event"], "first_minute", "last_minute",
                             days=days, on={"event_zone": "zone_name"})


def shrink_orders(catalog: Catalog, params: Params, spans: DataFrame | None = None, facts: Facts | None = None) -> DataFrame:
    """Orders and profit labelled by the events of their zone name at their delivery minute.

    ``covering`` is the number of events of one label in force: an order is summed once
    per event, and counted once.
    """
    spans = shrink_spans(catalog, params) if spans is None else spans
    booked = restaurant_profit(catalog, params) if facts is None else facts.profit
    profit = (full_fee_profit(catalog, params) if facts is None else facts.full_fee).drop("surge_event")
    segments = order_segments(spans, booked)
    labelled = attribute_minute(profit, segments,
                                {"zone_name": "event_zone"}, F.col("expected_delivery_at_local"),
                                "first_minute", "last_minute", ["shrink_event", "covering"])
    copies = F.coalesce("covering", F.lit(1))
    net = without_ads(F.col("gpo_excl_wastage"), F.col("ad_rev_per_order"), F.col("sub_rev_per_order"))
    return (labelled.withColumn("shrink_event", F.coalesce("shrink_event", F.lit(params.no_shrink)))
            .groupBy("date_local", "hour_", "zone_name", "shrink_event")
            .agg(F.count_distinct("order_code").alias("total_orders"),
                 total(F.coalesce(F.col("gpo_excl_wastage") * copies, F.lit(0.0)), params).alias("total_gp"),
                 total(net * copies, params).alias("total_gp_wo_ad")))


def daily_conversion_by_shrink(catalog: Catalog, params: Params, facts: Facts | None = None) -> DataFrame:
    """The window's result, from ``facts`` if they are given (see ``rolling.py``)."""
    keys = ["date_", "hour_", "lg_zone_name", "shrink_event"]
    spans = shrink_spans(catalog, params)
    orders = shrink_orders(catalog, params, spans, facts).withColumnsRenamed(
        {"date_local": "date_", "zone_name": "lg_zone_name"})
    sessions = session_counts(shrink_sessions(catalog, params, spans, facts and facts.sessions), "shrink_event")
    joined = stats_join(sessions, orders, keys)
    closed = F.col("shrink_event") == params.closed
    return joined.select(
        *keys, "total_transaction", "total_session",
        F.when(closed, 0).otherwise(F.coalesce("total_orders", F.lit(0))).alias("total_orders"),
        F.coalesce("total_gp", F.lit(0.0)).alias("total_gp"),
        F.coalesce("total_gp_wo_ad", F.lit(0.0)).alias("total_gp_wo_ad"),
    ).orderBy(*keys)
