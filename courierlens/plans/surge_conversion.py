"""Conversion and profit per date, hour, zone and surge-fee level."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions.clock import at, clock_text, minute_of, to_local
from courierlens.functions.measures import total, without_ads
from courierlens.operators.aggregates import extreme_with_ties
from courierlens.operators.intervals import attribute_minute, validity_intervals
from courierlens.operators.joins import clamped_band_label, stats_join
from courierlens.operators.nested import explode_structs
from courierlens.operators.spines import densify, fill_forward, latest_before
from courierlens.params import Params
from courierlens.plans.conversion import Facts, full_fee_profit, restaurant_sessions, session_counts
from courierlens.plans.dimensions import all_zones
from courierlens.sources.catalog import Catalog


def delay_observations(catalog: Catalog, params: Params) -> DataFrame:
    """(zone_name, minute, mean_delay) as observed, local time, rounded; may repeat a minute."""
    s = catalog["zone_stats"]
    rows = s.filter((s.created_date_utc >= F.lit(params.zone_stats_from)) & (s.entity == params.entity))
    stats = explode_structs(rows, "stats", {"delay": "mean_delay_in_minutes"}, ["lg_zone_uuid", "created_at_utc"])
    local = to_local(F.col("created_at_utc"), params.utc_offset_hours)
    observed = stats.select("lg_zone_uuid", minute_of(local).alias("minute"),
                            F.round("delay", 2).cast("double").alias("mean_delay"))
    zones = all_zones(catalog, params).filter(F.col("zone_name").isNotNull()).select("lg_zone_uuid", "zone_name")
    return observed.join(zones, "lg_zone_uuid").select("zone_name", "minute", "mean_delay")


def zone_limits(observations: DataFrame) -> DataFrame:
    """First and last minute per zone."""
    return observations.groupBy("zone_name").agg(F.min("minute").alias("min_dt"), F.max("minute").alias("max_dt"))


def filled_delays(observations: DataFrame) -> DataFrame:
    """Every zone-minute between a zone's first and last observation, delay carried forward.

    Kept for callers that want the rows; the result below works on validity intervals.
    """
    per_minute = observations.groupBy("zone_name", "minute").agg(F.max("mean_delay").alias("mean_delay"))
    spine = densify(per_minute, "zone_name", "minute")
    filled = fill_forward(spine.join(per_minute, ["zone_name", "minute"], "left"), "zone_name", "minute", "mean_delay")
    return filled.select(F.to_date("minute").alias("created_date_local"), "zone_name", "minute",
                         clock_text(F.col("minute")).alias("time_local"), F.hour("minute").alias("hour_of_day"),
                         F.minute("minute").alias("minute_of_hour"), "mean_delay")


def surge_bands(catalog: Catalog, params: Params) -> DataFrame:
    b = catalog["surge_bands"]
    return (b.filter(b.zone_name.isNotNull() & (b.date_updated >= F.lit(params.surge_bands_from)))
            .select("date_updated", "zone_name", "mean_delay_start", "mean_delay_end", "surge_event", "surge_fee")
            .distinct())


def cheapest_labels(bands: DataFrame) -> DataFrame:
    return extreme_with_ties(bands, ["date_updated", "zone_name"], "surge_fee", "surge_event", "min", "min_fee")


def dearest_labels(bands: DataFrame) -> DataFrame:
    """Labels at the largest fee, with the largest band end of the day over all bands."""
    keys = ["date_updated", "zone_name"]
    ends = bands.groupBy(*keys).agg(F.max("mean_delay_end").alias("max_mean_delay_end"))
    labels = extreme_with_ties(bands, keys, "surge_fee", "surge_event", "max", "max_fee")
    return stats_join(labels, ends, keys)


def surge_segments(catalog: Catalog, params: Params) -> DataFrame:
    """Surge label(s) of every zone over the window, as segments within a day.

    Observations before the window fold into one row per zone, so history is read but not
    shuffled; the label lookup then runs once per observed value and day, not per minute.
    """
    first = at(params.lookback_start)
    last = at(datetime.combine(params.last_day, time(23, 59)))
    observed = latest_before(delay_observations(catalog, params), ["zone_name"], "minute", "mean_delay", first, last)
    held = validity_intervals(observed, "zone_name", "minute", "mean_delay")
    window = held.filter(F.col("day").between(F.lit(params.lookback_start), F.lit(params.last_day)))
    return label_delays(window, "day", surge_bands(catalog, params), params)


def label_delays(delays: DataFrame, day: str, bands: DataFrame, params: Params) -> DataFrame:
    return clamped_band_label(delays, bands, {"zone_name": "zone_name", day: "date_updated"}, "mean_delay",
                              "mean_delay_start", "mean_delay_end", "surge_fee", "surge_event", params.low_delay)


def surge_minutes(catalog: Catalog, params: Params) -> DataFrame:
    """Label(s) of every zone-minute, spelled out over all history (see ``filled_delays``)."""
    delays = filled_delays(delay_observations(catalog, params))
    labelled = label_delays(delays, "created_date_local", surge_bands(catalog, params), params)
    return labelled.select(*delays.columns, "surge_event").distinct()


def surge_sessions(catalog: Catalog, params: Params, sessions: DataFrame | None = None) -> DataFrame:
    """Sessions with the surge label(s) of their zone at their start minute, NULL if none."""
    sessions = restaurant_sessions(catalog, params) if sessions is None else sessions
    return attribute_minute(sessions, surge_segments(catalog, params),
                            {"lg_zone_name": "zone_name"}, F.col("local_ts"),
                            "start_minute", "end_minute", ["surge_event"])


def surge_orders(catalog: Catalog, params: Params, profit: DataFrame | None = None) -> DataFrame:
    """Orders and profit by the label the profit table carries; a missing one is ``params.no_surge``.

    It becomes so before grouping: orders without a label and those labelled so are one row.
    """
    net = without_ads(F.col("gpo_excl_wastage"), F.col("ad_rev_per_order"), F.col("sub_rev_per_order"))
    profit = full_fee_profit(catalog, params) if profit is None else profit
    return (profit
            .withColumn("surge_event", F.coalesce("surge_event", F.lit(params.no_surge)))
            .groupBy("date_local", "hour_", "zone_name", "surge_event")
            .agg(F.count_distinct("order_code").alias("total_orders"),
                 total(F.col("gpo_excl_wastage"), params).alias("total_gp"),
                 total(net, params).alias("total_gp_wo_ad")))


def daily_conversion_by_surge(catalog: Catalog, params: Params, facts: Facts | None = None) -> DataFrame:
    """The window's result, from ``facts`` if they are given (see ``rolling.py``)."""
    keys = ["date_", "hour_", "lg_zone_name", "surge_event"]
    orders = surge_orders(catalog, params, facts and facts.full_fee).withColumnsRenamed(
        {"date_local": "date_", "zone_name": "lg_zone_name"})
    sessions = session_counts(surge_sessions(catalog, params, facts and facts.sessions), "surge_event")
    return stats_join(sessions, orders, keys).orderBy(*keys)
