"""The rolling window of both conversion results, refreshed by day.

Each input table is reduced to a partial state per partition day: filtered, projected, repeated rows
folded, amounts added up per order. States of different days merge: distinct rows by
folding them again, flags by their maximum, amounts by adding. A result merges the states of
its window, so a daily run reads the input partitions of the days that changed and no others. States
do not depend on the window, which moves every day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.functions.clock import day_between, minute_of, to_local
from courierlens.functions.measures import ever
from courierlens.functions.rules import any_like, fully_platform_funded
from courierlens.operators.joins import not_in, semi_in
from courierlens.params import Params
from courierlens.plans.conversion import Facts, joined_fee_flags
from courierlens.sources.catalog import Catalog
from courierlens.sources.day_states import DAY, DayStates


@dataclass(frozen=True)
class State:
    """How rows of an input table, partitioned by ``day``, become partial states."""

    day: str
    reduce: Callable[[DataFrame, Params], DataFrame]


def _sessions(s: DataFrame, params: Params) -> DataFrame:
    minute = minute_of(to_local(s.session_start_timestamp_utc, params.utc_offset_hours))
    rows = s.filter((s.entity == params.entity) & s.lg_zone_name.isNotNull() & s.session_start_timestamp_utc.isNotNull())
    return rows.groupBy(DAY, "ga_session_id", "lg_zone_uuid", "lg_zone_name", minute.alias("local_ts")).agg(
        ever(F.coalesce("is_transaction", F.lit(False))).alias("is_transaction"))


def _verticals(v: DataFrame, params: Params) -> DataFrame:
    rows = v.filter((v.entity == params.entity) & (v.expedition_type == params.delivery) & v.has_restaurants_impression)
    return rows.select(DAY, "ga_session_id").distinct()


def _orders(o: DataFrame, params: Params) -> DataFrame:
    return o.filter(o.entity == params.entity).select(
        DAY, "uuid", "code", o.delivery_fee_local.isin(*params.low_fees).alias("low_fee"),
        F.to_date("expected_delivery_at_local").alias("delivery_day")).distinct()


def _vouchers(v: DataFrame, params: Params) -> DataFrame:
    return v.filter(v.entity == params.entity).groupBy(DAY, "uuid").agg(
        ever(any_like(v.type, [f"%{params.free_delivery}%"])).alias("voucher_free"))


def _discounts(d: DataFrame, params: Params) -> DataFrame:
    return d.filter(d.entity == params.entity).groupBy(DAY, "uuid").agg(
        ever(any_like(d.discount_type, [f"%{params.free_delivery}%"])).alias("discount_free"),
        ever(fully_platform_funded(d.platform_share_pct)).alias("funded"))


def _profit(p: DataFrame, params: Params) -> DataFrame:
    known = F.col("gpo_excl_wastage").isNotNull()

    def part(c: str) -> Column:
        return F.sum(F.when(known, F.coalesce(F.col(c), F.lit(0.0)))).alias(c)

    rows = p.filter(p.vendor_business_type == params.restaurant_type)
    return rows.groupBy(DAY, "zone_name", "order_code", "surge_event", minute_of(p.expected_delivery_at_local).alias("expected_delivery_at_local")).agg(
        F.sum("gpo_excl_wastage").alias("gpo_excl_wastage"), part("ad_rev_per_order"), part("sub_rev_per_order"))


STATES: dict[str, State] = {
    "sessions": State("partition_date", _sessions),
    "session_verticals": State("partition_date", _verticals),
    "shop_orders": State("created_date_utc", _orders),
    "order_vouchers": State("created_date_utc", _vouchers),
    "order_discounts": State("created_date_utc", _discounts),
    "order_profit": State("date_local", _profit),
}


def partial_states(catalog: Catalog, params: Params, days: Iterable[date] | None = None) -> dict[str, DataFrame]:
    """The partial states of all tables, of these days alone if they are given.

    The days are a condition on the raw partition column, so a table that is partitioned by it is read for
    these days only.
    """
    found = {}
    for table, state in STATES.items():
        rows = catalog[table]
        if days is not None:
            rows = rows.filter(F.col(state.day).isin(sorted(days)))
        found[table] = state.reduce(rows.withColumn(DAY, F.col(state.day)).filter(F.col(DAY).isNotNull()), params)
    return found


def changed_days(changes: Mapping[str, DataFrame]) -> set[date]:
    """The days named by tables of changed rows (input table -> its changed rows). A row per day and table comes back.

    Of a row that has moved to another day, both the old and the new one have to be among them.
    """
    found: set[date] = set()
    for table, rows in changes.items():
        found |= {r[0] for r in rows.select(STATES[table].day).distinct().collect() if r[0] is not None}
    return found


def refresh(states: DayStates, catalog: Catalog, params: Params, days: Iterable[date]) -> None:
    """Recomputes the partial states of these days and puts them in the place of what was kept."""
    days = set(days)
    states.refresh(partial_states(catalog, params, days), days)


def window_facts(states: DayStates, catalog: Catalog, params: Params) -> Facts:
    """The facts of the window, merged from the states of its days. ``catalog`` gives the column types alone."""
    kinds = {table: frame.schema for table, frame in partial_states(catalog, params).items()}
    first, last = params.lookback_start, params.last_day

    def held(table: str) -> DataFrame:
        return states.read(table, kinds[table], first, last)

    started = held("sessions").filter(day_between(F.col("local_ts"), first, last))
    sessions = semi_in(started, "ga_session_id", held("session_verticals"), "ga_session_id")
    sessions = sessions.select(F.to_date("local_ts").alias("date_"), F.hour("local_ts").alias("hour_"), "local_ts",
                               "ga_session_id", "lg_zone_uuid", "lg_zone_name", "is_transaction")
    orders = (held("shop_orders").filter(F.col("delivery_day").between(F.lit(first), F.lit(last)))
              .select("uuid", "code", "low_fee").distinct())
    vouchers = held("order_vouchers").groupBy("uuid").agg(F.max("voucher_free").alias("voucher_free"))
    discounts = held("order_discounts").groupBy("uuid").agg(F.max("discount_free").alias("discount_free"), F.max("funded").alias("funded"))
    codes = joined_fee_flags(orders, vouchers, discounts).filter(F.col("is_fee_incentivised") == 1).select("code")
    profit = held("order_profit").select(
        F.col(DAY).alias("date_local"), F.hour("expected_delivery_at_local").alias("hour_"), "expected_delivery_at_local", "zone_name", "order_code",
        "gpo_excl_wastage", "ad_rev_per_order", "sub_rev_per_order", "surge_event")
    return Facts(sessions, profit, not_in(profit, "order_code", codes, "code"))
