"""Session funnel for the whole platform and for restaurants.

The events are read twice, browsing rows and transactions by a filtered scan each. Every row
gets its step flags, sessions are flagged in one aggregate and counted in a second, and the
output rows of both verticals are laid out from that one small table. No event row is joined
with another aggregate of the events.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.functions.measures import ever
from courierlens.functions.rules import order_vertical, source_rank
from courierlens.operators.aggregates import keep_best
from courierlens.operators.funnels import session_flags, step_counts
from courierlens.params import Params
from courierlens.sources.catalog import Catalog

KEYS = ["date_local", "hour_", "platform", "zone_name", "traffic_source", "channel_grouping"]
SESSION = "ga_session_id"
STEP_PAIRS = {
    "mcvr2_denominator": ["list"],
    "mcvr2_numerator": ["list", "details"],
    "mcvr3_denominator": ["details"],
    "mcvr3_numerator": ["details", "checkout"],
    "mcvr4_denominator": ["checkout"],
    "mcvr4_numerator": ["checkout", "transaction"],
}
CONVERSION = ["cvr_denominator", "cvr_numerator", "mocvr_numerator"]
COLUMNS = [*KEYS, SESSION, "order_code", "event_action", "vendor_type", "screen_name"]


def browsing_events(catalog: Catalog, params: Params) -> DataFrame:
    e = catalog["web_events"]
    return e.filter((e.event_action != params.transaction) & (e.date_local >= F.lit(params.history_from))
                    ).select(*COLUMNS)


def transaction_events(catalog: Catalog, params: Params) -> DataFrame:
    """One transaction event per order code, by source priority; one for all without a code.

    The remaining columns break ties, so the pick is the same on every run.
    """
    e = catalog["web_events"]
    rows = e.filter((e.event_action == params.transaction) & (e.date_local >= F.lit(params.history_from))
                    ).select(*COLUMNS)
    rank = source_rank(F.col("traffic_source"), params.source_priority)
    ties = [F.col(c) for c in (*KEYS, SESSION, "vendor_type", "screen_name")]
    return keep_best(rows, ["order_code"], [rank.asc_nulls_last(), *ties])


def web_events(catalog: Catalog, params: Params) -> DataFrame:
    """All browsing events and the deduplicated transactions."""
    return browsing_events(catalog, params).unionByName(transaction_events(catalog, params))


def valid_orders(catalog: Catalog, params: Params) -> DataFrame:
    """code, vendor_code, vertical_type of valid gross orders of known vendors."""
    o, t = catalog["shop_orders"], catalog["vendor_types"]
    orders = o.filter(
        (o.entity == params.entity)
        & (o.created_date_utc >= F.lit(params.valid_orders_created_from))
        & (o.ordered_at_date_local >= F.lit(params.history_from))
        & o.is_valid_order
        & ~o.is_test_order
        & o.is_gross_order
        & o.code.isNotNull()
    ).select("code", "vendor_code")
    types = t.filter(t.entity == params.entity).select("vendor_code", "business_type_apac")
    return orders.join(types, "vendor_code").select(
        "code", "vendor_code",
        order_vertical(F.col("business_type_apac"), params.restaurant_order_types).alias("vertical_type"))


def ordered_events(catalog: Catalog, params: Params) -> DataFrame:
    """``web_events`` with whether a transaction is a valid order, and a restaurant order.

    Deduplicated transactions and reduced orders are both laid out by code already, so
    the lookup adds no exchange of its own.
    """
    codes = (valid_orders(catalog, params).groupBy(F.col("code").alias("_code"))
             .agg(ever(F.col("vertical_type") == "restaurants").alias("_restaurant")))
    bought = transaction_events(catalog, params).join(codes, F.col("order_code") == F.col("_code"), "left")
    known = F.col("_code").isNotNull()
    no = F.lit(False)
    return browsing_events(catalog, params).select(
        *COLUMNS, no.alias("is_order"), no.alias("is_restaurant_order")
    ).unionByName(bought.select(
        *COLUMNS, known.alias("is_order"), F.coalesce("_restaurant", no).alias("is_restaurant_order")))


def step_hits(params: Params) -> dict[str, Column]:
    action = F.col("event_action")
    return {
        "home": action.isin(*params.home_actions),
        "list": action.isin(*params.list_actions),
        "details": action.isin(*params.details_actions),
        "checkout": action.isin(*params.checkout_actions),
        "transaction": action == params.transaction,
    }


def restaurant_session_event(params: Params) -> Column:
    """Shopping at a restaurant-like vendor, or opening one of the order screens."""
    action = F.col("event_action")
    shopping = action.isin(*params.session_actions) & F.col("vendor_type").isin(*params.session_vendor_types)
    reviewing = (action == params.navigation) & F.col("screen_name").isin(*params.order_screens)
    return shopping | reviewing


def flagged_sessions(events: DataFrame, params: Params) -> DataFrame:
    """Per key and session: steps reached overall and at restaurants, restaurant session, orders."""
    hits = step_hits(params)
    in_funnel = F.col("vendor_type").isin(*params.funnel_vendor_types)
    in_session = restaurant_session_event(params)
    restaurant_order = in_session & F.col("is_restaurant_order")
    steps = {
        **hits,
        **{f"resto_{name}": in_funnel & hit for name, hit in hits.items()},
        "resto_funnel": in_funnel,
        "resto_session": in_session,
        "resto_bought": restaurant_order,
    }
    # A code is left on one transaction row, so rows with a known code are distinct orders.
    orders = F.count_if(F.col("is_order")).alias("orders")
    resto_orders = F.count_if(restaurant_order).alias("resto_orders")
    return session_flags(events, KEYS, SESSION, steps, [orders, resto_orders])


def funnel_counts(catalog: Catalog, params: Params) -> DataFrame:
    """All counts of both verticals, one row per key."""
    counts = {
        **STEP_PAIRS,
        "cvr_denominator": [],
        "cvr_numerator": ["transaction"],
        **{f"resto_{name}": [f"resto_{s}" for s in steps] for name, steps in STEP_PAIRS.items()},
        "resto_cvr_denominator": ["resto_session"],
        "resto_cvr_numerator": ["resto_bought"],
    }
    sessions = flagged_sessions(ordered_events(catalog, params), params)
    return step_counts(sessions, KEYS, SESSION, counts, [
        F.sum("orders").alias("mocvr_numerator"),
        F.sum("resto_orders").alias("resto_mocvr_numerator"),
        F.max("resto_funnel").alias("in_resto_funnel"),
        F.max("resto_session").alias("in_resto_sessions"),
    ])


def keys_known() -> Column:
    """Join keys match only where none is NULL."""
    return reduce(and_, [F.col(k).isNotNull() for k in KEYS])


def platform_orders(counts: DataFrame) -> DataFrame:
    """Valid orders per key."""
    return counts.filter(F.col("mocvr_numerator") > 0).select(*KEYS, F.col("mocvr_numerator").alias("total_orders"))


def restaurant_session_counts(counts: DataFrame) -> DataFrame:
    return counts.filter("in_resto_sessions").select(
        *KEYS, *[F.col(f"resto_{c}").alias(c) for c in CONVERSION])


def restaurant_step_counts(counts: DataFrame) -> DataFrame:
    return counts.filter("in_resto_funnel").select(*KEYS, *[F.col(f"resto_{c}").alias(c) for c in STEP_PAIRS])


def layout(counts: DataFrame) -> DataFrame:
    """Rows of both verticals.

    Restaurant steps and restaurant sessions are matched like two tables under a full
    join that shows the keys of the steps: unmatched sessions appear without keys, and
    keys with a NULL part never match.
    """
    funnel, sessions = F.col("in_resto_funnel"), F.col("in_resto_sessions")
    steps = list(STEP_PAIRS)

    def row(vertical: str, keys: bool, step_prefix: str | None, conversion: dict[str, Column | None]) -> Column:
        kinds = counts.schema
        missing = {c: F.lit(None).cast(kinds[c].dataType) for c in (*KEYS, *steps, *CONVERSION)}
        return F.struct(
            F.lit(vertical).alias("vertical"),
            *[(F.col(c) if keys else missing[c]).alias(c) for c in KEYS],
            *[(missing[c] if step_prefix is None else F.col(step_prefix + c)).alias(c) for c in steps],
            *[conversion.get(c, missing[c]).alias(c) for c in CONVERSION],
        )

    resto = {c: F.col(f"resto_{c}") for c in CONVERSION}
    platform = row("platform", True, "", {
        "cvr_denominator": F.col("cvr_denominator"),
        "cvr_numerator": F.col("cvr_numerator"),
        "mocvr_numerator": F.when(keys_known() & (F.col("mocvr_numerator") > 0), F.col("mocvr_numerator")),
    })
    matched = keys_known() & sessions
    stepped = row("restaurants", True, "resto_", {c: F.when(matched, v) for c, v in resto.items()})
    unmatched = row("restaurants", False, None, resto)
    rows = F.array(platform, F.when(funnel, stepped),
                   F.when(sessions & ~(keys_known() & funnel), unmatched))
    return (counts.select(F.explode(rows).alias("r")).filter(F.col("r").isNotNull())
            .select("r.*"))


def daily_restaurant_conversion_funnel(catalog: Catalog, params: Params) -> DataFrame:
    return layout(funnel_counts(catalog, params)).orderBy("vertical", *KEYS)
