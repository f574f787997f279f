"""Input tables derived from the generated test tables.

The test data has no zones, vendors or sessions, so each input table is a SELECT over
the given tables that stands in for it. The same text serves Spark and DuckDB; the few
spots where the two differ go through a ``Dialect``. Amounts are chosen so that sums and
roundings are exact, and NULLs, duplicates and reversed intervals come from key remainders.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from courierlens.params import Params
from courierlens.sources.catalog import Catalog
from courierlens.sources.session import apply_settings

GIVEN = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

TRAFFIC = Params(entity="home", as_of=date(2024, 2, 1), house_name_patterns=("%house account%",),
                 economics_from=date(2024, 1, 1))
COMMERCE = Params(entity="home", as_of=date(2001, 1, 1), house_name_patterns=("%house account%",),
                  economics_from=date(1996, 6, 1), history_from=date(1997, 1, 1))
CONTRACTS = Params(entity="home", as_of=date(1999, 1, 1), house_name_patterns=("%house account%",),
                   history_from=date(1996, 1, 1))


@dataclass(frozen=True)
class Dialect:
    explode: str
    timestamp: str
    spark: bool

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def array(self, *items: str) -> str:
        return ("array(" if self.spark else "list_value(") + ", ".join(items) + ")"

    def collect(self, item: str) -> str:
        return f"collect_list({item})" if self.spark else f"list({item})"

    def add_days(self, day: str, days: str) -> str:
        return f"date_add({day}, CAST({days} AS INT))" if self.spark else f"CAST({day} + CAST({days} AS INT) AS DATE)"

    def ints(self, low: str, high: str) -> str:
        return f"sequence({low}, {high})" if self.spark else f"generate_series({low}, {high})"

    def apply(self, items: str, variable: str, body: str) -> str:
        return f"transform({items}, {variable} -> {body})" if self.spark else f"list_transform({items}, lambda {variable}: {body})"


SPARK = Dialect("explode", "TIMESTAMP_NTZ", True)
DUCKDB = Dialect("unnest", "TIMESTAMP", False)

# Zone of an event: 25 known zones, remainder 25 is an unknown one.
_ZONE_ID = "concat('z', user_id % 26)"
_ZONE_NAME = "CASE WHEN user_id % 26 < 25 THEN concat('NATION_', user_id % 26) END"


def _entity(key: str, every: int) -> str:
    return f"CASE WHEN {key} % {every} = 5 THEN 'other' ELSE 'home' END AS entity"


def rain(d: Dialect) -> str:
    return f"SELECT {_ZONE_NAME} AS zone, ts, value AS rainfall_mm FROM events"


def countries(d: Dialect) -> str:
    zone = d.struct(
        name="CASE WHEN n_nationkey % 9 = 7 THEN concat('Dmart ', n_name) ELSE n_name END",
        id="CAST(n_nationkey AS BIGINT)",
        lg_zone_uuid="concat('z', n_nationkey)",
        is_active="n_nationkey % 11 <> 3",
        has_default_delivery_area_settings="CASE WHEN n_nationkey % 13 <> 5 THEN true END",
    )
    return f"""
SELECT CASE WHEN region_key = 4 THEN 'other' ELSE 'home' END AS entity,
       {d.collect(d.struct(zones="zones"))} AS cities
FROM (SELECT n_regionkey AS region_key, n_nationkey % 2 AS city_key, {d.collect(zone)} AS zones
      FROM nation GROUP BY n_regionkey, n_nationkey % 2) AS city
GROUP BY region_key"""


def area_events(d: Dialect) -> str:
    return f"""
SELECT concat('E', event_id) AS uuid, {_ZONE_ID} AS lg_zone_uuid,
       CAST(1 AS DOUBLE) AS activation_threshold, CAST(0 AS DOUBLE) AS deactivation_threshold,
       CASE event_id % 8 WHEN 0 THEN 'Auto Shrink_0' WHEN 1 THEN 'shrink_1' WHEN 2 THEN 'SHRINK_2 rain'
            WHEN 3 THEN 'shrink_3' WHEN 4 THEN 'shrinkX4 late' WHEN 5 THEN 'Closed now' WHEN 6 THEN 'shrinkage' END AS title,
       ts AS start_at_local,
       ts + INTERVAL '1' SECOND * CAST(floor(value * 100) AS INT) AS end_at_local,
       CAST(ts AS DATE) AS created_date_utc, {_entity('event_id', 31)},
       CASE WHEN event_id % 17 = 3 THEN 'manual' ELSE 'automatic' END AS activation_type,
       event_id % 19 <> 4 AS is_active, CASE WHEN event_id % 23 <> 6 THEN true END AS is_shape_in_sync
FROM events WHERE event_type = 'error'"""


def zone_stats(d: Dialect) -> str:
    delay = d.struct(mean_delay_in_minutes="CAST(round(value * 100) % 1300 AS DOUBLE) / 100 - 2")
    none = d.struct(mean_delay_in_minutes="CAST(NULL AS DOUBLE)")
    other = d.struct(mean_delay_in_minutes="CAST(event_id % 9 AS DOUBLE)")
    return f"""
SELECT {_entity('event_id', 31)}, {_ZONE_ID} AS lg_zone_uuid,
       ts - INTERVAL '8' HOUR AS created_at_utc, CAST(ts - INTERVAL '8' HOUR AS DATE) AS created_date_utc,
       CASE event_id % 10 WHEN 0 THEN {d.array(none)} WHEN 1 THEN {d.array(delay, other)}
            WHEN 2 THEN NULL ELSE {d.array(delay)} END AS stats
FROM events WHERE event_type = 'view'"""


def surge_bands(d: Dialect) -> str:
    return f"""
SELECT day AS date_updated, zone AS zone_name,
       CASE WHEN (k + b) % 13 <> 0 THEN concat('surge_', b) END AS surge_event,
       CAST(b AS DOUBLE) * 2.5e0 - 1 AS mean_delay_start,
       CAST(b AS DOUBLE) * 2.5e0 + CASE WHEN k % 5 = 3 THEN 1.0e0 ELSE 1.5e0 END AS mean_delay_end,
       CASE WHEN k % 4 = 0 AND b = 1 THEN 0.5e0 WHEN b = 3 THEN 1.5e0 ELSE b * 0.5e0 + 0.5e0 END AS surge_fee
FROM (SELECT day, zone, k, {d.explode}({d.array('0', '1', '2', '3')}) AS b
      FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, {_ZONE_NAME} AS zone, user_id % 26 AS k
            FROM events WHERE event_type = 'click') AS days) AS bands"""


def order_profit_traffic(d: Dialect) -> str:
    return f"""
SELECT CASE WHEN event_id % 37 <> 8 THEN concat('O', event_id) END AS order_code, {_ZONE_NAME} AS zone_name,
       CASE WHEN event_id % 8 = 2 THEN 'shops' ELSE 'restaurants' END AS vendor_business_type,
       CAST(ts AS DATE) AS date_local, ts AS expected_delivery_at_local,
       CASE WHEN event_id % 41 <> 9 THEN value END AS gpo_excl_wastage, value * 2 AS gmv_local,
       CASE WHEN event_id % 5 < 4 THEN CAST(event_id % 5 AS DOUBLE) / 4 END AS ad_rev_per_order,
       CASE WHEN event_id % 3 < 2 THEN CAST(event_id % 3 AS DOUBLE) / 2 END AS sub_rev_per_order,
       CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no_surge' ELSE concat('surge_', event_id % 7 - 2) END AS surge_event
FROM events WHERE event_type IN ('purchase', 'click')"""


def shop_orders_traffic(d: Dialect) -> str:
    return f"""
SELECT {_entity('event_id', 31)}, concat('U', event_id) AS uuid, concat('O', event_id) AS code,
       concat('C', user_id) AS vendor_code, 'delivery' AS expedition_type, ts AS expected_delivery_at_local,
       CAST(ts AS DATE) AS created_date_utc, CAST(ts AS DATE) AS ordered_at_date_local,
       CAST(10 AS DOUBLE) AS minimum_delivery_value_local, value AS total_value_local,
       CAST(2 AS DOUBLE) AS delivery_fee_original_local, CAST(7 AS DOUBLE) AS delivery_fee_vat_rate,
       CAST(CASE event_id % 7 WHEN 0 THEN 0.99 WHEN 1 THEN 0.93 WHEN 2 THEN NULL ELSE 2.50 END AS DOUBLE) AS delivery_fee_local,
       event_id % 43 = 1 AS is_test_order, event_id % 47 <> 1 AS is_valid_order, event_id % 53 <> 1 AS is_gross_order
FROM events WHERE event_type IN ('purchase', 'click')"""


def order_vouchers_traffic(d: Dialect) -> str:
    return f"""
SELECT {_entity('event_id', 29)}, concat('U', event_id) AS uuid,
       CASE (event_id + n) % 6 WHEN 0 THEN 'Free_Delivery_week' WHEN 1 THEN NULL ELSE 'percent' END AS type,
       CAST(CASE WHEN event_id % 3 < 2 THEN event_id % 3 * 50 END AS DOUBLE) AS platform_share_pct,
       floor(value) AS value_local, CAST(ts AS DATE) AS created_date_utc
FROM (SELECT *, {d.explode}({d.ints('0', 'event_id % 2')}) AS n FROM events
      WHERE event_type IN ('purchase', 'click') AND event_id % 10 <> 3) AS v"""


def order_discounts_traffic(d: Dialect) -> str:
    return f"""
SELECT {_entity('event_id', 37)}, concat('U', event_id) AS uuid,
       CASE (event_id + n) % 9 WHEN 0 THEN 'free_delivery' WHEN 1 THEN NULL ELSE 'amount' END AS discount_type,
       CAST(CASE (event_id + n) % 4 WHEN 0 THEN 100 WHEN 1 THEN NULL WHEN 2 THEN 50 ELSE 0 END AS DOUBLE) AS platform_share_pct,
       floor(value) AS discount_amount_local, CAST(ts AS DATE) AS created_date_utc
FROM (SELECT *, {d.explode}({d.ints('0', 'event_id % 3')}) AS n FROM events
      WHERE event_type IN ('purchase', 'click') AND event_id % 11 <> 3) AS v"""


def sessions(d: Dialect) -> str:
    return f"""
SELECT {_entity('event_id', 31)},
       CASE WHEN event_id % 29 <> 7 THEN concat('S', user_id, '-', day(ts)) END AS ga_session_id,
       {_ZONE_ID} AS lg_zone_uuid, {_ZONE_NAME} AS lg_zone_name,
       ts - INTERVAL '8' HOUR AS session_start_timestamp_utc,
       CASE event_type WHEN 'purchase' THEN true WHEN 'click' THEN NULL ELSE false END AS is_transaction,
       CAST(ts - INTERVAL '8' HOUR AS DATE) AS partition_date
FROM events WHERE event_type <> 'error'"""


def session_verticals(d: Dialect) -> str:
    return f"""
SELECT {_entity('event_id', 23)}, concat('S', user_id, '-', day(ts)) AS ga_session_id,
       CAST(ts AS DATE) AS partition_date,
       CASE WHEN event_id % 9 = 4 THEN 'pickup' ELSE 'delivery' END AS expedition_type,
       CASE WHEN event_id % 10 < 8 THEN true WHEN event_id % 10 = 8 THEN false END AS has_restaurants_impression
FROM events"""


def web_events(d: Dialect) -> str:
    return f"""
SELECT CAST(ts AS DATE) AS date_local, CAST(floor(hour(ts) / 12) * 12 AS INT) AS hour_,
       CASE user_id % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' END AS platform,
       CASE WHEN user_id % 5 < 4 THEN concat('NATION_', user_id % 5) END AS zone_name,
       CASE event_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'search engine' WHEN 2 THEN 'social' END AS traffic_source,
       CASE WHEN user_id % 2 = 0 THEN 'paid' ELSE 'organic' END AS channel_grouping,
       CASE WHEN event_id % 13 <> 6 THEN concat('S', user_id % 40, '-', day(ts)) END AS ga_session_id,
       CASE WHEN event_type = 'purchase' AND event_id % 11 <> 6 THEN concat('O', event_id - event_id % 4) END AS order_code,
       event_action,
       CASE event_id % 10 WHEN 0 THEN 'restaurants' WHEN 1 THEN 'restaurants' WHEN 2 THEN 'restaurants'
            WHEN 3 THEN 'street_food' WHEN 4 THEN 'caterer' WHEN 5 THEN 'caterers' WHEN 6 THEN 'homescreen'
            WHEN 7 THEN 'web.city page' WHEN 8 THEN 'shops' END AS vendor_type,
       CASE event_id % 3 WHEN 0 THEN 'my_order' WHEN 1 THEN 'home' END AS screen_name
FROM (SELECT *, {d.explode}(CASE event_type
        WHEN 'view' THEN {d.array("'home_screen.loaded'", "'shop_list.loaded'")}
        WHEN 'click' THEN {d.array("'shop_list.updated'", "'shop_details.loaded'", "'cart.loaded'")}
        WHEN 'signup' THEN {d.array("'shop_details.loaded'", "'checkout.loaded'")}
        WHEN 'purchase' THEN {d.array("'checkout.loaded'", "'transaction'")}
        ELSE {d.array("'navigation.clicked'", "CAST(NULL AS VARCHAR(20))" if d.spark else "NULL")} END) AS event_action
      FROM events) AS steps"""


def vendor_types(d: Dialect) -> str:
    return f"""
SELECT {_entity('c_custkey', 31)}, concat('C', c_custkey) AS vendor_code,
       CASE c_custkey % 8 WHEN 0 THEN 'restaurants' WHEN 1 THEN 'caterers' WHEN 2 THEN 'kitchens' WHEN 3 THEN 'shops'
            WHEN 4 THEN 'dmart' WHEN 5 THEN 'quick_store' WHEN 6 THEN 'restaurants' END AS business_type_apac,
       CASE WHEN c_custkey % 10 <> 9 THEN c_custkey % 8 = 2 END AS is_kitchens
FROM customer"""


def shop_orders_commerce(d: Dialect) -> str:
    expected = (f"CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS {d.timestamp})"
                " + INTERVAL '1' HOUR * CAST(o_orderkey % 2 * 12 AS INT)")
    return f"""
SELECT {_entity('o_orderkey', 31)}, concat('U', o_orderkey) AS uuid,
       CASE WHEN o_orderkey % 89 <> 5 THEN concat('O', o_orderkey) END AS code,
       concat('C', o_custkey) AS vendor_code,
       CASE WHEN o_orderkey % 12 = 5 THEN 'pickup' ELSE 'delivery' END AS expedition_type,
       {expected} AS expected_delivery_at_local,
       CAST(o_orderdate AS DATE) AS created_date_utc, CAST(o_orderdate AS DATE) AS ordered_at_date_local,
       CAST(CASE o_orderkey % 19 WHEN 0 THEN 25 WHEN 1 THEN NULL ELSE 5 + o_orderkey % 9 END AS DOUBLE) AS minimum_delivery_value_local,
       o_totalprice AS total_value_local,
       CAST(CASE o_orderkey % 6 WHEN 0 THEN 0.99 WHEN 1 THEN 0.93 WHEN 2 THEN 1.00 WHEN 3 THEN NULL ELSE 3.50 + o_orderkey % 4 END AS DOUBLE) AS delivery_fee_original_local,
       CAST(7 + o_orderkey % 2 AS DOUBLE) AS delivery_fee_vat_rate,
       CAST(2.5 AS DOUBLE) AS delivery_fee_local,
       o_orderkey % 43 = 1 AS is_test_order, o_orderkey % 47 <> 1 AS is_valid_order, o_orderkey % 53 <> 1 AS is_gross_order
FROM orders"""


def order_profit_commerce(d: Dialect) -> str:
    return """
SELECT concat('O', o_orderkey) AS order_code, concat('NATION_', c_nationkey) AS zone_name,
       CASE WHEN o_orderkey % 5 = 0 THEN 'shops' ELSE 'restaurants' END AS vendor_business_type,
       CAST(o_orderdate AS DATE) AS date_local, o_orderdate AS expected_delivery_at_local,
       CAST(o_orderkey % 1000 AS DOUBLE) / 100 - 2 AS gpo_excl_wastage,
       CASE WHEN c_nationkey = 6 THEN 0.0e0 ELSE o_totalprice END AS gmv_local,
       CAST(NULL AS DOUBLE) AS ad_rev_per_order, CAST(NULL AS DOUBLE) AS sub_rev_per_order,
       CAST(NULL AS VARCHAR(20)) AS surge_event
FROM orders JOIN customer ON o_custkey = c_custkey"""


def order_vouchers_commerce(d: Dialect) -> str:
    return f"""
SELECT {_entity('l_partkey', 29)}, concat('U', l_orderkey) AS uuid,
       CASE l_returnflag WHEN 'R' THEN 'free_delivery' WHEN 'A' THEN 'percent' END AS type,
       CASE WHEN l_quantity <> 7 THEN round(l_tax * 1000) END AS platform_share_pct,
       floor(l_extendedprice * l_discount / 2000) * 10 AS value_local,
       CAST(l_shipdate AS DATE) AS created_date_utc
FROM lineitem WHERE l_linenumber % 2 = 1"""


def order_discounts_commerce(d: Dialect) -> str:
    return f"""
SELECT {_entity('l_partkey', 37)}, concat('U', l_orderkey) AS uuid,
       CASE l_returnflag WHEN 'R' THEN 'free_delivery' WHEN 'A' THEN 'amount' END AS discount_type,
       CASE WHEN l_quantity <> 8 THEN CASE WHEN l_suppkey % 5 = 1 THEN 100.0e0 ELSE round(l_tax * 1000) END END AS platform_share_pct,
       floor(l_extendedprice * l_discount / 3000) * 10 AS discount_amount_local,
       CAST(l_shipdate AS DATE) AS created_date_utc
FROM lineitem WHERE l_linenumber % 2 = 0"""


def vendors(d: Dialect) -> str:
    return f"""
SELECT {_entity('s_suppkey', 31)}, concat('V', s_suppkey) AS vendor_code, chain_name,
       CASE s_suppkey % 14 WHEN 1 THEN 'Islandwide Foods' WHEN 2 THEN 'X Restaurant Delivery'
            WHEN 3 THEN 'VENDOR DELIVERY hub' WHEN 4 THEN NULL WHEN 5 THEN 'House Account 5' ELSE s_name END AS name,
       CASE WHEN s_suppkey % 17 = 6 THEN 'Shop' ELSE 'Restaurant' END AS vertical,
       CASE WHEN s_suppkey % 13 <> 7 THEN s_suppkey % 13 <> 8 END AS is_active, s_suppkey % 19 = 9 AS is_test
FROM (SELECT *, {d.explode}(CASE WHEN s_suppkey % 15 = 10 THEN {d.array("'east'", "'west'")}
                            ELSE {d.array("concat('chain ', s_nationkey)")} END) AS chain_name FROM supplier) AS s
UNION ALL
SELECT {_entity('c_custkey', 31)}, concat('C', c_custkey), 'none',
       CASE WHEN c_custkey % 14 = 1 THEN 'Islandwide Cafe' ELSE c_name END,
       CASE WHEN c_custkey % 17 = 6 THEN 'Shop' ELSE 'Restaurant' END, c_custkey % 13 <> 7, c_custkey % 19 = 9
FROM customer"""


def vendor_zones(d: Dialect) -> str:
    near = d.apply(d.ints("s_nationkey", "s_nationkey + 2"), "i", d.struct(lg_zone_name="concat('NATION_', i)"))
    own = d.struct(lg_zone_name="concat('NATION_', s_nationkey)")
    void = d.struct(lg_zone_name="CAST(NULL AS VARCHAR(20))")
    home = d.struct(lg_zone_name="concat('NATION_', c_nationkey)")
    next_one = d.struct(lg_zone_name="concat('NATION_', (c_nationkey + c_custkey) % 25)")
    return f"""
SELECT {_entity('s_suppkey', 37)}, concat('V', s_suppkey) AS vendor_code,
       CASE s_suppkey % 10 WHEN 9 THEN NULL WHEN 7 THEN {d.array(own, own, void)} ELSE {near} END AS lg_zones
FROM supplier
UNION ALL
SELECT {_entity('c_custkey', 37)}, concat('C', c_custkey),
       CASE c_custkey % 10 WHEN 9 THEN NULL WHEN 7 THEN {d.array(home, home)} ELSE {d.array(home, next_one)} END
FROM customer"""


def vendor_offline(d: Dialect) -> str:
    worked = d.struct(
        total_open_seconds="CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 180 + l_linenumber % 3 * 10 END",
        total_unavailable_seconds="CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_linenumber * 360 + 5 AS BIGINT) END")
    second = d.struct(total_open_seconds="CASE WHEN l_partkey % 3 <> 0 THEN CAST(3600 AS BIGINT) END",
                      total_unavailable_seconds="CAST(20 AS BIGINT)")
    return f"""
SELECT {_entity('l_partkey', 31)}, concat('V', l_suppkey) AS vendor_code, CAST(l_shipdate AS DATE) AS report_date,
       CASE l_partkey % 11 WHEN 1 THEN NULL WHEN 2 THEN {d.array(worked, second, second)} ELSE {d.array(worked)} END AS availabilities
FROM lineitem"""


def logistics_orders(d: Dialect) -> str:
    def plus(seconds: str) -> str:
        return f"l_shipdate + INTERVAL '1' SECOND * CAST({seconds} AS INT)"

    def fraction(remainder: int) -> str:
        return f" + CASE WHEN l_partkey % 4 = {remainder} THEN INTERVAL '600' MILLISECOND ELSE INTERVAL '0' MILLISECOND END"

    if d.spark:
        def fraction(remainder: int) -> str:  # noqa: F811
            return f" + CASE WHEN l_partkey % 4 = {remainder} THEN INTERVAL '0.6' SECOND ELSE INTERVAL '0' SECOND END"

    rider = d.struct(
        promised_delivery_at_local=f"CASE WHEN l_partkey % 97 <> 1 THEN {plus('l_linenumber * 3600')} END",
        rider_late_in_seconds="(l_partkey * 13 + l_linenumber * 7) % 1300 - 400",
        at_vendor_time_in_seconds="CAST(200 + l_quantity * 5 + l_partkey % 2 AS BIGINT)",
        at_vendor_time_cleaned_in_seconds="CASE WHEN l_partkey % 61 <> 1 THEN CAST(l_quantity * 6 + l_partkey % 3 AS BIGINT) END",
        original_scheduled_pickup_at_local=plus("3600") + fraction(0))
    vendor = d.struct(picked_up_at_local=plus("3600 + (l_partkey * 5 % 200 - 50) * 6") + fraction(1))
    return f"""
SELECT {_entity('l_partkey', 31)}, concat('V', l_suppkey) AS vendor_code,
       CASE WHEN l_orderkey % 101 <> 1 THEN concat('O', l_orderkey) END AS order_code,
       CAST(l_shipdate AS DATE) AS created_date_local, CAST(l_shipdate AS DATE) AS created_date_utc,
       {rider} AS rider, {vendor} AS vendor
FROM lineitem"""


def crm_accounts(d: Dialect) -> str:
    return f"""
SELECT {_entity('c_custkey', 41)}, concat(prefix, c_custkey) AS id, concat('C', c_custkey) AS vendor_code
FROM (SELECT *, {d.explode}(CASE WHEN c_custkey % 9 = 2 THEN {d.array("'A'", "'B'")} ELSE {d.array("'A'")} END) AS prefix
      FROM customer) AS a"""


def crm_contracts(d: Dialect) -> str:
    return f"""
SELECT {_entity('o_orderkey', 41)}, concat(CASE WHEN o_orderkey % 9 = 2 THEN 'B' ELSE 'A' END, o_custkey) AS sf_account_id,
       CAST(o_orderdate AS DATE) AS start_date_local,
       CASE WHEN o_orderkey % 53 <> 1 THEN {d.add_days('CAST(o_orderdate AS DATE)', 'o_orderkey % 200')} END AS end_date_local
FROM orders"""


_SHARED: dict[str, Callable[[Dialect], str]] = {
    "rain": rain,
    "countries": countries,
    "area_events": area_events,
    "logistics_orders": logistics_orders,
    "zone_stats": zone_stats,
    "vendors": vendors,
    "crm_accounts": crm_accounts,
    "crm_contracts": crm_contracts,
    "web_events": web_events,
    "surge_bands": surge_bands,
    "vendor_offline": vendor_offline,
    "session_verticals": session_verticals,
    "sessions": sessions,
    "vendor_types": vendor_types,
    "vendor_zones": vendor_zones,
}

# Orders come in two editions: by web event (2024) and by order and line item (1995-2001).
TABLES: dict[str, dict[str, Callable[[Dialect], str]]] = {
    "traffic": {**_SHARED, "order_profit": order_profit_traffic, "shop_orders": shop_orders_traffic,
                "order_vouchers": order_vouchers_traffic, "order_discounts": order_discounts_traffic},
    "commerce": {**_SHARED, "order_profit": order_profit_commerce, "shop_orders": shop_orders_commerce,
                 "order_vouchers": order_vouchers_commerce, "order_discounts": order_discounts_commerce},
}


_schemas: dict[tuple[str, int], StructType] = {}


def given_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the schema of one on a local path is looked up once per version of it, not on every read."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if not os.path.exists(path):
        return spark.read.parquet(path)
    version = path, os.stat(path).st_mtime_ns
    if version not in _schemas:
        _schemas[version] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[version]).parquet(path)


def sample_catalog(spark: SparkSession, sf_dir: str, edition: str) -> Catalog:
    """The derived tables as lazy views over the parquet files in ``sf_dir``."""
    apply_settings(spark)
    given: dict[str, DataFrame] = {}

    def resolve(name: str) -> DataFrame:
        text = TABLES[edition][name](SPARK)
        used = [t for t in GIVEN if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            if t not in given:
                given[t] = given_table(spark, sf_dir, t)
        return spark.sql(text, **{t: given[t] for t in used})

    return Catalog(resolve)
