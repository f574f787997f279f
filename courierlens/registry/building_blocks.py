"""The reusable operators and functions, each over a whole given table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions import clock, measures, rules
from courierlens.operators.aggregates import extreme_with_ties, keep_best
from courierlens.operators.carry import fill_forward_scan
from courierlens.operators.funnels import session_flags, step_counts
from courierlens.operators.intervals import active_count
from courierlens.operators.joins import exists_flag, not_in, semi_in, stats_join
from courierlens.operators.layout import stack_tagged
from courierlens.operators.nested import explode_structs
from courierlens.operators.spines import date_spine, fill_forward
from courierlens.registry.entries import Direct

_TRIO = "user_id * 100 + day(ts)"
_ZONE = "CASE WHEN user_id % 5 < 4 THEN concat('zone_', user_id % 5) END"


def unnest(keep_empty: bool):
    def build(t) -> DataFrame:
        near = F.expr("""CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN filter(array(named_struct('zone', 0)), x -> false)
                         ELSE transform(sequence(s_nationkey, s_nationkey + 2), i -> named_struct('zone', i)) END""")
        return explode_structs(t("supplier").withColumn("zones", near), "zones", {"zone": "zone"}, ["s_suppkey"],
                               keep_empty)
    return build


_UNNEST_SQL = """
SELECT s.s_suppkey, u.zone FROM supplier s {join} LATERAL (
  SELECT unnest(generate_series(s.s_nationkey, s.s_nationkey + CASE WHEN s.s_suppkey % 4 > 1 THEN 2 ELSE -1 END)) AS zone) u ON true"""


def date_spine_orders(t) -> DataFrame:
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 30 - 2).cast("int"))
    return date_spine(t("orders"), start, end, "day").groupBy("day").agg(
        F.count("o_orderkey").alias("orders"))


def filled_events(fill):
    def build(t) -> DataFrame:
        sparse = t("events").select("event_id", "user_id", "ts",
                                    F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))
        return fill(sparse, "user_id", "ts", "value", "known_value")
    return build


def active_count_customers(t) -> DataFrame:
    spans = (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
             .groupBy("c_custkey", "c_mktsegment")
             .agg(F.min(F.to_date("o_orderdate")).alias("start"),
                  F.date_add(F.max(F.to_date("o_orderdate")), -400).alias("end")))
    return active_count(spans, "c_mktsegment", "start", "end", date(1994, 12, 1), date(2001, 12, 31), "day",
                        "customers")


def keep_best_order(t) -> DataFrame:
    return keep_best(t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"), ["o_custkey"],
                     [F.when(F.col("o_orderpriority") == "1-URGENT", 1)
                      .when(F.col("o_orderpriority") == "2-HIGH", 2).asc_nulls_last(), F.col("o_orderkey")])


def extremes(how: str):
    def build(t) -> DataFrame:
        return extreme_with_ties(t("lineitem"), ["l_suppkey"], "l_quantity", "l_returnflag", how, "quantity")
    return build


_EXTREME_SQL = """
SELECT DISTINCT l.l_suppkey, l.l_returnflag, e.quantity
FROM lineitem l JOIN (SELECT l_suppkey, {how}(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey) e
  ON e.l_suppkey = l.l_suppkey AND e.quantity = l.l_quantity"""


def _nullable_customers(t) -> DataFrame:
    return t("customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 3, F.col("c_custkey") * 3).alias("member"))


def _customers_without_null(t) -> DataFrame:
    return t("customer").select("c_custkey", (F.col("c_custkey") * 10 + 4).alias("member"))


def _orders(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 2, F.col("o_custkey")).alias("buyer"))


_NULLABLE = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 2 THEN o_custkey END AS buyer FROM orders) o")
_WITHOUT_NULL = "(SELECT c_custkey, c_custkey * 10 + 4 AS member FROM customer) c"
_MEMBERS = "(SELECT c_custkey, CASE WHEN c_custkey % 10 <> 3 THEN c_custkey * 3 END AS member FROM customer) c"


def semi(t) -> DataFrame:
    return semi_in(_orders(t), "buyer", _nullable_customers(t), "member")


def exists(t) -> DataFrame:
    return exists_flag(_orders(t), "buyer", _nullable_customers(t), "member", "listed")


def excluded(members):
    def build(t) -> DataFrame:
        return not_in(_orders(t), "buyer", members(t), "member")
    return build


def no_members(t) -> DataFrame:
    """An empty list, which is what this one is about."""
    return _customers_without_null(t).filter("c_custkey < 0")


def _excluded_sql(members: str) -> str:
    return f"SELECT * FROM {_NULLABLE} WHERE buyer NOT IN (SELECT member FROM {members})"


def _views_and_purchases(t) -> tuple[DataFrame, DataFrame]:
    keyed = t("events").select(F.expr(_ZONE).alias("zone"), F.to_date("ts").alias("day"), "event_type", "event_id",
                               "user_id")
    views = keyed.filter(F.col("event_type") == "view").groupBy("zone", "day").agg(F.count("event_id").alias("views"))
    # Purchases are moved to later days, so that each side has keys the other has not.
    later = F.date_add("day", (F.col("user_id") % 4 + 2).cast("int")).alias("day")
    purchases = (keyed.filter(F.col("event_type") == "purchase").select("zone", later, "event_id")
                 .groupBy("zone", "day").agg(F.count("event_id").alias("purchases")))
    return views, purchases


def joined_stats(how: str):
    def build(t) -> DataFrame:
        views, purchases = _views_and_purchases(t)
        first, second = (views, purchases) if how == "left" else (purchases, views)
        return stats_join(first, second, ["zone", "day"], how)
    return build


_STATS = f"""
WITH keyed AS (SELECT {_ZONE} AS zone, CAST(ts AS DATE) AS day, event_type, user_id FROM events),
views AS (SELECT zone, day, count(*) AS views FROM keyed WHERE event_type = 'view' GROUP BY ALL),
purchases AS (SELECT zone, CAST(day + CAST(user_id % 4 + 2 AS INTEGER) AS DATE) AS day, count(*) AS purchases FROM keyed
              WHERE event_type = 'purchase' GROUP BY ALL)
"""


def stacked(t) -> DataFrame:
    def sums(name: str, kind: str) -> tuple[str, DataFrame]:
        rows = t("events").filter(F.col("event_type") == kind)
        return name, rows.groupBy(F.to_date("ts").alias("day")).agg(
            F.count("event_id").alias("events"), F.sum("value").alias("total"))
    return stack_tagged([sums("browse", "view"), sums("buy", "purchase")], "part")


def event_funnel(t) -> DataFrame:
    kind = F.col("event_type")
    steps = {"viewed": kind == "view", "clicked": kind == "click", "signed": kind == "signup",
             "bought": kind == "purchase"}
    rows = t("events").select(F.expr(_ZONE).alias("zone"), F.to_date("ts").alias("day"), "event_type",
                              F.when(F.col("event_id") % 17 != 3, F.expr(_TRIO)).alias("session"))
    flags = session_flags(rows, ["zone", "day"], "session", steps)
    return step_counts(flags, ["zone", "day"], "session", {
        "sessions": [], "viewers": ["viewed"], "view_click": ["viewed", "clicked"],
        "click_sign": ["clicked", "signed"], "sign_buy": ["signed", "bought"]})


_FUNNEL_SQL = f"""
SELECT zone, day, count(DISTINCT session) AS sessions, count(DISTINCT session) FILTER (v > 0) AS viewers,
       count(DISTINCT session) FILTER (v > 0 AND c > 0) AS view_click,
       count(DISTINCT session) FILTER (c > 0 AND s > 0) AS click_sign,
       count(DISTINCT session) FILTER (s > 0 AND b > 0) AS sign_buy
FROM (SELECT zone, day, session, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c,
             count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS b
      FROM (SELECT {_ZONE} AS zone, CAST(ts AS DATE) AS day, event_type,
                   CASE WHEN event_id % 17 <> 3 THEN {_TRIO} END AS session FROM events)
      GROUP BY zone, day, session) GROUP BY zone, day"""


def conditional_distinct(t) -> DataFrame:
    return t("events").groupBy(F.to_date("ts").alias("day")).agg(
        measures.distinct_if(F.col("event_type") == "purchase", F.col("user_id")).alias("buyers"),
        F.count_distinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"),
        measures.sum_or_zero(F.when(F.col("event_type") == "error", F.col("value"))).alias("errors"),
        F.sum(F.when(F.col("value") > 400, F.col("value"))).alias("large"))


def safe_ratios(t) -> DataFrame:
    zero_some = F.when(F.col("l_suppkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("l_quantity"))
    return t("lineitem").groupBy("l_suppkey").agg(
        measures.ratio(F.sum("l_linenumber"), F.sum(zero_some)).alias("raw"),
        measures.ratio(F.sum("l_linenumber"), F.count_distinct("l_orderkey"), 2).alias("per_order"))


def subsidies(t) -> DataFrame:
    amount, share = F.floor(F.col("l_extendedprice") * F.col("l_discount") / 100) * 10, F.round(F.col("l_tax") * 1000)
    vendor, platform = rules.subsidy_split(amount, F.when(F.col("l_quantity") != 7, share))
    rows = t("lineitem").select("l_suppkey", vendor.alias("vendor"), platform.alias("platform"))
    positive = rules.any_positive(F.col("vendor"), F.col("platform"))
    return rows.groupBy("l_suppkey").agg(
        F.sum("vendor").alias("vendor"), F.sum("platform").alias("platform"),
        F.sum(rules.flag(positive)).alias("incentivised"), F.sum(F.abs(F.col("platform"))).alias("waived"))


def labelled_names(t) -> DataFrame:
    label = rules.classify_like(F.col("p_name"), [("%ring%", "ring"), ("large%", "large"), ("%b_lt%", "bolt")], "other")
    return t("part").groupBy(label.alias("label")).agg(F.count("p_partkey").alias("parts"),
                                                       F.max("p_retailprice").alias("dearest"))


def allowed_names(t) -> DataFrame:
    name = F.when(F.col("p_partkey") % 9 != 4, F.upper("p_name"))
    return t("part").select("p_partkey", name.alias("name")).filter(
        rules.name_allowed(F.col("name"), ["%ring%", "%hot%", "large%"]))


def clock_columns(t) -> DataFrame:
    local = clock.to_local(F.col("ts"), 8)
    return t("events").select(
        "event_id", local.alias("local_ts"), F.to_date(local).alias("local_date"), F.hour(local).alias("local_hour"),
        F.minute(local).alias("local_minute"), clock.minute_of(local).alias("whole_minute"),
        clock.hour_of(local).alias("whole_hour"), clock.clock_text(local).alias("clock"),
        clock.seconds_between(F.col("ts"), clock.shift(clock.minute_of(F.col("ts")), minutes=3)).alias("seconds"),
        F.add_months(F.date_sub(F.to_date(local), 1), -2).alias("window_start"))


def window_days(t) -> DataFrame:
    rows = t("events").filter(clock.local_day_between(F.col("ts"), 8, date(2024, 1, 5), date(2024, 1, 20))
                              & clock.day_between(F.col("ts"), date(2024, 1, 3), date(2024, 1, 25))
                              & clock.on_or_after(F.col("ts"), date(2024, 1, 2)))
    return rows.groupBy(F.to_date(clock.to_local(F.col("ts"), 8)).alias("day")).agg(
        F.count("event_id").alias("events"))


_FILLED_SQL = """
SELECT event_id, user_id, ts, v AS value, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS known_value
FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events)"""

_LOCAL = "(ts + INTERVAL 8 HOUR)"

OPERATORS: dict[str, Direct] = {
    "unnest_keep_empty": Direct(unnest(True), "SELECT s_suppkey, CAST(zone AS INTEGER) AS zone FROM ("
                                + _UNNEST_SQL.format(join="LEFT JOIN") + ")"),
    "unnest_inner": Direct(unnest(False), "SELECT s_suppkey, CAST(zone AS INTEGER) AS zone FROM ("
                           + _UNNEST_SQL.format(join="JOIN") + ")"),
    "date_spine": Direct(date_spine_orders, """
SELECT CAST(day AS DATE) AS day, count(*) AS orders
FROM (SELECT unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 - 2 AS INTEGER),
             INTERVAL 1 DAY)) AS day FROM orders) GROUP BY 1"""),
    "fill_forward": Direct(filled_events(fill_forward), _FILLED_SQL, ("value", "known_value")),
    "fill_forward_scan": Direct(filled_events(fill_forward_scan), _FILLED_SQL, ("value", "known_value")),
    "active_count": Direct(active_count_customers, """
WITH s AS (SELECT c_custkey, c_mktsegment, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) - 400 AS b
           FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
d AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT d.day, s.c_mktsegment, count(*) FILTER (d.day BETWEEN s.a AND s.b) AS customers FROM s, d GROUP BY ALL"""),
    "keep_best": Direct(keep_best_order, """
SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END
                           NULLS LAST, o_orderkey) = 1""", ("o_totalprice",)),
    "extreme_min_with_ties": Direct(extremes("min"), _EXTREME_SQL.format(how="min")),
    "extreme_max_with_ties": Direct(extremes("max"), _EXTREME_SQL.format(how="max")),
    "semi_in": Direct(semi, f"SELECT * FROM {_NULLABLE} WHERE buyer IN (SELECT member FROM {_MEMBERS})"),
    "exists_flag": Direct(exists, f"SELECT *, coalesce(buyer IN (SELECT member FROM {_MEMBERS} "
                                  f"WHERE member IS NOT NULL), false) AS listed FROM {_NULLABLE}"),
    "not_in": Direct(excluded(_customers_without_null), _excluded_sql(_WITHOUT_NULL)),
    "not_in_list_with_null": Direct(excluded(_nullable_customers), _excluded_sql(_MEMBERS)),
    "not_in_empty_list": Direct(excluded(no_members), _excluded_sql(f"{_WITHOUT_NULL} WHERE c_custkey < 0")),
    "stats_join_left": Direct(joined_stats("left"), _STATS + """
SELECT v.*, p.purchases FROM views v LEFT JOIN purchases p ON p.zone = v.zone AND p.day = v.day"""),
    "stats_join_full": Direct(joined_stats("full"), _STATS + """
SELECT p.*, v.views FROM purchases p FULL JOIN views v ON v.zone = p.zone AND v.day = p.day"""),
    "stack_tagged": Direct(stacked, """
SELECT CASE event_type WHEN 'view' THEN 'browse' ELSE 'buy' END AS part, CAST(ts AS DATE) AS day, count(*) AS events,
       sum(value) AS total FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL""", ("total",)),
    "session_funnel": Direct(event_funnel, _FUNNEL_SQL),
    "conditional_distinct": Direct(conditional_distinct, """
SELECT CAST(ts AS DATE) AS day, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers,
       count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high,
       coalesce(sum(value) FILTER (event_type = 'error'), 0) AS errors, sum(value) FILTER (value > 400) AS large
FROM events GROUP BY 1""", ("low", "high", "errors", "large")),
    "safe_ratio": Direct(safe_ratios, """
SELECT l_suppkey, sum(l_linenumber) / nullif(sum(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_quantity END), 0) AS raw,
       round(sum(l_linenumber) / count(DISTINCT l_orderkey), 2) AS per_order
FROM lineitem GROUP BY l_suppkey""", ("raw", "per_order")),
    "subsidy_split": Direct(subsidies, """
SELECT l_suppkey, sum(a * (1 - s / 100)) AS vendor, sum(a * s / 100) AS platform,
       CAST(count(*) FILTER (a * s > 0 OR a * (100 - s) > 0) AS BIGINT) AS incentivised, sum(abs(a * s / 100)) AS waived
FROM (SELECT l_suppkey, floor(l_extendedprice * l_discount / 100) * 10 AS a,
             CASE WHEN l_quantity <> 7 THEN round(l_tax * 1000) END AS s FROM lineitem)
GROUP BY l_suppkey""", ("vendor", "platform", "waived")),
    "classify_like": Direct(labelled_names, """
SELECT CASE WHEN lower(p_name) LIKE '%ring%' THEN 'ring' WHEN lower(p_name) LIKE 'large%' THEN 'large'
            WHEN lower(p_name) LIKE '%b_lt%' THEN 'bolt' ELSE 'other' END AS label,
       count(*) AS parts, max(p_retailprice) AS dearest FROM part GROUP BY 1""", ("dearest",)),
    "name_blacklist": Direct(allowed_names, """
SELECT p_partkey, upper(p_name) AS name FROM part
WHERE p_partkey % 9 <> 4 AND NOT (p_name LIKE '%ring%' OR p_name LIKE '%hot%' OR p_name LIKE 'large%')"""),
    "clock_columns": Direct(clock_columns, f"""
SELECT event_id, {_LOCAL} AS local_ts, CAST({_LOCAL} AS DATE) AS local_date, CAST(hour({_LOCAL}) AS INTEGER) AS local_hour,
       CAST(minute({_LOCAL}) AS INTEGER) AS local_minute, date_trunc('minute', {_LOCAL}) AS whole_minute,
       date_trunc('hour', {_LOCAL}) AS whole_hour, strftime({_LOCAL}, '%H:%M') AS clock,
       date_diff('second', ts, date_trunc('minute', ts) + INTERVAL 3 MINUTE) AS seconds,
       CAST(CAST({_LOCAL} AS DATE) - 1 - INTERVAL 2 MONTH AS DATE) AS window_start FROM events"""),
    "day_windows": Direct(window_days, f"""
SELECT CAST({_LOCAL} AS DATE) AS day, count(*) AS events FROM events
WHERE CAST({_LOCAL} AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND CAST(ts AS DATE) >= DATE '2024-01-02'
GROUP BY 1"""),
}
