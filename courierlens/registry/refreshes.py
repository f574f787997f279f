"""The rolling results built in two refreshes, the second one over late and corrected rows.

The derived input tables are stored by day. The first delivery lacks some rows and has others wrong;
the second one replaces the days that hold such rows. What the two refreshes of the states lead to
must be what the results are over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.params import Params
from courierlens.plans import rolling
from courierlens.plans.rolling import STATES
from courierlens.plans.shrink_conversion import daily_conversion_by_shrink
from courierlens.plans.surge_conversion import daily_conversion_by_surge
from courierlens.sources.catalog import Catalog
from courierlens.sources.day_states import DayStates
from courierlens.sources.session import shared_folder

#: Tables with late or corrected rows: the id that says which, and what the first delivery has instead.
CORRECTIONS: dict[str, tuple[str, str, str]] = {
    "sessions": ("ga_session_id", "is_transaction", "NOT coalesce(is_transaction, false)"),
    "session_verticals": ("ga_session_id", "has_restaurants_impression", "NOT coalesce(has_restaurants_impression, false)"),
    "order_discounts": ("uuid", "platform_share_pct", "100 - platform_share_pct"),
    "order_profit": ("order_code", "gpo_excl_wastage", "gpo_excl_wastage * 2 + 1"),
}


def late(table: str) -> Column:
    """Rows that the first delivery lacks: some of every fifth day's."""
    chosen = (F.dayofmonth(STATES[table].day) % 5 == 0) & (F.crc32(F.col(CORRECTIONS[table][0]).cast("string")) % 3 == 0)
    return F.coalesce(chosen, F.lit(False))


def corrected(table: str) -> Column:
    """Rows that the first delivery has wrong: some of every seventh day's."""
    chosen = (F.dayofmonth(STATES[table].day) % 7 == 3) & (F.crc32(F.col(CORRECTIONS[table][0]).cast("string")) % 4 == 0)
    return F.coalesce(chosen, F.lit(False))


def first_delivery(catalog: Catalog, table: str) -> DataFrame:
    rows = catalog[table]
    if table not in CORRECTIONS:
        return rows
    _, column, wrong = CORRECTIONS[table]
    return rows.filter(~late(table)).withColumn(column, F.when(corrected(table), F.expr(wrong)).otherwise(F.col(column)))


def stored(catalog: Catalog, folder: str) -> Catalog:
    """The tables that are kept by day, as they are stored now; the others as they are given."""
    spark = catalog["sessions"].sparkSession
    return Catalog(lambda name: spark.read.parquet(f"{folder}/{name}") if name in STATES else catalog[name])


def write_days(rows: DataFrame, folder: str, table: str) -> None:
    """Stores a table by day, in place of the days that it has rows of."""
    (rows.write.partitionBy(STATES[table].day).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .parquet(f"{folder}/{table}"))


def twice_refreshed(catalog: Catalog, params: Params) -> tuple[DayStates, Catalog]:
    """States after both deliveries, and the tables behind them."""
    spark = catalog["sessions"].sparkSession
    folder = shared_folder(spark, "rolling-input")
    for table in STATES:
        write_days(first_delivery(catalog, table), folder, table)
    states, tables = DayStates.create(spark, shared_folder(spark, "rolling-states")), stored(catalog, folder)
    rolling.refresh(states, tables, params, rolling.changed_days({table: tables[table] for table in STATES}))

    news = {table: catalog[table].filter(late(table) | corrected(table)) for table in CORRECTIONS}
    days = rolling.changed_days(news)
    for table in CORRECTIONS:
        write_days(catalog[table].filter(F.col(STATES[table].day).isin(sorted(days))), folder, table)
    tables = stored(catalog, folder)
    rolling.refresh(states, tables, params, days)
    return states, tables


def surge_refreshed(catalog: Catalog, params: Params) -> DataFrame:
    states, tables = twice_refreshed(catalog, params)
    return daily_conversion_by_surge(tables, params, rolling.window_facts(states, tables, params))


def shrink_refreshed(catalog: Catalog, params: Params) -> DataFrame:
    states, tables = twice_refreshed(catalog, params)
    return daily_conversion_by_shrink(tables, params, rolling.window_facts(states, tables, params))
