"""Generated dates and minutes, gap filling, carrying values forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courierlens.functions.clock import hour_of


def series(start: Column, end: Column, unit: str) -> Column:
    """Array from ``start`` to ``end`` inclusive by one ``unit``; NULL for reversed or open bounds."""
    # ``sequence`` raises on reversed bounds, hence the guard.
    return F.when(start <= end, F.sequence(start, end, F.expr(f"interval 1 {unit}")))


def date_spine(df: DataFrame, start: Column, end: Column, name: str = "date_local") -> DataFrame:
    """Every input row once per day from ``start`` to ``end``."""
    return df.withColumn(name, F.explode(series(start, end, "day")))


def minute_spine(df: DataFrame, start: Column, end: Column, name: str = "minute",
                 keep_empty: bool = False) -> DataFrame:
    """Every input row once per minute from ``start`` to ``end``."""
    unnest = F.explode_outer if keep_empty else F.explode
    return df.withColumn(name, unnest(series(start, end, "minute")))


def densify(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Gap-free (key, minute) rows between each key's own first and last minute.

    A key's range is laid out by day first. The days are dealt to all shuffle partitions, by a
    fixed number because the few rows would otherwise be put into one, and only there are a
    day's minutes spelled out, 1440 at most per row.
    """
    ends = df.groupBy(key).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = date_spine(ends, F.to_date("_first"), F.to_date("_last"), "_day").repartition(partitions, key, "_day")
    midnight = F.col("_day").cast("timestamp_ntz")
    first = F.greatest(F.col("_first"), midnight)
    last = F.least(F.col("_last"), midnight + F.expr("interval 1439 minutes"))
    return minute_spine(days, first, last, ts).select(key, ts)


def fill_forward(df: DataFrame, key: str, ts: str, value: str, name: str | None = None) -> DataFrame:
    """Last non-NULL ``value`` of a key at or before each row.

    Rows that share a timestamp share the largest of their values. The window is cut per
    key and hour, so a key, or one day of a key, that holds a large share of the rows is spread
    over its hours. What an hour inherits comes from a summary with one row per key and hour
    and enters the window as a row ahead of the hour.
    """
    name = name or value
    rows = df.select("*", hour_of(F.col(ts)).alias("_slice"), F.col(value).alias("_value"), F.lit(False).alias("_inherited"))

    latest = F.max(F.when(F.col(value).isNotNull(), F.struct(ts, value)))
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    inherited = (df.groupBy(key, hour_of(F.col(ts)).alias("_slice")).agg(latest.alias("_latest"))
                 .select(key, "_slice", F.last(F.col(f"_latest.{value}"), ignorenulls=True).over(before).alias("_value"),
                         F.lit(True).alias("_inherited"))
                 .filter(F.col("_value").isNotNull()))

    # The frame ends with the row's peers, and the newest known value is the largest pair of time and value in it.
    so_far = W.partitionBy(key, "_slice").orderBy(F.col(ts).asc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    newest = F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(ts).alias("at"), F.col("_value").alias("value")))).over(so_far)
    filled = rows.unionByName(inherited, allowMissingColumns=True).withColumn("_newest", newest).filter(~F.col("_inherited"))
    return filled.select(*[c for c in df.columns if c != name], F.col("_newest.value").alias(name))


def latest_before(df: DataFrame, keys: Sequence[str], ts: str, value: str, first: Column,
                  last: Column) -> DataFrame:
    """Observations folded onto the window [first, last].

    Everything earlier collapses to one row per key, a minute ahead of the window,
    holding the newest known value; everything later to one row a minute behind it.
    One row per key and minute remains, peers resolved to their largest value.
    """
    step = F.expr("interval 1 minute")
    slot = F.greatest(F.least(F.col(ts), last + step), first - step)
    newest = F.max(F.when(F.col(value).isNotNull(), F.struct(ts, value)))
    folded = df.withColumn("_slot", slot).groupBy(*keys, "_slot").agg(newest.alias("_newest"))
    return folded.select(*keys, F.col("_slot").alias(ts), F.col(f"_newest.{value}").alias(value))
