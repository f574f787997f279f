"""Intervals on the minute axis: overlap counts, validity, attribution of facts.

All of them work on (key, day) pieces, so a key that holds a large share of the
rows is spread over its days and a piece list stays within the minutes of a day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courierlens.functions.clock import hour_of, minute_of
from courierlens.operators.spines import series

_MINUTE = "interval 1 minute"


def split_by_day(df: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Cut inclusive minute spans at midnight; reversed or open spans vanish."""
    days = series(F.to_date(start), F.to_date(end), "day")
    midnight = F.col(day).cast("timestamp_ntz")
    return (df.filter(F.col(start) <= F.col(end))
            .withColumn(day, F.explode(days))
            .withColumn(start, F.greatest(F.col(start), midnight))
            .withColumn(end, F.least(F.col(end), midnight + F.expr("interval 1439 minutes"))))


def cut_to_days(spans: DataFrame, days: DataFrame, on: Mapping[str, str], start: str, end: str, day: str = "day") -> DataFrame:
    """``split_by_day`` onto the days that ``days`` lists, one row per key and day.

    ``on`` maps span columns to columns of ``days``. A span that is open for centuries costs
    no more than the days there are.
    """
    listed = days.select(*[F.col(theirs).alias(f"_of_{theirs}") for theirs in on.values()], F.col(day).alias("_listed"))
    midnight = F.col("_listed").cast("timestamp_ntz")
    # Bounded above and below by whole days, so that NULL bounds match nothing.
    held = (F.col("_listed") >= F.to_date(start)) & (F.col("_listed") <= F.to_date(end))
    for mine, theirs in on.items():
        held = held & (F.col(mine) == F.col(f"_of_{theirs}"))
    return (spans.filter(F.col(start) <= F.col(end)).join(listed, held)
            .withColumn(start, F.greatest(F.col(start), midnight))
            .withColumn(end, F.least(F.col(end), midnight + F.expr("interval 1439 minutes")))
            .select(*spans.columns, F.col("_listed").alias(day)))


def coverage_segments(spans: DataFrame, keys: Sequence[str], start: str, end: str, count: str = "covering",
                      days: DataFrame | None = None, on: Mapping[str, str] | None = None) -> DataFrame:
    """How many spans cover each minute, as disjoint segments per key and day.

    A span adds +1 where it starts and -1 behind its end; a running sum per day turns
    the netted steps into segments. However many spans pile up on one key, a day holds
    at most one step per minute. With ``days``, spans count only on the days listed there
    for their key (``on`` as in ``cut_to_days``), however long they are.
    """
    given = spans.select(*keys, start, end)
    cut = split_by_day(given, start, end) if days is None else cut_to_days(given, days, on, start, end)
    step = F.expr(_MINUTE)
    steps = F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("step")),
        F.struct((F.col(end) + step).alias("at"), F.lit(-1).alias("step")),
    ))
    netted = (cut.select(*keys, "day", steps.alias("s"))
              .groupBy(*keys, "day", F.col("s.at").alias("_at")).agg(F.sum("s.step").alias("_step"))
              .filter(F.col("_step") != 0))
    along = W.partitionBy(*keys, "day").orderBy("_at")
    running = F.sum("_step").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (netted.withColumn(count, running)
            .withColumn("_until", F.lead("_at").over(along))
            .filter(F.col(count) > 0)
            .select(*keys, "day", F.col("_at").alias(start), (F.col("_until") - step).alias(end), count))


def validity_intervals(df: DataFrame, key: str, ts: str, value: str, start: str = "start_minute",
                       end: str = "end_minute") -> DataFrame:
    """From when to when each known value holds, cut per day.

    Equal to a gap-free minute spine with the value carried forward, without the
    spine. Expects one row per key and minute; rows with a NULL value only extend the
    key's last minute, at which its last interval closes. Rows without key or minute
    are left out, stated here so that both uses of ``df`` share one plan and shuffle.
    """
    rows = (df.select(key, ts, value, F.to_date(ts).alias("_day"))
            .filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col("_day").isNotNull()))
    known = F.col(value).isNotNull()
    per_day = rows.groupBy(key, "_day").agg(
        F.min(F.when(known, F.col(ts))).alias("_first"), F.max(ts).alias("_last"))
    of_key = W.partitionBy(key)
    later = of_key.orderBy("_day").rowsBetween(1, W.unboundedFollowing)
    step = F.expr(_MINUTE)
    closing = per_day.select(
        F.col(key).alias("_k"), F.col("_day").alias("_d"),
        F.coalesce(F.first("_first", ignorenulls=True).over(later) - step,
                   F.max("_last").over(of_key)).alias("_close"))

    in_day = W.partitionBy(key, "_day").orderBy(ts)
    held = rows.filter(known).withColumn("_next", F.lead(ts).over(in_day) - step)
    joined = held.join(closing, (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")))
    spans = joined.select(key, F.col(ts).alias(start),
                          F.coalesce("_next", "_close").alias(end), value)
    return split_by_day(spans, start, end)


def attribute_minute(facts: DataFrame, segments: DataFrame, on: Mapping[str, str], ts: Column,
                     start: str, end: str, carry: Sequence[str]) -> DataFrame:
    """Left join of facts to the segments that hold their minute.

    ``on`` maps fact columns to segment columns. ``segments`` lie within one day (see
    above); they are listed once per hour they touch, so the join key is (key, hour)
    and only the minutes of an hour are compared.
    """
    mine = facts.withColumn("_minute", minute_of(ts)).withColumn("_hour", hour_of(ts))
    hours = series(hour_of(F.col(start)), hour_of(F.col(end)), "hour")
    theirs = segments.select(
        *[F.col(c).alias(f"_on_{c}") for c in on.values()],
        F.col(start).alias("_from"), F.col(end).alias("_to"), *carry,
        F.explode(hours).alias("_slot"))
    condition = (F.col("_hour") == F.col("_slot")) & F.col("_minute").between(F.col("_from"), F.col("_to"))
    for fact_column, segment_column in on.items():
        condition = condition & (F.col(fact_column) == F.col(f"_on_{segment_column}"))
    return mine.join(theirs, condition, "left").select(*facts.columns, *carry)


def active_count(spans: DataFrame, key: str, start: str, end: str, first: date, last: date,
                 day: str = "date_local", name: str = "active") -> DataFrame:
    """Spans in force per key and day, zero days included.

    Same step-and-running-sum idea on the day axis, in one pass over the spans: cost
    grows with spans plus keys x days, not spans x days. Every span also leaves an empty
    step on the first day, so a key that is never active still gets its days.
    """
    low, high = F.lit(first), F.lit(last)
    live = (F.col(start) <= F.col(end)) & (F.col(start) <= high) & (F.col(end) >= low)
    ends = live & (F.col(end) < high)

    def step(at: Column, size: Column) -> Column:
        return F.struct(at.alias("at"), size.alias("size"))

    steps = F.explode(F.array(
        step(low, F.lit(0)),
        step(F.when(live, F.greatest(F.col(start), low)).otherwise(low), F.when(live, 1).otherwise(0)),
        step(F.when(ends, F.date_add(end, 1)).otherwise(low), F.when(ends, -1).otherwise(0)),
    ))
    netted = (spans.select(key, steps.alias("s"))
              .groupBy(key, F.col("s.at").alias("_at")).agg(F.sum("s.size").alias("_size")))
    along = W.partitionBy(key).orderBy("_at")
    running = F.sum("_size").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    held = netted.select(key, "_at", running.alias(name), F.lead("_at").over(along).alias("_next"))
    days = series(F.col("_at"), F.coalesce(F.date_sub("_next", 1), high), "day")
    return held.select(F.explode(days).alias(day), key, name)
