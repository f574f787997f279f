"""Wall-clock arithmetic on TIMESTAMP_NTZ columns, free of any session time zone."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierlens.params import Params


def at(moment: date | datetime) -> Column:
    """A TIMESTAMP_NTZ literal."""
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def shift(ts: Column, *, hours: int = 0, minutes: int = 0) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes))


def to_local(ts: Column, hours: int) -> Column:
    """UTC to local time by a fixed offset."""
    return shift(ts, hours=hours)


def second_of(ts: Column) -> Column:
    """Truncated to the whole second."""
    return _without(ts, F.lit(0), F.extract(F.lit("SECOND"), ts) % 1)


def minute_of(ts: Column) -> Column:
    """Truncated to the minute, still TIMESTAMP_NTZ (``date_trunc`` would return an instant)."""
    return _without(ts, F.lit(0), F.extract(F.lit("SECOND"), ts))


def hour_of(ts: Column) -> Column:
    """Truncated to the hour, still TIMESTAMP_NTZ."""
    return _without(ts, F.minute(ts), F.extract(F.lit("SECOND"), ts))


def _without(ts: Column, minutes: Column, seconds: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), minutes, seconds)


def clock_text(ts: Column) -> Column:
    """24-hour ``HH:mm``."""
    return F.date_format(ts, "HH:mm")


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed from ``start`` to ``end``."""
    return F.timestamp_diff("SECOND", second_of(start), second_of(end))


def on_or_after(ts: Column, day: date) -> Column:
    """``date(ts) >= day`` as a bound on the raw column, so the scan can use it."""
    return ts >= at(day)


def day_between(ts: Column, first: date, last: date) -> Column:
    """``date(ts) between first and last`` as bounds on the raw column."""
    return (ts >= at(first)) & (ts < at(last + timedelta(days=1)))


def local_day_between(utc: Column, hours: int, first: date, last: date) -> Column:
    """The same for the local date of a UTC column: the bounds move, not the column."""
    back = timedelta(hours=hours)
    low = datetime(first.year, first.month, first.day) - back
    high = datetime(last.year, last.month, last.day) + timedelta(days=1) - back
    return (utc >= at(low)) & (utc < at(high))


def lookback(day: Column, params: Params) -> Column:
    """A DATE column within the rolling window that ends yesterday."""
    return day.between(F.lit(params.lookback_start), F.lit(params.last_day))
