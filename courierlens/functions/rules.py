"""Row rules: name filters, labels, subsidies, flags, lateness."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierlens.functions.clock import seconds_between


def any_like(text: Column, patterns: Iterable[str]) -> Column:
    """Case-folded LIKE against any pattern."""
    return reduce(or_, [F.lower(text).like(p) for p in patterns])


def name_allowed(name: Column, patterns: Iterable[str]) -> Column:
    """Case-folded NOT LIKE against all patterns; a NULL name is not allowed."""
    return reduce(and_, [~F.lower(name).like(p) for p in patterns])


def classify_like(text: Column, labels: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that fits, else ``default``. ``_`` stays a wildcard."""
    (pattern, label), *rest = labels
    out = F.when(F.lower(text).like(pattern), label)
    for pattern, label in rest:
        out = out.when(F.lower(text).like(pattern), label)
    return out.otherwise(default)


def subsidy_split(amount: Column, share_pct: Column) -> tuple[Column, Column]:
    """(vendor part, platform part) of an amount; NULL where an input is NULL."""
    share = share_pct / 100
    return (1 - share) * amount, share * amount


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.when(condition, 1).otherwise(0)


def any_positive(*amounts: Column) -> Column:
    return reduce(or_, [a > 0 for a in amounts])


def floor_zero(amount: Column, digits: int) -> Column:
    """Rounded, negatives become 0, NULL stays NULL."""
    return F.round(F.when(amount < 0, F.lit(0.0)).otherwise(amount), digits)


def fully_platform_funded(share_pct: Column) -> Column:
    """The vendor carries nothing, or the share is unknown."""
    vendor_share = 1 - share_pct / 100
    return (vendor_share == 0) | vendor_share.isNull()


def hours_of(seconds: Column) -> Column:
    return F.round(seconds / 3600, 2)


def lateness_minutes(rider_late: Column, at_vendor: Column, at_vendor_cleaned: Column,
                     scheduled_pickup: Column, picked_up: Column) -> Column:
    """Minutes a vendor held up an order.

    A rider late by under ten minutes who then waited over five counts the cleaned
    waiting time; a punctual rider counts pickup past schedule; all else is NULL.
    """
    waited = (rider_late > 0) & (rider_late < 600) & (at_vendor > 300)
    overdue = (rider_late <= 0) & (picked_up > scheduled_pickup)
    return (F.when(waited, F.round(at_vendor_cleaned / 60, 1))
            .when(overdue, F.round(seconds_between(scheduled_pickup, picked_up) / 60, 1)))


def source_rank(source: Column, priority: Sequence[str]) -> Column:
    """1 for the first named source, 2 for the next, NULL for any other."""
    out = None
    for rank, name in enumerate(priority, start=1):
        hit = source == name
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out


def order_vertical(business_type: Column, restaurant_types: Sequence[str]) -> Column:
    return (F.when(business_type.isin(*restaurant_types), "restaurants")
            .when(business_type == "shops", "shops")
            .when(business_type == "dmart", "dmart"))
