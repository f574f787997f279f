"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierlens.params import Params

#: Bits of a digit of an exact sum, and the exponents of its digits: amounts below 2**71 by steps of 2**-72.
DIGIT_BITS = 24
DIGITS = (48, 24, 0, -24, -48, -72)


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """Quotient, NULL where the denominator is 0 or NULL."""
    out = F.try_divide(numerator, denominator)
    return out if digits is None else F.round(out, digits)


def distinct_if(condition: Column, value: Column) -> Column:
    """Distinct non-NULL values among the rows that meet a condition."""
    return F.count_distinct(F.when(condition, value))


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows, bit for bit.

    Every value is split without error into digits of 24 bits, whole numbers from -2**23 to 2**23, which are
    added as such; the digits' sums are put together once. What lies below 2**-72 is rounded per value.
    Values of 2**71 and more, infinite ones and NaN are added as doubles. NULL if all values are.
    """
    inside = F.abs(value) < float(2**71)
    own = F.when(inside, value.cast("double"))

    def rounded(exponent: int) -> Column:
        # Scaling by a power of two is exact, and so is the difference of two neighbouring roundings.
        return F.rint(own * F.lit(2.0 ** -exponent))

    out = F.lit(0.0)
    for exponent in DIGITS:
        digit = rounded(exponent)
        if exponent != DIGITS[0]:
            digit = digit - rounded(exponent + DIGIT_BITS) * float(2**DIGIT_BITS)
        out = out + F.sum(F.coalesce(digit, F.lit(0.0)).cast("long")).cast("double") * F.lit(2.0 ** exponent)
    beyond = F.coalesce(F.sum(F.when(~inside, value.cast("double"))), F.lit(0.0))
    return F.when(F.count(value) > 0, out + beyond)


def total(value: Column, params: Params) -> Column:
    """Sum of amounts; one that does not depend on the order of the rows if ``params`` asks for it."""
    return exact_sum(value) if params.exact_sums else F.sum(value)


def sum_or_zero(value: Column) -> Column:
    """Sum with NULL rows taken as 0 (so never NULL for a group with rows)."""
    return F.sum(F.coalesce(value, F.lit(0.0)))


def ever(condition: Column) -> Column:
    """True if any row of the group meets the condition; unknown counts as false."""
    return F.max(F.coalesce(condition, F.lit(False)))


def without_ads(profit: Column, ads: Column, subscriptions: Column) -> Column:
    return profit - F.coalesce(ads, F.lit(0.0)) - F.coalesce(subscriptions, F.lit(0.0))
