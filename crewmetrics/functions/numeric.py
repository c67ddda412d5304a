"""Ratios, shares and rounding that come out the same in any execution order.

Durations are summed as whole milliseconds. Ratios become doubles once, and rounding goes
through decimals, so no result depends on how partial sums were merged.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_HOUR = 3_600_000
MS_PER_SECOND = 1_000


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def exact(value: Column) -> Column:
    return value.cast("decimal(38,12)")


def round_half_up(value: Column, digits: int) -> Column:
    return F.round(exact(value), digits).cast("double")


def share_rounded(share: Decimal, count: Column) -> Column:
    """round(share * count) as a whole number, halves up."""
    return F.round(F.lit(share) * count.cast("decimal(19,0)"), 0).cast("long")


def share_ceiling(share: Decimal, count: Column) -> Column:
    """ceil(share * count) as a whole number."""
    return F.ceil(F.lit(share) * count.cast("decimal(19,0)")).cast("long")


def hours(millis: Column) -> Column:
    return millis.cast("double") / F.lit(float(MS_PER_HOUR))


def mean_of_rounded(value: Column) -> Column:
    """Mean of values with few decimals; the sum is exact, so the mean is repeatable."""
    fixed = value.cast("decimal(20,5)")
    return ratio(F.sum(fixed), F.count(fixed))
