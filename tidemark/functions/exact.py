"""Exact arithmetic: ratios rounded half up, money in integer cents, order-independent means.

Doubles round differently between engines and sum differently between runs, so counts and
money stay integers until one last division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def exact_ratio(num: Column, den: Column, digits: int, *, percent: bool = False) -> Column:
    """``num / den`` rounded half up to ``digits`` decimals; NULL where ``den`` is 0.

    Counts only: ``num >= 0`` and ``2 * num * 10**(digits + 2)`` must fit a bigint.
    """
    scale = 10 ** (digits + (2 if percent else 0))
    num, den = num.cast("bigint"), F.nullif(den.cast("bigint"), F.lit(0).cast("bigint"))
    return int_div(F.lit(2 * scale) * num + den, F.lit(2) * den) / F.lit(float(10**digits))


def exact_ratio_wide(num: Column, den: Column, digits: int, *, percent: bool = False) -> Column:
    """As :func:`exact_ratio` for money: 38 digits inside, and a negative ``num`` rounds on its magnitude."""
    scale = 10 ** (digits + (2 if percent else 0))
    num, den = num.cast(WIDE), F.nullif(den.cast(WIDE), F.lit(0).cast(WIDE))
    twice = F.lit(2).cast("decimal(1,0)") * den
    rounded = int_div(F.lit(2 * scale).cast("decimal(12,0)") * F.abs(num) + den, twice)
    return F.when(num < 0, -rounded).otherwise(rounded) / F.lit(float(10**digits))


def product(a: Column, b: Column) -> Column:
    return (a.cast("decimal(20,0)") * b.cast("decimal(18,0)")).cast(WIDE)


def value_midpoint(lo: Column, hi: Column) -> Column:
    """Mean of the two ends, or the one that is present, or NULL. One decimal more than the ends."""
    half = F.lit("0.5").cast("decimal(2,1)")
    return (
        F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) * half)
        .otherwise(F.coalesce(lo, hi))
        .cast("decimal(19,3)")
    )


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def half_cents(midpoint: Column) -> Column:
    """A midpoint as an integer number of half-cents."""
    return (midpoint * 200).cast("bigint")


def mean_units(units: Column, per_unit: int) -> Column:
    """Aggregate: mean of an integer column holding ``per_unit`` units per whole, ignoring NULLs."""
    n = F.nullif(F.count(units), F.lit(0).cast("bigint"))
    return F.sum(units).cast("double") / (n * F.lit(per_unit)).cast("double")


def mean_exact(value: Column, digits: int = 4) -> Column:
    """Aggregate: mean of a double column through fixed point, so that the order of rows cannot change it."""
    units = F.floor(value * F.lit(float(10**digits)) + F.lit(0.5)).cast("bigint")
    return mean_units(units, 10**digits)
