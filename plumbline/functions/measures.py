"""Measures: aggregate columns that follow the modelling-language conventions for empty input.

A measure is an ordinary Spark ``Column``, so arithmetic between measures is column arithmetic and
every function of ``pyspark.sql.functions`` can be used beside the ones here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Measure = Callable[[Column], Column]


def _sum(c: Column) -> Column:
    """Sum of doubles, whole parts and fractions apart.

    Whole parts add up exactly below 2^53, so that hundredths stay right where a plain sum of many rows would lose them
    and depend on the order of the rows.
    """
    v = c.try_cast("double")
    whole = F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
    fraction = F.when(F.abs(v) < 2.0**53, v - whole).otherwise(F.when(v.isNotNull(), F.lit(0.0)))
    return F.sum(whole) + F.sum(fraction)


def total(c: Column) -> Column:
    """Sum; 0 for no rows."""
    return F.coalesce(_sum(c), F.lit(0.0))


def average(c: Column) -> Column:
    """Mean; 0 for no rows."""
    return F.coalesce(_sum(c) / F.nullif(F.count(c.try_cast("double")), F.lit(0)), F.lit(0.0))


def minimum(c: Column) -> Column:
    """Smallest number; 0 for no rows."""
    return F.coalesce(F.min(c.try_cast("double")), F.lit(0.0))


def maximum(c: Column) -> Column:
    """Largest number; 0 for no rows."""
    return F.coalesce(F.max(c.try_cast("double")), F.lit(0.0))


def count(c: Column) -> Column:
    """Number of non-null values, of any type."""
    return F.count(c)


def distinct_count(c: Column) -> Column:
    """Number of different non-null values."""
    return F.count_distinct(c)


def row_count() -> Column:
    """Number of rows in the current group."""
    return F.count(F.lit(1))


def divide(numerator: Column, denominator: Column, alternate: float = 0.0) -> Column:
    """Quotient, or ``alternate`` where the denominator is (nearly) zero or missing."""
    near_zero = F.coalesce(F.abs(denominator) < 1e-12, F.lit(True))
    return F.when(near_zero, F.lit(float(alternate))).otherwise(
        numerator.cast("double") / F.when(~near_zero, denominator.cast("double"))
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Plain ``/`` between measures: null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def calculate(measure: Measure, c: Column, *filters: Column) -> Column:
    """``measure`` over the rows of the group that pass every filter.

    A filtered aggregate keeps the group context and adds no pass: several calculations with
    different filters share one scan.
    """
    keep = filters[0]
    for condition in filters[1:]:
        keep = keep & condition
    return measure(F.when(keep, c))
