"""Numeric and formatting functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalloom import fixed_values as V


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round halves toward positive infinity (``-2.5`` becomes ``-2``)."""
    scale = 10.0**digits
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def is_finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def num_or_zero(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(is_finite(number), number).otherwise(F.lit(0.0))


def per_unit_price(price: Column, units: Column) -> Column:
    """Bundle price per unit; no or zero units count as one."""
    return price / F.coalesce(F.nullif(units.cast("double"), F.lit(0.0)), F.lit(1.0))


def is_real_price(price: Column) -> Column:
    """Above the plausible minimum and not the marketplace's placeholder."""
    return F.coalesce((price > V.MIN_PLAUSIBLE_RATE) & (price != V.PLACEHOLDER_PRICE), F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """Plain decimal text, without thousands separators."""
    return F.format_string(f"%.{digits}f", round_half_up(value.cast("double"), digits))


def format_rate(low: Column, high: Column) -> Column:
    single = F.concat(F.lit("$"), fixed(low, 2), F.lit("/hr"))
    span = F.concat(F.lit("$"), fixed(low, 2), F.lit(" – $"), fixed(high, 2), F.lit("/hr"))
    return F.when(F.abs(high - low) < 0.01, single).otherwise(span)


def format_views(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 1_000, F.concat(fixed(n / 1e3, 1), F.lit("K")))
        .otherwise(n.cast("bigint").cast("string"))
    )
