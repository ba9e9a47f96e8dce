"""Unit, scale and period arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_to_long(value: Column) -> Column:
    """Drop the fraction, toward zero."""
    return value.cast("double").cast("bigint")


def scale_truncated(value: Column, rate: float) -> Column:
    """Currency-like scaling: multiply and drop the fraction."""
    return truncate_to_long(value.cast("double") * F.lit(float(rate)))


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (array-library rounding)."""
    factor = float(10 ** digits)
    return F.rint(value.cast("double") * F.lit(factor)) / F.lit(factor)


def rescale_rounded(value: Column, divisor: float, digits: int = 1) -> Column:
    """Divide by a unit (thousands, score range) and round half-even."""
    return round_half_even(value.cast("double") / F.lit(float(divisor)), digits)


def affine(value: Column, slope: float, intercept: float) -> Column:
    return value.cast("double") * F.lit(float(slope)) + F.lit(float(intercept))


def celsius_to_fahrenheit(value: Column, digits: int = 1) -> Column:
    return round_half_even(value.cast("double") * F.lit(9.0) / F.lit(5.0) + F.lit(32.0), digits)


# Parts of a year, and the shares taken when an annual figure is allocated.
PERIODS_PER_YEAR = {"month": 12, "quarter": 4}
PERIOD_SHARE = {"month": 0.9, "quarter": 0.88}
WEEK_FACTOR = 0.9 / 4.33


def allocate_period(annual: Column, period: str, noise: Column | None = None) -> Column:
    """The part of an annual figure that falls into one month, quarter or week."""
    if period == "week":
        part = annual.cast("double") * F.lit(WEEK_FACTOR)
    else:
        part = annual.cast("double") / F.lit(float(PERIODS_PER_YEAR[period])) * F.lit(PERIOD_SHARE[period])
    return truncate_to_long(part * noise if noise is not None else part)


def floor_divide(value: Column, divisor: Column | int) -> Column:
    """Integer division that floors, also for negative values."""
    divisor = F.lit(divisor).cast("bigint") if isinstance(divisor, int) else divisor
    value = value.cast("bigint")
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def midpoint(low: Column, high: Column) -> Column:
    return floor_divide(low.cast("bigint") + high.cast("bigint"), 2)


def clip(value: Column, low, high) -> Column:
    """Limit to [low, high]; null stays null."""
    limited = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), limited)
