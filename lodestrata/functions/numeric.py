"""Guarded arithmetic. NaN counts as missing: ``clean`` turns it into null on the way in."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """The number, with null for NaN."""
    return F.when(~F.isnan(c), c)


def clean_frame(df: DataFrame) -> DataFrame:
    """All floating-point columns with null for NaN."""
    return df.select(*(clean(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes))


def finite(c: Column) -> Column:
    """Whether a number is there and is neither NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def row_sum(columns: Iterable[Column]) -> Column:
    """The sum over a row's columns, missing ones counting as zero."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where the whole is zero or missing."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    """The number, or the bound that it passes; null stays null (``least`` would skip it)."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def per_unit(c: Column, amount: Column, unit: float) -> Column:
    """A counter for each ``unit`` of ``amount``; null where there is none."""
    return c / F.nullif(amount / F.lit(float(unit)), F.lit(0.0))


def percent_growth(log_difference: Column) -> Column:
    return F.lit(100.0) * F.expm1(log_difference)


def rounds_to(c: Column, value: float, digits: int = 6) -> Column:
    return F.round(c, digits) == F.lit(value)


def binned(c: Column, edges: list[float], right: bool = False) -> Column:
    """Number of the bin that holds a value: [a, b), or (a, b] if ``right``.

    Null outside of all bins."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        low, high = F.lit(float(edges[i - 1])), F.lit(float(edges[i]))
        inside = (c > low) & (c <= high) if right else (c >= low) & (c < high)
        out = F.when(inside, i - 1).otherwise(out)
    return out


def deflated(value: Column, factor: Column) -> Column:
    return value / factor


def nominal(log_real: Column, factor: Column) -> Column:
    """A log1p prediction in deflated money back on the nominal log1p scale."""
    return F.log1p(F.expm1(log_real) * factor)


def skew_g1(population: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population value; null below three values."""
    n = n.cast("double")
    return F.when(n > 2, population * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis_g2(population: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * population + 6))
