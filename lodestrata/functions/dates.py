"""Dates and periods. Invalid dates become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def birth_date(match: Column, age: Column) -> Column:
    """Birth date from a match date and an age "years-days": days are taken off first,
    then years. A 29 February that the birth year lacks gives null."""
    parts = F.split(age, "-")
    years, days = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    day = F.date_sub(match.cast("date"), days)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(day) - years, F.month(day), F.dayofmonth(day)), "yyyy-MM-dd")


def age_in_june(year: Column, birth: Column) -> Column:
    """Completed years on 30 June of ``year``."""
    return year - F.year(birth) - F.when(F.month(birth) > 6, 1).otherwise(0)


def season_end(season: Column) -> Column:
    """The second year of a season "2020-2021"."""
    return F.right(season, F.lit(4)).cast("int")


def previous_season(season: Column) -> Column:
    """The calendar year before, whether or not the data has it."""
    start = F.substring(season, 1, 4).cast("int")
    return F.concat_ws("-", (start - 1).cast("string"), start.cast("string"))


def previous_year(year: Column) -> Column:
    return year - 1


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def is_far(a: Column, b: Column, most: int) -> Column:
    """More than ``most`` days apart; false where either is unknown."""
    return F.coalesce(days_apart(a, b) > most, F.lit(False))


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
