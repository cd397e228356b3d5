"""Checks of keys, columns and rows. A failed check raises ValueError."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"one_to_one": (True, True), "one_to_many": (True, False), "many_to_one": (False, True), "many_to_many": (False, False)}


def keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def repeated(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys(on)).count().where("count > 1")


def require_unique(df: DataFrame, on: str | Sequence[str], what: str = "table") -> DataFrame:
    """``df``, if no key repeats in it."""
    if worst := repeated(df, on).take(1):
        raise ValueError(f"{what}: the key {keys(on)} repeats, as in {worst[0].asDict()}")
    return df


def key_profile(df: DataFrame, on: str | Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the most frequent key), in one pass."""
    r = df.groupBy(*keys(on)).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    return r["n"], r["most"]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in this order."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*names)


def require_all(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """``df``, with an error when a row that fails the condition is read (null fails).

    The check rides along with the query, so it costs no pass of its own."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def require_same_count(a: DataFrame, b: DataFrame, what: str) -> None:
    if (n := a.count()) != (m := b.count()):
        raise ValueError(f"{what}: {n} and {m} rows")


def checked_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join that raises when a side's key repeats against ``validate``."""
    if validate not in KINDS:
        raise ValueError(f"validate is one of {sorted(KINDS)}")
    for df, unique, side in zip((left, right), KINDS[validate], ("left", "right"), strict=True):
        if unique:
            require_unique(df, on, f"{side} side of a {validate} join")
    return left.join(right, keys(on), how)
