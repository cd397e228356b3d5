"""Baselines without a model: medians and the value carried forward."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .aggregates import known_keys
from .checks import keys, require_all, require_unique
from .selection import group_quantiles, quantiles


def global_median(train: DataFrame, target: DataFrame, value: str, name: str = "prediction") -> DataFrame:
    """``target`` with the training rows' median."""
    (m,) = quantiles(train, value, [0.5])
    return target.withColumn(name, F.lit(m).cast("double"))


def cell_median(train: DataFrame, target: DataFrame, value: str, cell: Sequence[str], name: str = "prediction") -> DataFrame:
    """``target`` with its cell's training median, or the global one where the cell was
    never seen; ``<name>_filled`` flags those."""
    medians = group_quantiles(known_keys(train, cell), list(cell), value, {"__m": 0.5})
    (whole,) = quantiles(train, value, [0.5])
    out = target.join(medians, list(cell), "left")
    found = F.coalesce(finite(F.col("__m")), F.lit(False))
    return out.withColumn(name, F.when(found, F.col("__m")).otherwise(F.lit(whole))).withColumn(f"{name}_filled", ~found).drop("__m")


def carried_forward(history: DataFrame, target: DataFrame, entity: str | Sequence[str], period: str, value: str, previous: Callable[[Column], Column], name: str = "prediction") -> DataFrame:
    """``target`` with the entity's value of the period before by the calendar, and a
    flag ``<name>_covered``. A gap gives null: nothing is taken from further back. A
    history with two values for one entity and period is an error."""
    key = [*keys(entity), period]
    require_unique(history, key, "history")
    past = history.select(*key, F.col(value).alias(name))
    out = target.withColumn("__p", previous(F.col(period)))
    past = past.withColumnRenamed(period, "__p")
    joined = out.join(past, [*keys(entity), "__p"], "left").drop("__p")
    return joined.withColumn(f"{name}_covered", F.coalesce(finite(F.col(name)), F.lit(False)))


def filled(df: DataFrame, prediction: str, fallback: str, name: str) -> DataFrame:
    """The prediction or, where it is missing, the fallback, with a flag; an error if
    that is missing too."""
    there = F.coalesce(finite(F.col(prediction)), F.lit(False))
    out = df.withColumn(name, F.when(there, F.col(prediction)).otherwise(F.col(fallback))).withColumn(f"{name}_filled", ~there)
    return require_all(out, finite(F.col(name)), "a prediction is missing after the fallback")
