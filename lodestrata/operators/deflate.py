"""Deflation by a chained index of constant composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import known_keys, weighted_mean
from .checks import require_all
from .relational import consecutive


def chained_index(train: DataFrame, period: str, cell: Sequence[str], value: str, least: int = 20) -> DataFrame:
    """(period, factor): the first period is 1.

    From one period to the next, cells with ``least`` rows on both sides add
    the change of their mean log value, weighted by their earlier rows; without
    such a cell nothing changes. Only cells meet in the joins, never rows.
    """
    cells = known_keys(train, [period, *cell]).groupBy(period, *cell).agg(F.avg(F.log(value)).alias("m"), F.count(F.lit(1)).alias("n"))
    steps = consecutive(train, period)
    a = cells.select(F.col(period).alias("earlier"), *cell, F.col("m").alias("ma"), F.col("n").alias("na"))
    b = cells.select(F.col(period).alias("later"), *cell, F.col("m").alias("mb"), F.col("n").alias("nb"))
    both = steps.join(a, "earlier").join(b, ["later", *cell]).where((F.col("na") >= least) & (F.col("nb") >= least))
    change = both.groupBy("later").agg(weighted_mean(F.col("mb") - F.col("ma"), F.col("na")).alias("change"))
    periods = train.where(F.col(period).isNotNull()).select(period).distinct()
    chained = periods.join(change.withColumnRenamed("later", period), period, "left").fillna(0.0, ["change"])
    upto = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return chained.select(period, F.exp(F.sum("change").over(upto)).alias("factor"))


def extended_index(index: DataFrame, periods: DataFrame, period: str) -> DataFrame:
    """A factor for every period; those that the index lacks get its last one."""
    last = index.agg(F.max_by("factor", period).alias("last"))
    wanted = periods.where(F.col(period).isNotNull()).select(period).distinct()
    return wanted.join(index, period, "left").join(last, F.lit(True)).select(period, F.coalesce("factor", "last").alias("factor"))


def deflate(df: DataFrame, index: DataFrame, period: str, value: str) -> DataFrame:
    """``df`` with factor, real value and the logs of both; values must be positive.

    The factor goes by period alone, also for rows of a held-out domain."""
    out = df.join(index, period, "left").withColumn("real", F.col(value) / F.col("factor"))
    out = require_all(out, (F.col(value) > 0) & F.col("factor").isNotNull(), "a value is not positive or has no factor")
    return out.withColumns({"log_value": F.log1p(value), "log_real": F.log1p("real")})
