"""Accuracy on the log1p scale, overall and by stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.text import true_false
from .checks import require_all
from .selection import group_quantiles
from .stored import stored

COLUMNS = ["n", "rmsle", "multiple", "mdape", "r2_log", "mae", "mape", "aggregate", "aggregate_corrected"]


def checked(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """``df``, with an error for a truth or prediction that is missing or not finite."""
    return require_all(require_all(df, finite(F.col(truth)), "the target has missing or infinite values"), finite(F.col(prediction)), "predictions have missing or infinite values")


def smearing(df: DataFrame, truth: str, prediction: str) -> float:
    """Duan's factor: the mean of exp(residual). Take it from training rows."""
    r = df.agg(F.avg(F.exp(F.col(truth) - F.col(prediction))).alias("d"), F.count_if(~finite(F.col(truth) - F.col(prediction))).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not r["n"]:
        raise ValueError("no residuals")
    if r["bad"]:
        raise ValueError(f"{r['bad']} residuals are not finite")
    return r["d"]


def retransformed(prediction: Column, duan: Column | float = 1.0) -> Column:
    """A log1p prediction in units: the factor applies before the one is taken off."""
    duan = duan if isinstance(duan, Column) else F.lit(float(duan))
    return F.exp(prediction) * duan - 1


def aggregates(truth: str, prediction: str, duan: float = 1.0) -> list[Column]:
    """The metrics as aggregates of one pass, in the order of COLUMNS but for the median.
    Only the last uses the smearing factor."""
    y, p = F.col(truth), F.col(prediction)
    t = F.expm1(y)
    off = F.abs(F.expm1(p) - t)
    squares = F.sum((y - p) * (y - p))
    rmsle = F.sqrt(F.avg((p - y) * (p - y)))
    spread = F.var_pop(y) * F.count(y)
    return [
        F.count(F.lit(1)).alias("n"),
        rmsle.alias("rmsle"),
        F.exp(rmsle).alias("multiple"),
        F.when(spread > 0, 1 - squares / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(float("nan"))).alias("r2_log"),
        F.avg(off).alias("mae"),
        (100 * F.avg(F.try_divide(off, t))).alias("mape"),
        F.try_divide(F.sum(retransformed(p)), F.sum(t)).alias("aggregate"),
        F.try_divide(F.sum(retransformed(p, duan)), F.sum(t)).alias("aggregate_corrected"),
    ]


def evaluate(df: DataFrame, truth: str, prediction: str, axes: Sequence[str] = (), duan: float = 1.0, whole: tuple[str, str] = ("all", "all")) -> DataFrame:
    """One row for the whole and one for each value of each axis: axis, group, metrics.

    The scored rows are written once. Sums come from a single aggregation: each row is counted under
    the whole and under its value on each axis; medians come by selection
    (``long_quantiles``), so that no task holds the errors of a stratum. A null value is left out of its
    axis but not of the whole. Flags are written True and False. A truth of zero or
    less is an error.
    """
    types = dict(df.dtypes)
    named = lambda a: true_false(F.col(a)) if types[a] == "boolean" else F.col(a).cast("string")
    strata = [F.struct(F.lit(whole[0]).alias("axis"), F.lit(whole[1]).alias("group"))] + [F.struct(F.lit(a).alias("axis"), named(a).alias("group")) for a in axes]
    narrow = stored(checked(df, truth, prediction).select(*dict.fromkeys([truth, prediction, *axes])))
    rows = narrow.select(F.col(truth), F.col(prediction), F.explode(F.array(*strata)).alias("s")).where("s.group is not null")
    t = F.expm1(F.col(truth))
    relative = F.when(t > 0, F.abs(F.expm1(F.col(prediction)) - t) / t)
    found = require_all(rows, t > 0, "a truth is zero or less").groupBy("s.axis", "s.group").agg(*aggregates(truth, prediction, duan))
    medians = group_quantiles(rows.select("s.axis", "s.group", relative.alias("off")), ["axis", "group"], "off", {"mdape": 0.5})
    return found.join(medians.withColumn("mdape", 100 * F.col("mdape")), ["axis", "group"], "left").select("axis", "group", *COLUMNS)


def residuals(df: DataFrame, truth: str, prediction: str, axes: Sequence[str]) -> DataFrame:
    """n, mean and population deviation of the residual (truth less prediction) and mean
    prediction, by each value of each axis."""
    strata = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("group")) for a in axes))).alias("s")
    rest = F.col(truth) - F.col(prediction)
    rows = df.select(rest.alias("r"), F.col(prediction).alias("p"), strata).where("s.group is not null")
    return rows.groupBy("s.axis", "s.group").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.avg("p").alias("mean_prediction"))
