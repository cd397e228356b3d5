"""How sure an evaluation is: bootstrap intervals of gaps between groups, conformal intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import checked
from .selection import long_quantiles
from .stored import stored

#: A 32-bit number draws as many as there are of these it reaches: the distribution function of
#: a Poisson variable of mean one, times 2^32.
POISSON = [math.floor(2**32 * math.exp(-1) * math.fsum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def strata(df: DataFrame, axes: Sequence[str], whole: bool) -> Column:
    """A row's places, (axis, group) each; one for each axis and, if wanted, one for the whole."""
    places = [F.struct(F.lit("all").alias("axis"), F.lit("all").alias("group"))] * whole
    return F.array(*places, *(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("group")) for a in axes))


def poisson_weights(key: Column, replicates: int, seed: int = 1) -> Column:
    """An array of (replicate, weight) of a row, weights of zero left out.

    Weights are Poisson draws of mean one from a hash of ``key`` and the replicate, so they
    are the same in any partitioning and on any rerun. One MD5 serves four replicates."""
    digest = lambda block: F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit("#"), block.cast("string")).cast("binary"))

    def weight(u: Column) -> Column:
        out = F.when(u < POISSON[0], 0)
        for k, upto in enumerate(POISSON[1:], 1):
            out = out.when(u < upto, k)
        return out.otherwise(len(POISSON))

    def drawn(block: Column) -> Column:
        hex_ = digest(block)
        numbers = [F.conv(F.substring(hex_, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
        return F.array(*(F.struct((4 * block + i).cast("int").alias("replicate"), weight(u).alias("weight")) for i, u in enumerate(numbers)))

    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))
    return F.filter(F.flatten(F.transform(blocks, drawn)), lambda x: (x["weight"] > 0) & (x["replicate"] < replicates))


def bootstrap_gaps(df: DataFrame, truth: str, prediction: str, axes: Sequence[str], key: Sequence[str], replicates: int = 200, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """Per axis and group: n, ``gap`` (its RMSLE less that of all other rows of the axis) and ``bias``
    (its mean residual less theirs), each with a bootstrap interval of level 1 - ``alpha``,
    and the number of replicates behind it.

    A replicate gives every row a Poisson weight instead of drawing rows anew: no resampled
    copy is made, and one aggregation sums all replicates, combined in map tasks to a row for each group and
    replicate. Rows of equal ``key`` get equal weights. A null group is left out of its
    axis. A replicate in which a group, or all beside it, has no row is left out of
    the group's interval; a group that is the whole axis has none.
    """
    scored = checked(df, truth, prediction).select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)).alias("key"), (F.col(prediction) - F.col(truth)).alias("off"), F.explode(strata(df, axes, False)).alias("s"))
    scored = scored.where("s.group is not null")
    weighted = scored.select("s.axis", "s.group", "off", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("replicate"), F.lit(1).alias("weight"))), poisson_weights(F.col("key"), replicates, seed))).alias("w"))
    w = F.col("w.weight")
    sums = weighted.groupBy("axis", "group", "w.replicate").agg(F.sum(w).alias("n"), F.sum(w * F.col("off") * F.col("off")).alias("squares"), F.sum(w * F.col("off")).alias("total"))
    of_axis = Window.partitionBy("axis", "replicate")
    rest = {c: F.sum(c).over(of_axis) - F.col(c) for c in ("n", "squares", "total")}
    each = sums.select("axis", "group", "replicate", "n", "squares", "total", *(v.alias(f"rest_{c}") for c, v in rest.items())).where("rest_n > 0")
    rmsle = lambda squares, n: F.sqrt(F.greatest(F.col(squares), F.lit(0.0)) / F.col(n))
    each = stored(each.select("axis", "group", "replicate", "n", (rmsle("squares", "n") - rmsle("rest_squares", "rest_n")).alias("gap"), (F.col("rest_total") / F.col("rest_n") - F.col("total") / F.col("n")).alias("bias")))
    ends = long_quantiles(each.where("replicate >= 0"), ["axis", "group"], ["gap", "bias"], [alpha / 2, 1 - alpha / 2])
    names = [F.max(F.when(F.col("feature") == c, F.col("q")[i])).alias(f"{c}_{end}") for c in ("gap", "bias") for i, end in enumerate(("low", "high"))]
    counts = each.where("replicate >= 0").groupBy("axis", "group").agg(F.count(F.lit(1)).alias("replicates"))
    point = each.where("replicate = -1").select("axis", "group", "n", "gap", "bias")
    out = point.join(ends.groupBy("axis", "group").agg(*names), ["axis", "group"], "left").join(counts, ["axis", "group"], "left")
    return out.select("axis", "group", "n", "gap", "gap_low", "gap_high", "bias", "bias_low", "bias_high", F.coalesce("replicates", F.lit(0)).alias("replicates"))


def conformal_widths(calibration: DataFrame, truth: str, prediction: str, axes: Sequence[str] = (), alphas: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """(axis, group, alpha, n_calibration, width): half the width of split-conformal intervals, for the
    whole and by group of each axis (Mondrian).

    It is the ceil((n + 1)(1 - alpha))-th smallest absolute residual of the group's calibration
    rows: a new exchangeable row lies within with a probability of 1 - alpha at least. A group too small for that
    rank has no bounded interval: its width is null.
    """
    rows = checked(calibration, truth, prediction).select(F.abs(F.col(truth) - F.col(prediction)).alias("score"), F.explode(strata(calibration, axes, True)).alias("s")).where("s.group is not null").select("s.axis", "s.group", "score")
    # In whole thousandths, so that no rounding moves a rank.
    rank = lambda n, a: F.ceil((n + 1) * F.lit(round(1000 * (1 - a))) / 1000)
    q = long_quantiles(rows, ["axis", "group"], ["score"], places=lambda n: [F.least(rank(n, a), n).cast("double") - 1 for a in alphas])
    sizes = rows.groupBy("axis", "group").agg(F.count(F.lit(1)).alias("n_calibration"))
    each = F.array(*(F.struct(F.lit(a).alias("alpha"), F.when(rank(F.col("n_calibration"), a) <= F.col("n_calibration"), F.col("q")[i]).alias("width")) for i, a in enumerate(alphas)))
    return q.join(sizes, ["axis", "group"]).select("axis", "group", "n_calibration", F.explode(each).alias("e")).select("axis", "group", "e.alpha", "n_calibration", "e.width")


def conformal(calibration: DataFrame, target: DataFrame, truth: str, prediction: str, axes: Sequence[str] = (), alphas: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """Per axis, group and alpha: the calibrated half width and, side by side, coverage and width on ``target``:
    n, covered (share of rows inside), width, and factor (upper end over lower end in units of
    1 + the value). Groups of the target without calibration, or with too little, have
    unbounded intervals, which cover all: their width is null."""
    widths = conformal_widths(calibration, truth, prediction, axes, alphas)
    rows = checked(target, truth, prediction).select(F.abs(F.col(truth) - F.col(prediction)).alias("off"), F.explode(strata(target, axes, True)).alias("s")).where("s.group is not null").select("s.axis", "s.group", "off")
    rows = rows.withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in alphas))))
    both = rows.join(widths, ["axis", "group", "alpha"], "left")
    inside = F.col("width").isNull() | (F.col("off") <= F.col("width"))
    return both.groupBy("axis", "group", "alpha").agg(F.coalesce(F.max("n_calibration"), F.lit(0)).alias("n_calibration"), F.count(F.lit(1)).alias("n"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("covered"), (2 * F.max("width")).alias("width"), F.exp(2 * F.max("width")).alias("factor"))
