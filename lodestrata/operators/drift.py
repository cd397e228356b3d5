"""Shifts between samples: population stability, Kolmogorov-Smirnov, definition breaks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import jumps
from .selection import long_quantiles
from .stored import stored


def long_form(reference: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, x, a) of the known values of both samples; ``a`` is true for the reference. All
    columns travel in one table, so each step below is one pass for all of them."""
    both = [df.select(*(F.col(c).cast("double").alias(c) for c in columns), F.lit(a).alias("__a")) for df, a in ((reference, True), (other, False))]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns)))
    rows = both[0].unionByName(both[1]).select(each.alias("e"), F.col("__a").alias("a")).select("e.feature", "e.x", "a")
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x"))


def stability(rows: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 1e-4) -> dict[str, tuple[float, float | None, float | None]]:
    """Per column of a long form: stability index over the reference's quantile bins (see ``psi``)
    and both means, from one selection and one aggregation."""
    wanted = rows.where("a").withColumnRenamed("feature", "name")
    edges = {r["name"]: sorted({-math.inf, *r["q"][1:-1], math.inf}) for r in long_quantiles(wanted, ["name"], ["x"], [i / bins for i in range(bins + 1)]).collect()}
    out = {c: (math.nan, None, None) for c in columns}
    inner = [F.struct(F.lit(c).alias("feature"), F.array(*(F.lit(float(v)) for v in e[1:-1])).cast("array<double>").alias("edges")) for c, e in edges.items()]
    table = F.map_from_entries(F.array(*inner)) if inner else F.lit(None).cast("map<string,array<double>>")
    number = F.size(F.filter(F.coalesce(F.element_at(table, F.col("feature")), F.array().cast("array<double>")), lambda e: F.col("x") >= e))
    counts = rows.groupBy("feature", "a", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")).collect()
    for c in columns:
        own = {s: [r for r in counts if r["feature"] == c and r["a"] == s] for s in (True, False)}
        n = {s: sum(r["n"] for r in own[s]) for s in own}
        mean = {s: math.fsum(r["total"] for r in own[s]) / n[s] if n[s] else None for s in own}
        index, cells = math.nan, len(edges.get(c, ())) - 1
        if cells >= 2 and n[False]:
            share = {s: [floor] * cells for s in own}
            for s, rs in own.items():
                for r in rs:
                    share[s][r["bin"]] = max(floor, r["n"] / n[s])
            index = sum((y - x) * math.log(y / x) for x, y in zip(share[True], share[False], strict=True))
        out[c] = (index, mean[True], mean[False])
    return out


def psi(reference: DataFrame, other: DataFrame, column: str, bins: int = 10, floor: float = 1e-4) -> float:
    """Population stability index over the reference's quantile bins.

    Bins are [a, b), the outer ones open; repeated edges are merged. Fewer than
    three different edges give NaN. Shares are of known values, at least ``floor``.
    """
    return stability(long_form(reference, other, [column]), [column], bins, floor)[column][0]


def band(c: Column, moderate: float = 0.10, large: float = 0.25) -> Column:
    """The usual words for a stability index."""
    return F.when(c.isNull() | F.isnan(c), None).when(c > large, "large").when(c > moderate, "moderate").otherwise("stable")


def distances(rows: DataFrame) -> DataFrame:
    """(feature, ks, gap, n_a, n_b) of a long form: the largest distance between two samples'
    distribution functions, also as a whole number (times n_a times n_b), and their sizes.

    Counts are cumulated once over the distinct values of all features, so ties count
    together. They are summed by range partition first: a feature may fill many, and no
    window runs over a whole feature.
    """
    one = F.col("a").cast("long")
    at = rows.groupBy("feature", "x").agg(F.sum(one).alias("a"), F.sum(1 - one).alias("b"))
    ranged = at.orderBy("feature", "x").withColumn("p", F.spark_partition_id())
    w = Window.partitionBy("p", "feature").orderBy("x")
    inside = ranged.withColumns({"ca": F.sum("a").over(w), "cb": F.sum("b").over(w)})
    ranges = ranged.groupBy("p", "feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    before = Window.partitionBy("feature").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    ranges = ranges.select("p", "feature", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("na", "nb")), *(F.sum(c).over(whole).alias(f"t{c}") for c in ("na", "nb")))
    a, b = F.col("ca") + F.col("bna"), F.col("cb") + F.col("bnb")
    gap = F.abs(F.try_divide(a, F.col("tna")) - F.try_divide(b, F.col("tnb")))
    exact = F.abs(a.cast("decimal(38,0)") * F.col("tnb") - b.cast("decimal(38,0)") * F.col("tna"))
    return inside.join(ranges, ["p", "feature"]).groupBy("feature").agg(F.max(gap).alias("ks"), F.max(exact).cast("double").alias("gap"), F.max("tna").alias("n_a"), F.max("tnb").alias("n_b"))


def asymptotic(ks: Column, n_a: Column, n_b: Column) -> Column:
    """The p-value of a two-sample distance for large samples."""
    scale = F.sqrt(n_a * n_b / (n_a + n_b)) * ks
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scale * scale))
    series = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(ks <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def path_share(gap: float, n_a: int, n_b: int) -> float:
    """The exact p-value: the share of all orders of n_a and n_b values whose distribution
    functions somewhere lie ``gap`` / (n_a n_b) apart or more.

    An order is a lattice path; the share of paths to (i, j) that have been outside is that of
    (i-1, j) and (i, j-1), weighted i to j, and 1 outside. Diagonals follow one another
    in one vector, and only positive numbers are added, so small values keep their digits."""
    # Less than the gap by rounding of its double, never by a step.
    least = gap * (1 - 1e-12)
    out = np.zeros(n_a + 1)
    out[0] = 1.0 if least <= 0 else 0.0
    i = np.arange(n_a + 1, dtype=np.float64)
    for k in range(1, n_a + n_b + 1):
        j = k - i
        step = out * (j / k)
        step[1:] += out[:-1] * (i[1:] / k)
        outside = (np.abs(i * n_b - j * n_a) >= least) & (j >= 0) & (j <= n_b)
        out = np.where(outside, 1.0, step)
        out[(j < 0) | (j > n_b)] = 0.0
    return float(out[n_a])


#: Values of the larger sample up to which p-values are exact: a few seconds for a pair of samples.
EXACT = 10_000


def with_exact(df: DataFrame, name: str = "p_exact") -> DataFrame:
    """``distances`` with their exact p-values; null where a sample is larger than ``EXACT``."""

    @F.pandas_udf("double")
    def exact(gap: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        return pd.Series([path_share(g, int(min(a, b)), int(max(a, b))) if 0 < min(a, b) and max(a, b) <= EXACT else None for g, a, b in zip(gap, n_a, n_b, strict=True)], dtype="float64")

    return df.withColumn(name, exact("gap", "n_a", "n_b"))


def ks_statistic(df: DataFrame, column: str, sample: Column) -> DataFrame:
    """One row: the largest distance between two samples' distribution functions, their
    sizes and the asymptotic p-value. ``sample`` is true for the first sample. Null and NaN
    are left out."""
    rows = df.select(F.lit(column).alias("feature"), F.col(column).cast("double").alias("x"), F.coalesce(sample, F.lit(False)).alias("a")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    d = distances(rows)
    return d.select("ks", "n_a", "n_b", asymptotic(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("p_value"))


def drift_table(reference: DataFrame, other: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Per column: stability index and its band, KS statistic and asymptotic p-value, both means.

    Both samples are written once in long form; quantiles, counts and distances are a pass
    or two each for all columns."""
    rows = stored(long_form(reference, other, columns))
    index = stability(rows, columns, bins)
    d = distances(rows).select("feature", "ks", asymptotic(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("ks_p"))
    df = reference.sparkSession.createDataFrame([(c, *index[c]) for c in columns], "feature string, psi double, mean_a double, mean_b double")
    return df.join(d, "feature", "left").select("feature", "psi", "ks", "ks_p", "mean_a", "mean_b", band(F.col("psi")).alias("band"))


def period_means(df: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """(feature, period, mean, sd): means by period with the deviation over all rows."""
    sd = df.agg(*(F.stddev_samp(c).alias(c) for c in columns)).unpivot([], list(columns), "feature", "sd")
    means = df.where(F.col(period).isNotNull()).groupBy(period).agg(*(F.avg(c).alias(c) for c in columns))
    return means.unpivot([period], list(columns), "feature", "mean").join(sd, "feature")


def definition_breaks(df: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """Per feature: its largest change between neighbouring periods in deviations of the
    feature, the period it happens in, the means of the first two and last two
    periods, and the change from first to last in percent."""
    m = jumps(period_means(df, period, columns), "feature", period, "mean", "sd")
    w = Window.partitionBy("feature").orderBy(period)
    m = m.withColumns({"i": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("feature"))})
    first, last = F.min_by("mean", period), F.max_by("mean", period)
    return m.groupBy("feature").agg(
        F.max("jump").alias("largest_jump"),
        F.max_by(period, F.struct(F.coalesce("jump", F.lit(-1.0)), -F.col("i"))).alias("jump_in"),
        F.avg(F.when(F.col("i") <= 2, F.col("mean"))).alias("early"),
        F.avg(F.when(F.col("i") > F.col("n") - 2, F.col("mean"))).alias("late"),
        (100 * F.try_divide(last - first, F.abs(first))).alias("change_percent"),
    )


def local_anomaly(df: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """Per feature and inner period: distance from the mean of its two neighbours, in
    deviations of the feature."""
    m = period_means(df, period, columns)
    w = Window.partitionBy("feature").orderBy(period)
    around = (F.lag("mean").over(w) + F.lead("mean").over(w)) / 2
    return m.withColumn("anomaly", F.abs(F.col("mean") - around) / F.nullif(F.col("sd"), F.lit(0.0))).where("anomaly is not null").select("feature", period, "anomaly")


def identity_share(df: DataFrame, period: str, parts: Sequence[str], whole: str, digits: int = 6) -> DataFrame:
    """By period: the percentage of rows whose parts add up to the whole."""
    from ..functions.numeric import row_sum

    same = F.round(row_sum([F.col(c) for c in parts]) - F.col(whole), digits) == 0
    return df.where(F.col(period).isNotNull()).groupBy(period).agg((100 * F.avg(F.when(same, 1.0).otherwise(0.0))).alias("percent"))
