"""Aggregations over groups, columns and whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import kurtosis_g2, skew_g1
from .checks import keys
from .selection import column_quantiles, group_quantiles, quantiles


def known_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with a complete key: a null key makes no group."""
    return df.dropna(subset=list(by)) if by else df


def counters(df: DataFrame, skip: Sequence[str]) -> list[str]:
    """Columns that are counters because nothing says that they are not."""
    return [c for c in df.columns if c not in set(skip)]


def total(c: str) -> Column:
    """A sum in which missing values count as zero, and all missing as 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def sums(df: DataFrame, by: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of many counters in a single pass."""
    return known_keys(df, keys(by)).groupBy(*keys(by)).agg(*(total(c).alias(c) for c in columns))


def constant(df: DataFrame, by: str | Sequence[str], column: str) -> DataFrame:
    """The one value of a column in each group; an error where it has several."""
    c = F.col(column)
    one = F.when(F.min(c) == F.max(c), F.min(c)).when(F.max(c).isNull(), None).otherwise(F.raise_error(F.lit(f"{column} varies within a group")).cast(df.schema[column].dataType))
    return known_keys(df, keys(by)).groupBy(*keys(by)).agg(one.alias(column))


def weighted_argmax(df: DataFrame, by: str | Sequence[str], value: str, weight: str) -> DataFrame:
    """The value with the largest total weight in each group; ties go to the smallest."""
    per = known_keys(df, [*keys(by), value]).groupBy(*keys(by), value).agg(F.sum(weight).alias("__w"))
    return per.groupBy(*keys(by)).agg(F.min_by(value, F.struct(-F.col("__w"), F.col(value))).alias(value))


def most_frequent(df: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    """The mode of each group; ties go to the smallest value.

    Counted by group and value first, so that a large group is spread by value.
    """
    per = known_keys(df, [*keys(by), value]).groupBy(*keys(by), value).agg(F.count(F.lit(1)).alias("__n"))
    return per.groupBy(*keys(by)).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def distinct_count(df: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    return known_keys(df, keys(by)).groupBy(*keys(by)).agg(F.count_distinct(value).alias("n_values"), (F.count_distinct(value) > 1).alias("several"))


def date_spread(df: DataFrame, by: str | Sequence[str], date: str) -> DataFrame:
    """Days between a group's first and last date."""
    return known_keys(df, keys(by)).groupBy(*keys(by)).agg(F.datediff(F.max(date), F.min(date)).alias("days"))


def summary(df: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    """n, median, mean and sample deviation of each group."""
    rows = known_keys(df, keys(by))
    out = rows.groupBy(*keys(by)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.join(group_quantiles(rows, keys(by), value, {"median": 0.5}), keys(by), "left")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Values with count, share, rank and cumulative share, most frequent first; ties by
    value. The windows run over distinct values only."""
    n = known_keys(df, [column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col(column))
    whole = F.sum("n").over(Window.partitionBy())
    up_to = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select(column, "n", (F.col("n") / whole).alias("share"), F.row_number().over(w).alias("rank"), (up_to / whole).alias("up_to"))


def concentration(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """One row: distinct values, how many cover half and nine tenths, the top k's share."""
    f = frequencies(df, column)
    covers = lambda p: (F.count(F.when(F.col("up_to") < p, 1)) + 1).alias(f"for_{round(100 * p)}")
    return f.agg(F.count(F.lit(1)).alias("n_values"), covers(0.5), covers(0.9), F.max(F.when(F.col("rank") <= k, F.col("up_to"))).alias(f"top_{k}_share"))


def shape(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """n and bias-corrected skewness and excess kurtosis."""
    n = F.count(column)
    return known_keys(df, by).groupBy(*by).agg(n.alias("n"), skew_g1(F.skewness(column), n).alias("skewness"), kurtosis_g2(F.kurtosis(column), n).alias("kurtosis"))


def spread_of_means(df: DataFrame, by: str, column: str) -> DataFrame:
    """One row: largest less smallest group mean."""
    return known_keys(df, [by]).groupBy(by).agg(F.avg(column).alias("m")).agg((F.max("m") - F.min("m")).alias("spread"))


def with_group_mean(df: DataFrame, by: str | Sequence[str], column: str, name: str) -> DataFrame:
    """Each row with its group's mean, null for rows whose key misses a value: the means are
    joined, so a hot group is no one task."""
    means = known_keys(df, keys(by)).groupBy(*keys(by)).agg(F.avg(column).alias(name))
    return df.join(means, keys(by), "left")


def variation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, cv): sample deviation over mean of each column."""
    row = df.agg(*(F.try_divide(F.stddev_samp(c), F.avg(c)).alias(c) for c in columns))
    return row.unpivot([], list(columns), "feature", "cv")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean as an aggregate; 0 for no rows."""
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def ratio_of_sums(df: DataFrame, by: str | Sequence[str], part: str, whole: str) -> DataFrame:
    return known_keys(df, keys(by)).groupBy(*keys(by)).agg(F.try_divide(F.sum(part), F.sum(whole)).alias("ratio"))


def coverage_loss(before: DataFrame, after: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Per group: rows before and after a step, and the percentage lost."""
    n = lambda df, c: known_keys(df, keys(by)).groupBy(*keys(by)).agg(F.count(F.lit(1)).alias(c))
    both = n(before, "n_before").join(n(after, "n_after"), keys(by), "left").fillna(0, ["n_after"])
    return both.withColumn("lost", F.lit(100.0) * (1 - F.col("n_after") / F.col("n_before")))


def missing(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """(feature, n_missing, share) of each column, by group if asked for."""
    g = known_keys(df, [by]).groupBy(by) if by else df.groupBy()
    row = g.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = row.unpivot([by, "__n"] if by else ["__n"], list(columns), "feature", "n_missing")
    return long.withColumn("share", F.try_divide("n_missing", "__n")).drop("__n")


def independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi-squared of a contingency table, its degrees of freedom and p-value.

    Counts by cell, row and column; no table is pivoted, so any number of values
    will do.
    """
    cells = known_keys(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("r")), cells.groupBy(b).agg(F.sum("n").alias("c"))
    # Empty cells add their expected counts, so chi2 = sum n^2 / expected - total.
    part = F.col("n") * F.col("n") * F.col("t") / (F.col("r") * F.col("c"))
    filled = cells.join(rows, a).join(cols, b).withColumn("t", F.sum("n").over(Window.partitionBy()))
    out = filled.agg((F.sum(part) - F.max("t")).alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"))
    return out.withColumn("p_value", chi2_tail(F.col("chi2"), F.col("dof")))


def chi2_tail(chi2: Column, dof: Column) -> Column:
    """Probability of a chi-squared value at least this large; null without degrees of freedom.

    It is the regularised upper incomplete gamma function of a = dof / 2 at x = chi2 / 2:
    one less the power series below a + 1, the continued fraction above. The
    number of terms grows with the root of dof."""
    a, x = dof / F.lit(2.0), F.greatest(chi2, F.lit(0.0)) / 2
    terms = (F.lit(100) + 20 * F.ceil(F.sqrt(dof))).cast("int")
    # ln gamma(a) from gamma(1) or gamma(1/2), a step of one at a time.
    steps = F.filter(F.sequence(F.lit(1), F.greatest(dof, F.lit(1)).cast("int")), lambda k: (k < dof) & ((dof - k) % 2 == 0))
    log_gamma = F.aggregate(steps, F.when(dof % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi))), lambda acc, k: acc + F.ln(k / F.lit(2.0)))
    front = F.exp(a * F.ln(x) - x - log_gamma)
    series = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct((1 / a).alias("term"), (1 / a).alias("sum")),
        lambda acc, k: F.struct((acc["term"] * x / (a + k)).alias("term"), (acc["sum"] + acc["term"] * x / (a + k)).alias("sum")),
    )["sum"]
    fraction = F.aggregate(F.sequence(F.lit(1), terms), F.lit(0.0), lambda acc, k: (terms + 1 - k) * (terms + 1 - k - a) / (x + 2 * (terms + 1 - k) + 1 - a - acc))
    tail = F.when(x < a + 1, 1 - front * series).otherwise(front / (x + 1 - a - fraction))
    return F.when(dof > 0, F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))))


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), chunk: int = 200) -> DataFrame:
    """(a, b, r) for each pair of columns, first by position; rows that miss either are left
    out of the pair. Pairs are computed some hundred to a pass, and stay in long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out: DataFrame | None = None
    for lo in range(0, len(pairs), chunk):
        part = pairs[lo : lo + chunk]
        row = known_keys(df, by).groupBy(*by).agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(part)))
        long = row.select(*by, F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(part)))).alias("x")).select(*by, "x.a", "x.b", "x.r")
        out = long if out is None else out.unionByName(long)
    return out


def with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, r): correlation of each column with the target."""
    row = df.agg(*(F.corr(c, target).alias(c) for c in columns))
    return row.unpivot([], list(columns), "feature", "r")


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns filled with their median, then less their mean, over their sample deviation."""
    fill = {c: q for c, (q,) in column_quantiles(df, columns, [0.5]).items()}
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in columns})
    m = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns)).first()
    return filled.withColumns({c: (F.col(c) - F.lit(m[f"m_{c}"])) / F.nullif(F.lit(m[f"s_{c}"]), F.lit(0.0)) for c in columns})


def five_numbers(df: DataFrame, by: str | Sequence[str], column: str) -> DataFrame:
    rows = known_keys(df, keys(by))
    ends = rows.groupBy(*keys(by)).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return ends.join(group_quantiles(rows, keys(by), column, {"q1": 0.25, "median": 0.5, "q3": 0.75}), keys(by), "left").select(*keys(by), "low", "q1", "median", "q3", "high")


def quantile_bins(df: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """Rows with the number of their quantile bin: (a, b], the first closed, edges
    interpolated, repeated edges merged. Not ``ntile``: equal values share a bin."""
    edges = sorted(set(quantiles(df, column, [i / bins for i in range(bins + 1)])) - {None})
    inner = edges[1:-1]
    number = sum((F.when(F.col(column) > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0)) if edges else F.lit(None)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), number).cast("int"))
