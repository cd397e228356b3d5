"""What a prediction depends on: rank correlation, permutation importance, local effects."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import checked
from .relational import global_rank
from .selection import column_quantiles
from .stored import stored

#: Rows of one range of Kendall's tau, and ranges on each axis at most: their squared number of
#: counts comes to the driver.
RANGE, MOST = 1 << 18, 1_024


def inversions(v: np.ndarray) -> int:
    """Pairs of places i < j with v[i] > v[j]: merging from the bottom, all blocks of a level at a time."""
    n = len(v)
    rank = np.unique(v, return_inverse=True)[1].astype(np.int64)
    at, total, wide = np.arange(n), 0, 1
    while wide < n:
        block = at // (2 * wide)
        left = at % (2 * wide) < wide
        # Blocks one after the other, so that a search finds its place within its own.
        order = block * (n + 1) + rank
        lower = np.sort(order[left])
        upto = np.searchsorted(lower, order[~left], "right")
        ends = np.searchsorted(lower, (block[~left] + 1) * (n + 1), "left")
        total += int((ends - upto).sum())
        wide *= 2
    return total


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, tau_b of the rows where both values are known (null if one does not vary).

    Discordant pairs are those inverted in y when rows go by x, then y. Both axes are cut at
    quantiles: cells are single values at the cuts and open ranges between them, of ``RANGE`` rows or so. A
    pair in two ranges of both axes is counted by cells; one in the same range of y, or
    in the same range of x and two of y, in a task that holds the range. A value that
    fills a third of the rows is a cell and no task, since equal values are never
    inverted. No pair is formed.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = stored(df.where(known(x) & known(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    n = rows.count()
    ranges = min(MOST, -(-n // RANGE)) if n else 1
    cuts = column_quantiles(rows, ["x", "y"], [i / ranges for i in range(1, ranges)]) if ranges > 1 else {"x": [], "y": []}

    def cell(c: str) -> Column:
        """Twice the cuts below a value, and one more on a cut: odd cells are single values."""
        edges = F.array(*(F.lit(float(v)) for v in sorted(set(cuts[c])))).cast("array<double>")
        below = F.size(F.filter(edges, lambda e: e < F.col(c)))
        return (2 * below + F.array_contains(edges, F.col(c)).cast("int")).cast("int")

    placed = stored(rows.select("x", "y", cell("x").alias("p"), cell("y").alias("b")))
    cells = placed.groupBy("p", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    size = 2 * ranges + 1
    grid = np.zeros((size, size), object)
    for r in cells:
        grid[r["p"], r["b"]] = r["n"]
    # Cells before, in x, and above, in y.
    above = np.zeros((size, size), object)
    above[1:, :-1] = grid[::, ::-1].cumsum(axis=0)[:-1].cumsum(axis=1)[:, ::-1][:, 1:]
    discordant = int((grid * above).sum()) if n else 0

    def count(batches, value: str):
        got = [b for b in batches if len(b)]
        if got:
            t = pa.Table.from_batches(got)
            xs, ys, vs = (t.column(c).to_numpy() for c in ("x", "y", value))
            yield pa.RecordBatch.from_pydict({"k": pa.array([inversions(vs[np.lexsort((ys, xs))])], pa.int64())})

    def within(key: str, value: str) -> int:
        own = placed.where(F.col(key) % 2 == 0)
        found = own.groupBy(key).applyInArrow(lambda t: pa.Table.from_batches(list(count(t.to_batches(), value)), pa.schema([("k", pa.int64())])), "k long")
        return found.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]

    discordant += within("b", "y") + within("p", "b")
    tied = lambda *c: rows.groupBy(*c).count().agg(F.coalesce(F.sum((F.col("count").cast("decimal(38,0)") * (F.col("count") - 1)) / 2), F.lit(0))).first()[0]
    pairs = n * (n - 1) // 2
    tx, ty, txy = (int(tied(*c)) for c in (("x",), ("y",), ("x", "y")))
    free = (pairs - tx) * (pairs - ty)
    tau = (pairs - tx - ty + txy - 2 * discordant) / math.sqrt(free) if free > 0 else None
    return df.sparkSession.createDataFrame([(n, tau)], "n long, tau_b double")


def permutation_importance(df: DataFrame, predict: Callable[[DataFrame], DataFrame], truth: str, features: Sequence[str], key: Sequence[str], shifts: Sequence[int] = (1, 2, 3), prediction: str = "prediction") -> DataFrame:
    """(feature, n, rmsle, permuted, importance): how much RMSLE rises when a feature's values are dealt
    to other rows, as a mean over ``shifts``.

    Rows are ranked by a hash of ``key``; a row takes a feature from the row some places
    further on, around the end: each value is used once, as in a permutation, and no
    row keeps its own. Partners meet by one join on ranks for all features; ``predict``
    adds ``prediction`` to all variants in one pass. ``key`` must be unique. Fewer than two rows have no other row:
    shifts count modulo the number of rows.
    """
    order = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)).cast("binary"))
    ranked = stored(global_rank(df.withColumn("__o", order), [F.col("__o"), *(F.col(c) for c in key)], "__rank").drop("__o"))
    n = ranked.count()
    shifted = ranked.select("*", F.explode(F.array(*(F.lit(int(s)) for s in shifts))).alias("__shift"))
    other = ranked.select(F.col("__rank").alias("__partner"), F.struct(*features).alias("__other"))
    pairs = shifted.withColumn("__partner", F.pmod(F.col("__rank") + F.col("__shift"), F.lit(max(1, n)))).join(other, "__partner")
    plain = ranked.select("*", F.lit(0).alias("__shift"), F.lit(None).cast("string").alias("feature"))
    dealt = pairs.withColumn("feature", F.explode(F.array(*(F.lit(f) for f in features))))
    dealt = dealt.withColumns({f: F.when(F.col("feature") == f, F.col(f"__other.{f}")).otherwise(F.col(f)) for f in features}).select(plain.columns)
    scored = checked(predict(plain.unionByName(dealt)), truth, prediction)
    off = F.col(prediction) - F.col(truth)
    errors = stored(scored.groupBy("feature", "__shift").agg(F.sqrt(F.avg(off * off)).alias("rmsle"), F.count(F.lit(1)).alias("n")))
    base = errors.where("feature is null").select("rmsle", "n")
    means = errors.where("feature is not null").groupBy("feature").agg(F.avg("rmsle").alias("permuted"))
    return means.join(base, F.lit(True)).select("feature", "n", "rmsle", "permuted", (F.col("permuted") - F.col("rmsle")).alias("importance"))


def local_effects(df: DataFrame, predict: Callable[[DataFrame], DataFrame], features: Sequence[str], bins: int = 10, prediction: str = "prediction") -> DataFrame:
    """(feature, bin, low, high, n, effect): accumulated local effects.

    Bins lie between a feature's quantiles, (low, high], the first closed; repeated edges are
    merged. Each row is predicted at both ends of its bin with all else its own; the
    mean difference of a bin adds to those before it; effects are those at the upper
    ends, less their mean over rows. Nulls are left out; a constant feature has no bin.
    """
    edges = {c: sorted(set(e)) for c, e in column_quantiles(df, features, [i / bins for i in range(bins + 1)]).items() if e[0] is not None}
    parts = None
    for c in features:
        if len(edges.get(c, ())) < 2:
            continue
        e, x = F.array(*(F.lit(float(v)) for v in edges[c])), F.col(c).cast("double")
        number = F.greatest(sum((F.when(x > F.lit(float(v)), 1).otherwise(0) for v in edges[c][:-1]), F.lit(0)), F.lit(1))
        own = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).withColumns({"feature": F.lit(c), "bin": number, "__low": F.element_at(e, number), "__high": F.element_at(e, number + 1)})
        own = own.withColumn("__end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(c, F.when(F.col("__end") == 1, F.col("__high")).otherwise(F.col("__low")).cast(df.schema[c].dataType))
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        return df.sparkSession.createDataFrame([], "feature string, bin int, low double, high double, n long, effect double")
    p = F.col(prediction)
    steps = predict(parts).groupBy("feature", "bin").agg(F.first("__low").alias("low"), F.first("__high").alias("high"), (F.count(F.lit(1)) / 2).cast("long").alias("n"), (F.sum(F.when(F.col("__end") == 1, p).otherwise(-p)) / (F.count(F.lit(1)) / 2)).alias("step"))
    upto = steps.withColumn("upto", F.sum("step").over(Window.partitionBy("feature").orderBy("bin")))
    whole = Window.partitionBy("feature")
    centre = F.sum(F.col("upto") * F.col("n")).over(whole) / F.sum("n").over(whole)
    return upto.select("feature", "bin", "low", "high", "n", (F.col("upto") - centre).alias("effect"))
