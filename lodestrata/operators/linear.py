"""Least squares from one distributed pass: moments in Spark, small systems on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, means and centred cross products of columns: a few thousand numbers,
    whatever the number of rows."""

    columns: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def part(self, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        i = [self.columns.index(c) for c in names]
        return self.mean[i], self.cross[np.ix_(i, i)]

    def correlation(self) -> np.ndarray:
        """Pearson's r of all pairs; a constant column has r 0 with all others."""
        d = np.sqrt(np.diag(self.cross))
        ok = d > 0
        r = self.cross / np.where(np.outer(d, d) > 0, np.outer(d, d), 1.0)
        r[~np.outer(ok, ok)] = 0.0
        np.fill_diagonal(r, 1.0)
        return np.clip(r, -1, 1)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of complete rows, in two aggregations: means first, then centred products,
    so that large values lose no digits."""
    columns = list(columns)
    whole = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    first = whole.agg(F.count(F.lit(1)).alias("__n"), *(F.avg(c).alias(c) for c in columns)).first()
    n = first["__n"]
    if not n:
        return Moments(columns, 0, np.zeros(len(columns)), np.zeros((len(columns),) * 2))
    mean = np.array([first[c] for c in columns])
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    cross = np.zeros((len(columns),) * 2)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    for lo in range(0, len(pairs), 500):
        part = pairs[lo : lo + 500]
        row = whole.agg(*(F.sum(centred[i] * centred[j]).alias(f"s{k}") for k, (i, j) in enumerate(part))).first()
        for k, (i, j) in enumerate(part):
            cross[i, j] = cross[j, i] = row[k]
    return Moments(columns, n, mean, cross)


@dataclass
class Linear:
    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def column(self):
        """The prediction as an expression."""
        terms = (F.col(c).cast("double") * F.lit(float(b)) for c, b in zip(self.features, self.coefficients, strict=True))
        return sum(terms, F.lit(float(self.intercept)))


def least_squares(m: Moments, features: Sequence[str], target: str, ridge: float = 0.0) -> Linear:
    """Coefficients with an intercept; smallest norm where columns depend on each other.

    ``ridge`` is the penalty on features in units of their deviations."""
    mean, cross = m.part([*features, target])
    d = np.sqrt(np.maximum(np.diag(cross)[:-1] / max(1, m.n), 0))
    scale = np.where(d > 0, d, 1.0)
    gram = cross[:-1, :-1] / np.outer(scale, scale) + ridge * np.eye(len(features))
    b = np.linalg.lstsq(gram, cross[:-1, -1] / scale, rcond=1e-10)[0] / scale
    return Linear(list(features), b, float(mean[-1] - b @ mean[:-1]))


def r_squared(df: DataFrame, prediction, target: str) -> float:
    """1 - SS_res / SS_tot over rows where both are known."""
    y = F.col(target).cast("double")
    rows = df.select(y.alias("y"), prediction.alias("p")).dropna()
    r = rows.agg(F.sum((F.col("y") - F.col("p")) ** 2).alias("e"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n")).first()
    return float("nan") if not r["v"] else 1 - r["e"] / (r["v"] * r["n"])


def variance_explained(df: DataFrame, prediction, target: str) -> float:
    """1 - var(residual) / var(target): the residual's mean does not count against it."""
    r = df.select((F.col(target) - prediction).alias("e"), F.col(target).alias("y")).dropna().agg(F.var_pop("e").alias("e"), F.var_pop("y").alias("v")).first()
    return float("nan") if not r["v"] else 1 - r["e"] / r["v"]


def between_groups(df: DataFrame, by: str, target: str) -> float:
    """``variance_explained`` by the mean of each group, where a null key is a group too. Variances are added up
    by group, so that no row travels to meet its mean."""
    y = F.col(target).cast("double")
    rows = df.select(F.col(by).alias("g"), y.alias("y")).dropna(subset=["y"])
    r = rows.groupBy("g").agg(F.count("y").alias("n"), F.var_pop("y").alias("v")).agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("e")).first()
    whole = rows.agg(F.var_pop("y")).first()[0]
    return float("nan") if not whole else 1 - r["e"] / whole


def ridge_searches(train: DataFrame, m: Moments, sets: Sequence[Sequence[str]], target: str, alphas: Sequence[float] | None = None) -> list[tuple[Linear, float]]:
    """For each set of features, the ridge whose penalty has the least leave-one-out error.

    ``m`` holds the moments of ``train``. The error a row would have without itself is its
    residual over one less its leverage; on the principal axes of the features both are
    sums over axes for any penalty. One pass over complete rows serves all sets and
    penalties: each task sends one sum of squares for each."""
    alphas = list(np.logspace(-2, 4, 25)) if alphas is None else list(alphas)
    if not m.n:
        return [(least_squares(m, s, target, alphas[0]), alphas[0]) for s in sets]
    plans = []
    for features in sets:
        mean, cross = m.part([*features, target])
        d = np.sqrt(np.maximum(np.diag(cross)[:-1] / m.n, 0))
        scale = np.where(d > 0, d, 1.0)
        values, axes = np.linalg.eigh(cross[:-1, :-1] / np.outer(scale, scale))
        total = np.maximum(values, 0)[:, None] + np.array(alphas)
        share = np.where(total > 1e-10 * max(1.0, values.max()), 1 / np.maximum(total, 1e-300), 0.0)
        weights = (axes.T @ (cross[:-1, -1] / scale))[:, None] * share
        plans.append(([m.columns.index(c) for c in features], mean, axes / scale[:, None], share, weights))
    y, n = m.columns.index(target), m.n

    def run(batches):
        error = np.zeros((len(plans), len(alphas)))
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for i, (at, mean, axes, share, weights) in enumerate(plans):
                z = (rows[:, at] - mean[:-1]) @ axes
                left = 1 - 1 / n - (z * z) @ share
                error[i] += (((rows[:, [y]] - mean[-1] - z @ weights) / np.maximum(left, 1e-12)) ** 2).sum(0)
        yield pa.RecordBatch.from_pydict({"part": np.arange(error.size, dtype=np.int32), "error": error.ravel()})

    rows = train.select(*(F.col(c).cast("double").alias(c) for c in m.columns)).dropna()
    sums = np.zeros(len(plans) * len(alphas))
    for r in rows.mapInArrow(run, "part int, error double").groupBy("part").agg(F.sum("error").alias("error")).collect():
        sums[r["part"]] = r["error"]
    best = [alphas[int(np.argmin(e))] for e in sums.reshape(len(plans), -1)]
    return [(least_squares(m, s, target, alpha), alpha) for s, alpha in zip(sets, best, strict=True)]


def ridge_cv(train: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] | None = None) -> tuple[Linear, float]:
    """Ridge with the penalty of least leave-one-out error, and that penalty."""
    return ridge_searches(train, moments(train, [*features, target]), [features], target, alphas)[0]


def polynomial(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients, constant first, of a polynomial of degree 1 or 2: one aggregation of
    moments around the mean of x, then a small solve."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    centre = rows.agg(F.avg("x")).first()[0]
    u = F.col("x") - F.lit(centre)
    r = rows.agg(*(F.sum(u**k).alias(f"x{k}") for k in range(2 * degree + 1)), *(F.sum(u**k * F.col("y")).alias(f"y{k}") for k in range(degree + 1))).first()
    c = np.linalg.solve([[r[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], [r[f"y{i}"] for i in range(degree + 1)])
    out = np.poly1d([0.0])
    for k, b in enumerate(c):
        out = out + b * np.poly1d([1.0, -centre]) ** k
    return [float(v) for v in np.pad(out.coeffs[::-1], (0, degree + 1 - len(out.coeffs)))]


def vertex(coefficients: Sequence[float]) -> float:
    return -coefficients[1] / (2 * coefficients[2])
