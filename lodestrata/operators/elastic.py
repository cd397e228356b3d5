"""Elastic nets of all folds and penalties from moments: one pass over the rows, small systems after it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean
from .preprocess import MISSING
from .redundancy import greedy_filter
from .selection import column_quantiles, long_quantiles
from .stored import stored

#: Levels of all categories together: their squared number of sums comes to the driver for each fold.
MOST_LEVELS = 2_000


@dataclass
class FoldMoments:
    """By fold: the number of rows and the products of all pairs of raw columns: one, each numeric
    column less ``shift`` (missing: 0), its missing flag, each level, and the target less its shift.

    Filled, flagged, scaled and encoded features of any training part are linear in these,
    so that their moments follow from these by two small products. ``medians`` are
    those of the rows outside of a fold."""

    numeric: list[str]
    levels: dict[str, list[str]]
    folds: list
    gram: np.ndarray
    shift: np.ndarray
    medians: dict

    def training(self, fold) -> np.ndarray:
        """The products of all rows outside of a fold."""
        return self.gram.sum(axis=0) - self.gram[self.folds.index(fold)]

    def features(self, fold, threshold: float = 0.0) -> np.ndarray:
        """The features of a preprocessing learned outside of ``fold``, as rows over the raw columns.

        As ``Preprocessor``: medians fill, flags of what was missing, both scaled by their
        deviations (a constant one is 0), a correlation filter among them, then levels."""
        g, k = self.training(fold), len(self.numeric)
        n = g[0, 0]
        rows = np.zeros((2 * k, len(g)))
        for i in range(k):
            rows[i, 1 + i] = 1
            rows[i, 1 + k + i] = self.medians[fold][i] - self.shift[i]
            rows[k + i, 1 + k + i] = 1
        mean = rows @ g[0] / n
        rows[:, 0] -= mean
        cross = rows @ g @ rows.T
        deviation = np.sqrt(np.maximum(np.diag(cross), 0) / n)
        varies = deviation > 1e-9 * np.maximum(1, np.abs(mean))
        rows = np.where(varies[:, None], rows / np.where(varies, deviation, 1.0)[:, None], 0.0)
        if threshold > 0:
            there = [i for i in range(2 * k) if i < k or g[0, 1 + i] > 0]
            r = np.clip((rows @ g @ rows.T / n)[np.ix_(there, there)], -1, 1)
            np.fill_diagonal(r, 1.0)
            stays = greedy_filter(r, threshold)
            rows = rows[[i for i, s in zip(there, stays, strict=True) if s]]
        coded = np.eye(len(g))[1 + 2 * k : -1]
        return np.vstack([rows, coded])


def fold_moments(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, fold: str) -> FoldMoments:
    """The moments of ``df`` by fold: one pass for levels and means, one or two for medians, one for products.

    Tasks add up products of their rows; Spark adds up tasks. A null category is a level
    of its own. Rows without a target or fold are left out."""
    numeric, categorical = list(numeric), list(categorical)
    known = [clean(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(numeric)]
    coded = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"c{i}") for i, c in enumerate(categorical)]
    rows = stored(df.select(F.col(fold).alias("fold"), clean(F.col(target).cast("double")).alias("y"), *known, *coded).where("fold is not null and y is not null"))
    xs = [f"x{i}" for i in range(len(numeric))]
    about = rows.agg(F.avg("y").alias("y"), *(F.avg(x).alias(x) for x in xs)).first()
    shift = np.array([about[x] or 0.0 for x in xs] + [about["y"] or 0.0])
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("level")) for i in range(len(categorical))))).alias("e")).select("e.*").distinct() if categorical else None
    found = sorted(tuple(r) for r in cells.limit(MOST_LEVELS + 1).collect()) if categorical else []
    if len(found) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    levels = {c: [v for at, v in found if at == i] for i, c in enumerate(categorical)}
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())
    medians = {f: [0.0] * len(xs) for f in folds}
    if xs and len(folds) > 1:
        others = rows.select(F.explode(F.array_remove(F.array(*(F.lit(f) for f in folds)), F.col("fold"))).alias("without"), *xs)
        for r in long_quantiles(others, ["without"], xs, [0.5]).collect():
            medians[r["without"]][int(r["feature"][1:])] = r["q"][0]
    elif xs and folds:
        medians[folds[0]] = [q[0] or 0.0 for q in column_quantiles(rows, xs, [0.5]).values()]
    k, place, at = len(xs), {}, 1 + 2 * len(xs)
    for i, c in enumerate(categorical):
        for v in levels[c]:
            place[i, v] = at
            at += 1
    wide = at + 1
    upper = np.triu_indices(wide)

    def run(batches):
        total = np.zeros((len(folds), wide, wide))
        number = {f: i for i, f in enumerate(folds)}
        for batch in batches:
            m = len(batch)
            z = np.zeros((m, wide))
            z[:, 0] = 1
            z[:, -1] = batch.column(1).to_numpy() - shift[-1]
            for i in range(k):
                x = batch.column(2 + i)
                gone = x.is_null().to_numpy(zero_copy_only=False)
                z[:, 1 + i] = np.where(gone, 0.0, x.fill_null(0.0).to_numpy(zero_copy_only=False) - shift[i])
                z[:, 1 + k + i] = gone
            for i in range(len(categorical)):
                z[np.arange(m), [place[i, v] for v in batch.column(2 + k + i).to_pylist()]] = 1
            which = np.array([number[f] for f in batch.column(0).to_pylist()])
            for f in np.unique(which):
                own = z[which == f]
                total[f] += own.T @ own
        f, cell = np.divmod(np.arange(len(folds) * len(upper[0])), max(1, len(upper[0])))
        yield pa.RecordBatch.from_pydict({"fold": f.astype(np.int32), "cell": cell.astype(np.int32), "value": total[:, *upper].ravel()})

    gram = np.zeros((len(folds), wide, wide))
    for r in rows.mapInArrow(run, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).collect():
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        gram[r["fold"], i, j] = gram[r["fold"], j, i] = r["value"]
    return FoldMoments(numeric, levels, folds, gram, shift, medians)


def coordinate_descent(cross: np.ndarray, with_y: np.ndarray, lasso: float, ridge: float, start: np.ndarray | None = None, tolerance: float = 1e-12, steps: int = 100_000) -> np.ndarray:
    """Coefficients that minimise b'Cb / 2 - b'c + lasso |b| + ridge |b|^2 / 2.

    Each step sets one coefficient to its best and updates the products of all others, never
    touching rows. Columns without variance stay 0."""
    b = np.zeros(len(cross)) if start is None else start.copy()
    left = with_y - cross @ b
    size = np.diag(cross)
    use = np.flatnonzero(size > 1e-14)
    scale = max(1e-300, float(np.abs(with_y).max(initial=0)))
    for _ in range(steps):
        most = 0.0
        for i in use:
            old = b[i]
            pull = left[i] + size[i] * old
            new = np.sign(pull) * max(0.0, abs(pull) - lasso) / (size[i] + ridge)
            if new != old:
                left -= cross[:, i] * (new - old)
                b[i] = new
                most = max(most, abs(new - old) * size[i])
        if most <= tolerance * scale:
            break
    return b


def path_scores(m: FoldMoments, alphas: Sequence[float], l1_ratios: Sequence[float], threshold: float = 0.0, scaled_label: bool = False) -> list[tuple[object, float, float, float]]:
    """(fold, alpha, l1_ratio, rmsle) of elastic nets learned outside of each fold and scored on it.

    The objective is the mean squared error over two plus alpha (l1_ratio |b| + (1 - l1_ratio)
    |b|^2 / 2), with an intercept; ``scaled_label`` divides the second penalty by the target's
    deviation, as ``pyspark.ml`` does. Penalties go from the largest down, each from the
    solution before. Errors come from the fold's own moments: no row is read."""
    out = []
    for f, own in zip(m.folds, m.gram, strict=True):
        g = m.training(f)
        n, rows_ = g[0, 0], own[0, 0]
        if n < 1 or rows_ < 1:
            continue
        t = m.features(f, threshold)
        y = np.eye(len(g))[-1]
        centred = np.vstack([t, y])
        mean = centred @ g[0] / n
        centred[:, 0] -= mean
        c = centred @ g @ centred.T / n
        spread = np.sqrt(max(c[-1, -1], 0)) if scaled_label else 1.0
        for ratio in l1_ratios:
            b = None
            for alpha in sorted(alphas, reverse=True):
                b = coordinate_descent(c[:-1, :-1], c[:-1, -1], alpha * ratio, alpha * (1 - ratio) / (spread or 1.0), b)
                off = np.append(b, -1.0) @ centred
                out.append((f, float(alpha), float(ratio), float(np.sqrt(max(off @ own @ off, 0) / rows_))))
    return out
