"""Redundant features: greedy filters, blocks by average linkage, principal components.

Correlations come from one distributed pass; what follows works on a matrix of
features by features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .aggregates import correlations, with_target
from .linear import moments, r_squared, ridge_searches


def matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pairwise complete correlations; undefined ones are 0."""
    at = {c: i for i, c in enumerate(columns)}
    out = np.eye(len(columns))
    for r in correlations(df, columns).collect():
        v = 0.0 if r["r"] is None or np.isnan(r["r"]) else r["r"]
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = v
    return out


def greedy_filter(r: np.ndarray, threshold: float | None) -> list[bool]:
    """Which features stay: of each pair with |r| above the threshold, the earlier."""
    stays = [True] * len(r)
    if threshold is not None:
        for j in range(len(r)):
            stays[j] = not any(stays[i] and abs(r[i, j]) > threshold for i in range(j))
    return stays


def target_aware_filter(r: np.ndarray, with_y: Sequence[float], threshold: float) -> list[bool]:
    """Which features stay when, of each such pair, the one closer to the target does."""
    order = sorted(range(len(r)), key=lambda i: (-abs(with_y[i]), i))
    stays = [False] * len(r)
    for i in order:
        stays[i] = not any(stays[j] and abs(r[i, j]) > threshold for j in order)
    return stays


def blocks(r: np.ndarray, distance: float = 0.5) -> list[int]:
    """Block of each feature: average linkage on 1 - |r|, cut at ``distance``.

    The closest two clusters merge first, ties going to the earliest."""
    d = 1 - np.abs(r)
    members = {i: [i] for i in range(len(r))}
    while len(members) > 1:
        names = sorted(members)
        best = min(((float(d[np.ix_(members[a], members[b])].mean()), a, b) for x, a in enumerate(names) for b in names[x + 1 :]), default=None)
        if best is None or best[0] > distance:
            break
        members[best[1]] += members.pop(best[2])
    out = [0] * len(r)
    for k, a in enumerate(sorted(members)):
        for i in members[a]:
            out[i] = k
    return out


def representatives(r: np.ndarray, block: Sequence[int]) -> list[int]:
    """Of each block, the feature with the highest mean |r| in it."""
    out = []
    for b in sorted(set(block)):
        inside = [i for i, x in enumerate(block) if x == b]
        out.append(max(inside, key=lambda i: (np.abs(r[i, inside]).mean(), -i)))
    return out


def spectrum(r: np.ndarray) -> dict[str, float]:
    """Components for 80 and 90 percent of the variance, and the participation ratio."""
    w = np.maximum(np.linalg.eigvalsh(r)[::-1], 0)
    share = np.cumsum(w) / w.sum()
    return {"for_80": int((share < 0.8).sum()) + 1, "for_90": int((share < 0.9).sum()) + 1, "participation": float(w.sum() ** 2 / (w**2).sum())}


def filter_cost(train: DataFrame, test: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.95, alphas: Sequence[float] | None = None) -> DataFrame:
    """R2 of a ridge on ``test`` with all features, with those that the greedy filter
    leaves and with those that the target-aware one does. The penalty of each is searched
    over ``alphas`` by leave-one-out error; the moments and the search are shared by all."""
    m = moments(train, [*columns, target])
    r = m.correlation()[:-1, :-1]
    known = {x["feature"]: x["r"] or 0.0 for x in with_target(train, columns, target).collect()}
    sets = {
        "all": [True] * len(columns),
        "greedy": greedy_filter(r, threshold),
        "target_aware": target_aware_filter(r, [known[c] for c in columns], threshold),
    }
    used = [[c for c, s in zip(columns, stays, strict=True) if s] for stays in sets.values()]
    found = ridge_searches(train, m, used, target, alphas)
    out = [(name, len(u), r_squared(test, model.column(), target)) for name, u, (model, _) in zip(sets, used, found, strict=True)]
    return train.sparkSession.createDataFrame(out, "variant string, n_features int, r2 double")


def incremental(train: DataFrame, test: DataFrame, steps: Sequence[tuple[str, Sequence[str]]], target: str, alphas: Sequence[float] | None = None) -> DataFrame:
    """R2 on ``test`` of a ridge on growing blocks of features, its penalty searched for each as
    in ``filter_cost``."""
    every = list(dict.fromkeys(c for _, cols in steps for c in cols))
    used = [list(dict.fromkeys(c for _, cols in steps[: i + 1] for c in cols)) for i in range(len(steps))]
    found = ridge_searches(train, moments(train, [*every, target]), used, target, alphas)
    out = [(name, len(u), r_squared(test, model.column(), target)) for (name, _), u, (model, _) in zip(steps, used, found, strict=True)]
    return train.sparkSession.createDataFrame(out, "block string, n_features int, r2 double")
