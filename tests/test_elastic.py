"""Elastic nets from moments against pyspark.ml row by row, and against conditions of the optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import elastic, models


def panel(spark, rng, n=400):
    x = rng.standard_normal((n, 3)) * [3, 100, 0.1] + [5, 1e4, 0]
    c = rng.integers(0, 4, n)
    y = x @ [0.3, 0.01, 2.0] + np.array([0, 1, -1, 0.5])[c] + rng.normal(0, 0.4, n) + 12
    gone = rng.random((n, 3)) < [0.0, 0.2, 0.05]
    rows = [(i, *(None if g else float(v) for v, g in zip(x[i], gone[i], strict=True)), f"c{c[i]}" if i % 17 else None, float(y[i]), i % 3, "extra") for i in range(n)]
    rows.append((n, 1.0, 1e4, 0.0, "rare", 13.0, 0, "extra"))  # a level of one fold only
    return spark.createDataFrame(rows, "id int, a double, b double, d double, c string, y double, fold int, y2 string").repartition(5)


@pytest.mark.parametrize("threshold", [0.0, 0.3])
@pytest.mark.parametrize("alpha, ratio", [(0.01, 0.5), (0.2, 1.0), (0.05, 0.0)])
def test_fold_scores_equal_those_of_fitted_pipelines(spark, alpha, ratio, threshold):
    df = panel(spark, np.random.default_rng(1))
    estimator = models.elastic_net(alpha, ratio, 2000).setTol(1e-12)
    want = models.fold_scores(df, models.build(estimator, ["a", "b", "d"], ["c"], "y", threshold), "y", "fold")
    m = elastic.fold_moments(df, ["a", "b", "d"], ["c"], "y", "fold")
    got = elastic.path_scores(m, [alpha], [ratio], threshold, scaled_label=True)
    assert [f for f, *_ in got] == [0, 1, 2]
    np.testing.assert_allclose([s for *_, s in got], want, rtol=1e-6)


def test_moments_are_those_of_the_rows(spark):
    df = panel(spark, np.random.default_rng(2))
    m = elastic.fold_moments(df, ["a", "b", "d"], ["c"], "y", "fold")
    rows = df.collect()
    assert m.levels == {"c": sorted({r.c or "__missing__" for r in rows})}
    for k, f in enumerate(m.folds):
        own = [r for r in rows if r.fold == f]
        z = np.array([[1.0, *((r[x] or 0.0) - s if r[x] is not None else 0.0 for x, s in zip("abd", m.shift, strict=False)), *(float(r[x] is None) for x in "abd"), *(float((r.c or "__missing__") == v) for v in m.levels["c"]), r.y - m.shift[-1]] for r in own])
        np.testing.assert_allclose(m.gram[k], z.T @ z, rtol=1e-9, atol=1e-7)
        for i, x in enumerate("abd"):
            assert m.medians[f][i] == pytest.approx(np.median([r[x] for r in rows if r.fold != f and r[x] is not None]), rel=1e-12)


def test_descent_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(3)
    for p, lasso, ridge in ((5, 0.1, 0.0), (20, 0.05, 0.3), (8, 0.0, 0.2), (12, 5.0, 0.0)):
        x = rng.standard_normal((60, p)) @ rng.standard_normal((p, p))
        y = x @ rng.standard_normal(p) + rng.standard_normal(60)
        c, cy = x.T @ x / 60, x.T @ y / 60
        b = elastic.coordinate_descent(c, cy, lasso, ridge)
        slope = c @ b - cy + ridge * b
        scale = np.abs(cy).max()
        assert (np.abs(slope[b != 0] + lasso * np.sign(b[b != 0])) < 1e-7 * scale).all() and (np.abs(slope[b == 0]) <= lasso + 1e-7 * scale).all()


def test_one_pass_serves_all_penalties(spark, monkeypatch):
    df = panel(spark, np.random.default_rng(4))
    m = elastic.fold_moments(df, ["a", "b", "d"], ["c"], "y", "fold")
    grid = elastic.path_scores(m, [0.001, 0.01, 0.1, 1.0], [0.0, 0.5, 1.0])
    assert len(grid) == 36
    alone = {(f, a, r): s for a in (0.001, 0.1) for f, a, r, s in elastic.path_scores(m, [a], [0.5])}
    assert all(dict(((f, a, r), s) for f, a, r, s in grid)[k] == pytest.approx(s, rel=1e-8) for k, s in alone.items())


def test_odd_tables(spark):
    df = panel(spark, np.random.default_rng(5))
    lone = elastic.fold_moments(df.withColumns({"k": F.lit(1.0), "n": F.lit(None).cast("double")}), ["k", "n", "a"], [], "y", "fold")
    assert len(elastic.path_scores(lone, [0.1], [0.5])) == 3
    assert elastic.path_scores(elastic.fold_moments(df.limit(0), ["a"], ["c"], "y", "fold"), [0.1], [0.5]) == []
    assert elastic.path_scores(elastic.fold_moments(df.where("fold = 1"), ["a"], ["c"], "y", "fold"), [0.1], [0.5]) == []
    text = elastic.fold_moments(df.withColumn("fold", F.concat(F.lit("f"), "fold")).withColumn("y", F.when(F.col("id") > 5, F.col("y"))), ["a"], ["c"], "y", "fold")
    assert text.folds == ["f0", "f1", "f2"] and sum(g[0, 0] for g in text.gram) == 395
