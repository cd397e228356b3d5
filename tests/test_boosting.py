"""Boosting against a plain search of all splits."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lodestrata.operators.boosting import Boosting, BoostingModel, drawn


def table(spark, x, y, parts=3, **more):
    rows = [([float(v) for v in a], None if b is None else float(b), *c) for a, b, *c in zip(x, y, *more.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(["x array<double>", "label double", *(f"{k} boolean" for k in more)]))
    return df.withColumn("features", array_to_vector("x")).repartition(parts)


def plain(x, y, rounds, depth, step, lam, least, logistic=False):
    """Margins of boosting where each node tries every threshold of every feature, missing values on either side."""
    rate = y.mean()
    margin = np.full(len(y), math.log(rate / (1 - rate)) if logistic else rate)

    def grow(rows, g, h, left):
        total = g[rows].sum() ** 2 / (h[rows].sum() + lam)
        best = None
        for j in range(x.shape[1]) if left else ():
            for v in np.unique(x[rows, j][~np.isnan(x[rows, j])]):
                for side in (False, True) if np.isnan(x[rows, j]).any() else (False,):
                    go = np.where(np.isnan(x[rows, j]), side, x[rows, j] <= v)
                    a, b = rows[go], rows[~go]
                    if not len(a) or not len(b) or min(h[a].sum(), h[b].sum()) < least:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + lam) + g[b].sum() ** 2 / (h[b].sum() + lam) - total
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, a, b
        if best is None:
            margin[rows] -= step * g[rows].sum() / (h[rows].sum() + lam)
            return
        grow(best[1], g, h, left - 1)
        grow(best[2], g, h, left - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y, p * (1 - p)) if logistic else (margin - y, np.ones(len(y)))
        grow(np.arange(len(y)), g, h, depth)
    return margin


def predicted(model, df, x):
    found = {tuple(-9.0 if math.isnan(v) else v for v in r["x"]): r["prediction"] for r in model.transform(df).collect()}
    return np.array([found[tuple(-9.0 if math.isnan(v) else v for v in r)] for r in x])


@pytest.mark.parametrize("logistic", [False, True])
def test_equals_a_search_of_all_splits(spark, logistic):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=150), rng.integers(0, 4, 150) + rng.normal(0, 1e-3, 150), rng.integers(0, 2, 150)])
    x[rng.random(150) < 0.2, 0] = np.nan
    y = 3 * (np.nan_to_num(x[:, 0], nan=2.0) > 0.3) + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 150)
    y = (y > np.median(y)).astype(float) if logistic else y
    df = table(spark, x, y)
    model = Boosting(maxIter=4, maxDepth=3, stepSize=0.3, regLambda=2.0, minChildWeight=1.5, objective="logistic" if logistic else "squared").fit(df)
    want = plain(x, y, 4, 3, 0.3, 2.0, 1.5, logistic)
    assert predicted(model, df, x) == pytest.approx(1 / (1 + np.exp(-want)) if logistic else want, abs=1e-6)


def test_partitions_and_written_margins_change_nothing(spark, tmp_path, monkeypatch):
    from lodestrata.operators import boosting

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = x[:, 0] ** 2 + x[:, 1] + rng.normal(0, 0.1, 400)
    fit = lambda parts: Boosting(maxIter=6, maxDepth=2, subsample=0.7, colsample=0.5, seed=3).fit(table(spark, x, y, parts))
    whole = fit(2).learned()["trees"]
    monkeypatch.setattr(boosting, "TREES_A_TABLE", 2)
    one, seven = fit(1), fit(7)
    assert one.learned() == seven.learned() and one.getNumTrees == 6
    for a, b in zip(whole, one.learned()["trees"], strict=True):
        assert a["feature"] == b["feature"] and a["threshold"] == b["threshold"] and a["value"] == pytest.approx(b["value"], abs=1e-8)
        assert len({f for f in a["feature"] if f >= 0}) <= 2
    one.write().overwrite().save(str(tmp_path / "m"))
    again = BoostingModel.load(str(tmp_path / "m"))
    assert again.learned() == seven.learned()
    assert np.array_equal(predicted(again, table(spark, x, y), x), predicted(one, table(spark, x, y), x))


def test_many_nodes_are_summed_by_spark(spark, monkeypatch):
    from lodestrata.operators import boosting

    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3))
    y = np.sin(3 * x[:, 0]) + x[:, 2]
    df = table(spark, x, y)
    dense = Boosting(maxIter=2, maxDepth=4).fit(df).learned()
    monkeypatch.setattr(boosting, "TASK_BYTES", 0)
    assert Boosting(maxIter=2, maxDepth=4).fit(df).learned() == dense


def test_stops_after_patience_and_learns_nothing_from_stopping_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    y = x[:, 0] + rng.normal(0, 0.5, 300)
    stop = [bool(v) for v in rng.random(300) < 0.4]
    df = table(spark, x, y, stop=stop)
    model = Boosting(maxIter=40, maxDepth=3, stepSize=0.5).stopping("stop", 3).fit(df)
    assert len(model.errors) == model.getNumTrees + 4 and min(model.errors) == model.errors[model.getNumTrees]
    kept = np.array(stop)
    got = predicted(model, df, x)
    assert ((got - y)[kept] ** 2).mean() == pytest.approx(min(model.errors))
    alone = Boosting(maxIter=model.getNumTrees, maxDepth=3, stepSize=0.5).fit(df.where("not stop"))
    assert alone.learned()["trees"] == model.learned()["trees"]


def test_nulls_constants_and_empty_tables(spark):
    df = table(spark, [[1.0, 5.0], [2.0, 5.0], [math.nan, 5.0], [4.0, 5.0]], [1.0, 1.0, None, 3.0])
    model = Boosting(maxIter=1, maxDepth=2, stepSize=1.0, regLambda=0.0).fit(df)
    assert [r[0] for r in model.transform(df).orderBy("label").select("prediction").collect()][1:] == pytest.approx([1, 1, 3])
    same = Boosting(maxIter=2).fit(table(spark, [[1.0], [2.0]], [4.0, 4.0]))
    assert same.transform(df.limit(0)).count() == 0 and same.learned()["base"] == 4.0
    with pytest.raises(ValueError, match="no rows"):
        Boosting().fit(df.where("label > 9"))
    with pytest.raises(ValueError, match="levels"):
        Boosting(maxDepth=40).fit(df)
    with pytest.raises(ValueError, match="logistic"):
        Boosting(objective="logistic").fit(df)


def test_rows_are_drawn_by_their_id_at_the_rate():
    ids = np.arange(100_000, dtype=np.int64) - 50_000
    first, second = drawn(ids, 1, 0, 0.3), drawn(ids, 1, 1, 0.3)
    assert first.mean() == pytest.approx(0.3, abs=0.01) and (first & second).mean() == pytest.approx(0.09, abs=0.01)
    assert drawn(ids, 1, 0, 1.0).all()


def test_the_query_equals_a_search_over_all_cuts(spark):
    """Every row of the smallest tables; splits are tried at each of 254 quantiles."""
    from lodestrata.plans import analysis

    sf = "/root/testdata/sf0.001"
    rows = analysis._vectors(spark, sf).collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([r["y"] for r in rows])
    part = np.array([r["split"] for r in rows])
    train = part == "train"
    cuts = [np.unique(np.quantile(c, np.arange(255) / 254))[:-1] for c in x[train].T]
    margin = np.full(len(y), y[train].mean())

    def grow(at, left):
        mine = at & train
        g, n = (margin - y)[mine], mine.sum()
        best = 1e-9, None, None
        for j, c in enumerate(cuts) if left else ():
            for v in c:
                go = x[mine, j] <= v
                if min(go.sum(), n - go.sum()) >= 5:
                    gain = g[go].sum() ** 2 / (go.sum() + 1) + g[~go].sum() ** 2 / (n - go.sum() + 1) - g.sum() ** 2 / (n + 1)
                    if gain > best[0] + 1e-9:
                        best = gain, j, v
        if best[1] is None:
            return [(at, -0.4 * g.sum() / (n + 1))]
        go = x[:, best[1]] <= best[2]
        return grow(at & go, left - 1) + grow(at & ~go, left - 1)

    stop, margins, errors = part == "calibration", [margin.copy()], []
    for _ in range(12):
        errors.append(((margin - y)[stop] ** 2).mean())
        for at, step in grow(np.ones(len(y), bool), 3):
            margin[at] += step
        margins.append(margin.copy())
    errors.append(((margin - y)[stop] ** 2).mean())
    keep = 0
    for i, e in enumerate(errors):
        keep = i if e < errors[keep] else keep
        if i - keep >= 3:
            break
    got = {(r["entity"], r["period"]): r for r in analysis.e3_boosting(spark, sf).collect()}
    want = {(r["entity"], r["period"]): m for r, m, p in zip(rows, margins[keep], part, strict=True) if p == "test"}
    assert got.keys() == want.keys() and len(want) > 50 and {r["trees"] for r in got.values()} == {keep}
    assert all(got[k]["prediction"] == pytest.approx(v, abs=2e-6) for k, v in want.items())
