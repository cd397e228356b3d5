"""Ridge search, preprocessing, early stopping and other targets against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestrata.operators import linear, models, redundancy
from lodestrata.operators.preprocess import Preprocessor


def frame(spark, columns, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in columns))


def test_ridge_search_equals_leaving_rows_out_one_by_one(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 3)) @ np.array([[1, 0.9, 0], [0, 0.5, 2], [0, 0, 30]]) + [0, 5, 100]
    y = x @ [0.4, -0.3, 0.01] + rng.normal(0, 1, 40)
    df = frame(spark, "abcy", np.column_stack([x, y])).repartition(3)
    alphas = list(np.logspace(-2, 4, 25))
    scale, mean = x.std(0), x.mean(0)

    def fit(rows, alpha):
        # The whole table's units and the held-back rows' own intercept.
        z = (x[rows] - mean) / scale
        z = np.column_stack([np.ones(len(z)), z])
        return np.linalg.solve(z.T @ z + alpha * np.diag([0, 1, 1, 1]), z.T @ y[rows])

    def left_out(alpha):
        error = 0.0
        for i in range(40):
            b = fit(np.delete(np.arange(40), i), alpha)
            error += (y[i] - b[0] - (x[i] - mean) / scale @ b[1:]) ** 2
        return error

    want = min(alphas, key=left_out)
    model, alpha = linear.ridge_cv(df, ["a", "b", "c"], "y")
    assert alpha == pytest.approx(want)
    assert model.coefficients == pytest.approx(fit(np.arange(40), want)[1:] / scale)
    m = linear.moments(df, ["a", "b", "c", "y"])
    both = linear.ridge_searches(df, m, [["c", "a"], ["a", "b", "c"]], "y")
    assert both[1][1] == alpha and both[0][0].features == ["c", "a"]
    got = {r["variant"]: r["r2"] for r in redundancy.filter_cost(df, df, ["a", "b", "c"], "y").collect()}
    residual = y - model.intercept - x @ model.coefficients
    assert got["all"] == pytest.approx(1 - (residual**2).sum() / ((y - y.mean()) ** 2).sum())


def test_ridge_search_on_odd_tables(spark):
    flat = frame(spark, "aby", [(1, i, 2 * i) for i in range(6)])
    model, _ = linear.ridge_cv(flat, ["a", "b"], "y", alphas=[0.0, 1.0])
    assert model.coefficients == pytest.approx([0, 2])
    gaps = flat.unionByName(spark.createDataFrame([(None, 1.0, 1.0), (1.0, 2.0, None)], flat.schema))
    assert linear.ridge_cv(gaps, ["a", "b"], "y", alphas=[0.0, 1.0])[0].coefficients == pytest.approx([0, 2])
    assert linear.ridge_cv(flat.where("false"), ["a"], "y")[0].intercept == 0


def test_preprocessing_equals_numpy(spark):
    rows = [(1.0, 10.0, "u"), (2.0, None, "v"), (4.0, 40.0, None), (10.0, 99.0, "u")]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    model = Preprocessor(numeric=["a", "b"], categorical=["c"]).fit(df)
    a, b = np.array([1, 2, 4, 10.0]), np.array([10, 40, 40, 99.0])
    gone = np.array([0, 1, 0, 0.0])
    scaled = [(v - v.mean()) / v.std() for v in (a, b, gone)]
    levels = [[float(r[2] == v) for r in rows] for v in (None, "u", "v")]
    names = ["a", "b", "missing_b", "c=__missing__", "c=u", "c=v"]
    assert model.features() == names
    got = model.transform(df).orderBy("a").select(vector_to_array("features")).collect()
    assert np.array([r[0] for r in got]) == pytest.approx(np.array([*scaled, *levels]).T)
    new = spark.createDataFrame([(None, 40.0, "w")], df.schema)
    x = model.transform(new).select(vector_to_array("features")).first()[0]
    assert x == pytest.approx([(3 - a.mean()) / a.std(), (40 - b.mean()) / b.std(), scaled[2][0], 0, 0, 0])


def test_rounds_stop_after_patience():
    assert models.rounds([5, 4, 3, 4, 4, 1], 2) == 3
    assert models.rounds([5, 4, 3, 4, 4, 1], 3) == 6
    assert models.rounds([1.0], 50) == 1


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(240, 2))
    factor = np.where(x[:, 1] > 0, 2.0, 1.0)
    real = 10 + x[:, 0] + rng.normal(0, 0.05, 240)
    df = frame(spark, ["a", "b", "factor", "log_real", "y", "s"], np.column_stack([x, factor, real, np.log1p(np.expm1(real) * factor), np.arange(240) % 3]))
    return {name: df.where(F.col("s") == i) for i, name in enumerate(("train", "calibration", "test"))}


def test_another_target_is_turned_back(spark, parts):
    back = F.log1p(F.expm1("prediction") * F.col("factor"))
    runs = {"plain": {"estimator": models.elastic_net(0.0, 0.0), "numeric": ["a"], "categorical": []}}
    runs["real"] = {**runs["plain"], "fit_on": "log_real", "back": back}
    best, out = models.variants(parts, runs, "y")
    found = {(r["variant"], r["part"]): r["rmsle"] for r in out.where("axis = 'all'").collect()}
    train, test = (np.array(parts[p].select("a", "factor", "log_real", "y").collect()) for p in ("train", "test"))
    slope, intercept = np.polyfit(train[:, 0], train[:, 2], 1)
    predicted = np.log1p(np.expm1(slope * test[:, 0] + intercept) * test[:, 1])
    assert best == "real" and found["real", "test"] == pytest.approx(math.sqrt(((predicted - test[:, 3]) ** 2).mean()), rel=1e-4)
    assert found["plain", "test"] > 0.2


def test_boosting_learns_from_training_rows_only(spark, parts):
    estimator = models.boosting(6, 2)
    shifted = {**parts, "calibration": parts["calibration"].withColumn("y", -F.col("y"))}
    one = models.final_fit(shifted, estimator, ["a"], [], "y", stop_on="calibration", patience=2)
    whole = models.final_fit(shifted, models.boosting(one.model.stages[1].getNumTrees, 2), ["a"], [], "y")
    rows = lambda f: [r[0] for r in f.model.transform(parts["test"]).orderBy("a").select("prediction").collect()]
    assert one.model.stages[1].getNumTrees < 6 and rows(one) == pytest.approx(rows(whole))
