"""The panel against its SQL where keys repeat, and how often queries compute it."""

import math
import os
import re

import duckdb
import numpy as np
import pytest

from lodestrata.operators import linear, models, selection
from lodestrata.plans import analysis, case, evaluation, relational
from lodestrata.plans.case import panel, with_
from lodestrata.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_lines_are_read_once(spark):
    plan = panel(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_blocks_by_entity_keep_their_rows(spark, monkeypatch):
    """Tasks by entity are an eighth of many tasks of lines; the rows are the same."""
    want = sorted(map(tuple, panel(spark, SF).collect()))
    monkeypatch.setattr(case, "LINES", 25)
    got = panel(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    lines, entities = (max(map(int, re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan))) for key in ("l_orderkey", "entity"))
    assert lines > 200 and entities <= lines / 8 + 1
    assert sorted(map(tuple, got.collect())) == want
    assert [case.entity_tasks(n) for n in (1, 3, 15, 144, 864)] == [1, 2, 8, 24, 108]


def test_repeated_orders_equal_sql(spark, tmp_path):
    """Orders that share a key: with the same customer, year and priority, and with others."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"COPY (SELECT * FROM '{SF}/{f}') TO '{tmp_path}/{f}' (FORMAT parquet)")
    again = f"SELECT * FROM '{SF}/orders.parquet'"
    con.sql(f"""COPY ({again} UNION ALL ({again} WHERE o_orderkey % 3 = 0) UNION ALL (SELECT * REPLACE ('5-LOW' AS o_orderpriority) FROM ({again}) WHERE o_orderkey % 5 = 0)
        UNION ALL (SELECT * REPLACE (o_orderdate + INTERVAL 1 YEAR AS o_orderdate) FROM ({again}) WHERE o_orderkey % 7 = 0)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)""")
    for f in os.listdir(tmp_path):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{f}'")
    got = panel(spark, str(tmp_path))
    columns = [c for c in got.columns if c != "y"]
    want = con.sql(f"{with_('panel')} SELECT {', '.join(columns)} FROM panel").fetchall()
    assert len(want) > 600
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def counted(seen, make):
    def run(spark, d):
        df = make(spark, d)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    return run


READERS = ["q1_target_shape", "q2_period_levels", "q3_curve", "q3_parabola", "q5_premium", "q6_filter_cost", "q7_redundancy", "q8_missingness", "q10_incremental", "x7_preprocessing"]


@pytest.mark.parametrize("name", READERS)
def test_the_panel_is_computed_once(spark, monkeypatch, name):
    n = panel(spark, SF).count()
    seen = spark.sparkContext.accumulator(0)
    for table in ("panel", "model_table"):
        monkeypatch.setattr(analysis, table, counted(seen, getattr(analysis, table)))
    analysis.QUERIES[name].plan(spark, SF).collect()
    assert 0 < seen.value <= n


def test_parts_of_variants_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(300).selectExpr("id % 3 AS part", "id / 7D AS a", "2 + id / 5D AS y")
    rows = counted(seen, lambda spark, d: df)(spark, SF)
    parts = {p: rows.where(f"part = {i}").drop("part") for i, p in enumerate(("train", "calibration", "test"))}
    run = {"estimator": models.elastic_net(0.001, 0.5), "numeric": ["a"], "categorical": []}
    _, out = models.variants(parts, {"one": run, "two": run}, "y")
    assert out.count() == 4
    assert seen.value == 3 * 300  # each part filters what it is made of


def test_missingness_selects_both_medians_at_once(spark, monkeypatch):
    """Also where segments are too large for a task, so that selection takes passes."""
    want = sorted(map(tuple, analysis.QUERIES["q8_missingness"].plan(spark, SF).collect()))
    seen, n = spark.sparkContext.accumulator(0), panel(spark, SF).count()
    keep = analysis._kept
    monkeypatch.setattr(analysis, "_kept", lambda df, *columns: counted(seen, lambda spark, d: keep(df, *columns))(spark, SF))
    monkeypatch.setattr(selection, "FEW", 8)
    assert sorted(map(tuple, analysis.QUERIES["q8_missingness"].plan(spark, SF).collect())) == want
    assert seen.value <= 6 * n


def test_curve_of_unknown_balances_equals_sql(spark, tmp_path):
    """Customers without a balance are a bin of their own; no row is shuffled to meet its bin's mean."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        rows = f"SELECT * FROM '{SF}/{f}'"
        if f == "customer.parquet":
            rows = f"SELECT * REPLACE (CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS c_acctbal) FROM ({rows})"
        con.sql(f"COPY ({rows}) TO '{tmp_path}/{f}' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{f}'")
    query = analysis.QUERIES["q3_curve"]
    got, want = query.plan(spark, str(tmp_path)).collect(), con.sql(query.sql).fetchall()
    assert tuple(got[0]) == pytest.approx(want[0], abs=2e-6)


def test_variance_between_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 2.0), ("b", 7.0), ("b", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, y double")
    # Within: 1, 1; all around their mean of 3: 4, 0, 1, 1, 16.
    assert linear.between_groups(df, "g", "y") == pytest.approx(1 - 2 / 22)
    assert math.isnan(linear.between_groups(df.where("g = 'a'"), "g", "y"))


@pytest.mark.parametrize("name", ["f3_balanced_folds", "f3_group_folds", "j13_lag_pairs"])
def test_other_queries_compute_the_panel_once(spark, monkeypatch, name):
    n = panel(spark, SF).count()
    seen = spark.sparkContext.accumulator(0)
    make = counted(seen, panel)
    for module in (case, evaluation, relational):  # case: where model_table takes it from
        monkeypatch.setattr(module, "panel", make)
    QUERIES[name].plan(spark, SF).collect()
    assert seen.value == n


def test_period_levels_in_passes_compute_the_panel_once(spark, monkeypatch):
    """Periods too large for a task are selected in passes, which read what was kept."""
    query, n = analysis.QUERIES["q2_period_levels"], panel(spark, SF).count()
    want = query.plan(spark, SF).collect()
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(analysis, "panel", counted(seen, panel))
    monkeypatch.setattr(selection, "FEW", 8)
    assert query.plan(spark, SF).collect() == want
    assert seen.value == n


def ridge(x, y, scale, alpha):
    """Prediction of a ridge with a free intercept; the penalty is in units of ``scale``."""
    z = (x - x.mean(0)) / scale
    b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    return lambda rows: y.mean() + (rows - x.mean(0)) @ b


def test_filter_cost_equals_refits_from_one_panel(spark, monkeypatch):
    """Each penalty's error by a fit without each row, over the panel of the SQL."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    terms = "quantity, items, orders, returned, accepted, discount, tax, balance / 1000, ln(1 + quantity), ln(1 + items), y"
    fit, test = (np.array(con.sql(f"{with_('model')} SELECT {terms} FROM model WHERE split = '{s}'").fetchall(), dtype=float) for s in ("train", "calibration"))
    x, y = fit[:, :-1], fit[:, -1]
    r = np.abs(np.corrcoef(fit.T))
    stays = {"all": list(range(10)), "greedy": [], "target_aware": []}
    for name, order in (("greedy", range(10)), ("target_aware", np.argsort(-r[:-1, -1], kind="stable"))):
        for j in order:
            if all(r[i, j] <= 0.95 for i in stays[name]):
                stays[name].append(j)
    want = []
    for name, at in stays.items():
        z, scale, others = x[:, at], x[:, at].std(0), ~np.eye(len(x), dtype=bool)
        error = [sum((y[i] - ridge(z[o], y[o], scale, a)(z[i])) ** 2 for i, o in enumerate(others)) for a in np.logspace(-2, 4, 25)]
        p = ridge(z, y, scale, np.logspace(-2, 4, 25)[np.argmin(error)])(test[:, at])
        want.append((name, len(at), 1 - ((test[:, -1] - p) ** 2).sum() / ((test[:, -1] - test[:, -1].mean()) ** 2).sum()))
    n, seen = panel(spark, SF).count(), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(analysis, "model_table", counted(seen, analysis.model_table))
    got = sorted(map(tuple, analysis.QUERIES["q6_filter_cost"].plan(spark, SF).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    assert 0 < seen.value <= n
