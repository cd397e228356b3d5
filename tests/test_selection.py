"""Quantiles by selection against NumPy, with ranges and tasks made small."""

import math

import numpy as np
import pytest

from lodestrata.operators import selection
from lodestrata.operators.aggregates import standardised
from lodestrata.operators.selection import column_quantiles, group_quantiles, long_quantiles, quantiles

P = [0.0, 0.1, 0.25, 0.5, 0.731, 0.9, 1.0]


def columns(rng, n):
    tiny = np.nextafter(0, 1)
    return {
        "normal": rng.standard_normal(n),
        "heavy": np.exp(rng.standard_normal(n) * 200) * rng.choice([-1, 1], n),
        "ties": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, -2.5),
        "near": 1.0 + rng.integers(0, 50, n) * np.finfo(float).eps,
        "zeros": rng.choice([-0.0, 0.0, tiny, -tiny], n),
        "ends": rng.choice([-np.inf, np.inf, 1.0, 2.0, -3.0], n),
        "powers": 2.0 ** rng.integers(-1074, 1023, n),
    }


@pytest.mark.parametrize("few, parts", [(4, 4), (16, 16), (50, 4096), (65_536, 4096)])
def test_all_columns_at_once(spark, monkeypatch, few, parts):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "PARTS", parts)
    data = columns(np.random.default_rng(few), 600)
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*data.values(), strict=True)], ", ".join(f"{c} double" for c in data))
    got = column_quantiles(df, list(data), P)
    for c, x in data.items():
        x = np.sort(x)
        for p, q in zip(P, got[c], strict=True):
            at = p * (len(x) - 1)
            low, high = x[math.floor(at)], x[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert q == want or math.isnan(q) and math.isnan(want), (c, p)


@pytest.mark.parametrize("few", [8, 65_536])
def test_groups_of_all_sizes(spark, monkeypatch, few):
    """One group holds nine tenths of the rows; others are small; nulls and NaN are left out."""
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "PARTS", 8)
    rng = np.random.default_rng(1)
    rows = [("big", i % 2, float(v), None if i % 7 == 0 else float(-v)) for i, v in enumerate(rng.lognormal(0, 3, 900))]
    rows += [(f"g{i % 20}", 0, float(i), float("nan")) for i in range(100)] + [("none", 0, None, None)]
    df = spark.createDataFrame(rows, "g string, h int, x double, y double").repartition(5)
    got = {(r.g, r.h, r.feature): r.q for r in long_quantiles(df, ["g", "h"], ["x", "y"], P).collect()}
    want = {}
    for g, h, x, y in rows:
        for c, v in (("x", x), ("y", y)):
            if v is not None and not math.isnan(v):
                want.setdefault((g, h, c), []).append(v)
    assert got.keys() == want.keys()
    for k, v in want.items():
        np.testing.assert_allclose(got[k], np.quantile(v, P), rtol=1e-12)
    named = {r.g: (r.m, r.top) for r in group_quantiles(df, ["g"], "x", {"m": 0.5, "top": 1.0}).collect()}
    assert len(named) == 21 and named["g3"] == (43.0, 83.0)


def test_nothing_and_one_value(spark):
    df = spark.createDataFrame([(None, 3.0)], "x double, y double")
    assert column_quantiles(df, ["x", "y"], [0.5, 1.0]) == {"x": [None, None], "y": [3.0, 3.0]}
    assert quantiles(df.where("y > 5"), "y", [0.5]) == [None] and column_quantiles(df, [], [0.5]) == {}
    assert long_quantiles(df.where("false"), [], ["x"], [0.5]).count() == 0


def test_scans_do_not_grow_with_columns(spark, monkeypatch):
    """Six passes at most, whatever the columns, although every column is larger than a task sorts."""
    monkeypatch.setattr(selection, "FEW", 16)
    passes, narrow = [], selection._narrow
    monkeypatch.setattr(selection, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    data = columns(np.random.default_rng(2), 3000)
    wide = {f"{c}{i}": x for c, x in data.items() if c != "ends" for i in range(3)}
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*wide.values(), strict=True)], ", ".join(f"{c} double" for c in wide))
    got = column_quantiles(df, list(wide), [0.5])
    assert len(passes) <= 4  # and one before for sizes, one after for the values
    for c, x in wide.items():
        assert got[c] == [np.median(x)]


def test_standardised_columns(spark):
    rows = [(float(i), None if i % 3 else float(i * i)) for i in range(50)]
    got = np.array([(r.x, r.y) for r in standardised(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()])
    raw = np.array([(x, np.nan if y is None else y) for x, y in rows])
    filled = np.where(np.isnan(raw), np.nanmedian(raw, axis=0), raw)
    want = (filled - filled.mean(0)) / filled.std(0, ddof=1)
    np.testing.assert_allclose(np.sort(got, axis=0), np.sort(want, axis=0), atol=1e-12)
