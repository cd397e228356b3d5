"""Bootstrap, conformal intervals, rank correlation and explanations against plain computations."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import explain, selection, uncertainty


def weight(key, replicate, seed=1):
    u = int(hashlib.md5(f"{seed}:{key}#{replicate // 4}".encode()).hexdigest()[8 * (replicate % 4) :][:8], 16)
    return sum(u >= t for t in uncertainty.POISSON)


def scored(spark, rng, n=300):
    rows = [(i, f"g{i % 3}" if i % 50 else None, float(y), float(y + e)) for i, (y, e) in enumerate(zip(rng.normal(10, 2, n), rng.normal(0.1, 0.5, n), strict=True))]
    return rows, spark.createDataFrame(rows, "id long, g string, y double, p double")


def test_weights_are_poisson_and_the_same_anywhere(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    got = {r.k: {w.replicate: w.weight for w in r.w} for r in df.repartition(7).select("k", uncertainty.poisson_weights(F.col("k"), 10).alias("w")).collect()}
    assert all(got[str(i)].get(b, 0) == weight(i, b) for i in range(0, 3000, 7) for b in range(10)) and all(max(w, default=0) < 10 for w in got.values())
    every = np.array([[w.get(b, 0) for b in range(10)] for w in got.values()])
    assert abs(every.mean() - 1) < 0.02 and abs(every.var() - 1) < 0.05
    assert abs(np.corrcoef(every.T)[np.triu_indices(10, 1)]).max() < 0.08


@pytest.mark.parametrize("parts", [1, 9])
def test_gaps_equal_weighted_replicates(spark, parts):
    rng = np.random.default_rng(1)
    rows, df = scored(spark, rng)
    got = {r.group: r for r in uncertainty.bootstrap_gaps(df.repartition(parts), "y", "p", ["g"], ["id"], 30, 0.1).collect()}
    assert set(got) == {"g0", "g1", "g2"}
    known = [r for r in rows if r[1]]
    off = np.array([p - y for _, _, y, p in known])

    def gap(g, w):
        own = np.array([r[1] == g for r in known])
        rmsle = lambda m: math.sqrt((w * off * off)[m].sum() / w[m].sum())
        return rmsle(own) - rmsle(~own), (w * off)[~own].sum() / w[~own].sum() - (w * off)[own].sum() / w[own].sum()

    for g, r in got.items():
        each = np.array([gap(g, np.array([weight(i, b) for i, *_ in known])) for b in range(30)])
        point = gap(g, np.ones(len(known)))
        want = [*point, *np.quantile(each, [0.05, 0.95], axis=0).T.ravel()]
        np.testing.assert_allclose([r.gap, r.bias, r.gap_low, r.gap_high, r.bias_low, r.bias_high], want, rtol=1e-9)
        assert r.replicates == 30 and r.n == sum(x[1] == g for x in known)


def test_intervals_cover_what_they_say(spark):
    """The bootstrap of a true gap of zero, over many data sets."""
    rng = np.random.default_rng(2)
    rows = [(s, i, f"g{i % 2}", 0.0, float(e)) for s in range(40) for i, e in enumerate(rng.normal(0, 1, 120))]
    df = spark.createDataFrame(rows, "s int, id int, g string, y double, p double").withColumns({f"set{s}": F.when(F.col("s") == s, F.col("g")) for s in range(40)})
    got = uncertainty.bootstrap_gaps(df, "y", "p", [f"set{s}" for s in range(40)], ["s", "id"], 100, 0.1).where("group = 'g0'").collect()
    assert len(got) == 40 and 28 <= sum(r.gap_low <= 0 <= r.gap_high for r in got) <= 40


def test_groups_alone_or_empty(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "a", 1.0, 1.5)], "id long, g string, y double, p double")
    assert uncertainty.bootstrap_gaps(df, "y", "p", ["g"], ["id"], 8).count() == 0  # nothing to differ from
    assert uncertainty.bootstrap_gaps(df.where("id > 5"), "y", "p", ["g"], ["id"], 8).count() == 0
    r = uncertainty.bootstrap_gaps(df.union(spark.createDataFrame([(3, "b", 1.0, 1.0)], df.schema)), "y", "p", ["g"], ["id"], 40).where("group = 'b'").first()
    assert 0 < r.replicates < 40 and r.gap < 0


# Conformal intervals


@pytest.mark.parametrize("few", [16, 65_536])
def test_widths_are_the_ranked_scores(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(3)
    rows, df = scored(spark, rng, 211)
    rows.append((999, "tiny", 1.0, 5.0))
    df = df.union(spark.createDataFrame(rows[-1:], df.schema))
    got = {(r.axis, r.group, r.alpha): r for r in uncertainty.conformal_widths(df, "y", "p", ["g"], (0.1, 0.2, 0.5)).collect()}
    groups = {("all", "all"): rows} | {("g", g): [r for r in rows if r[1] == g] for g in ("g0", "g1", "g2", "tiny")}
    assert len(got) == 3 * len(groups)
    for (axis, g), own in groups.items():
        s = sorted(abs(y - p) for _, _, y, p in own)
        for a in (0.1, 0.2, 0.5):
            k = math.ceil(round((len(s) + 1) * (1 - a), 9))
            r = got[axis, g, a]
            assert r.n_calibration == len(s) and (r.width == s[k - 1] if k <= len(s) else r.width is None)
    assert got["g", "tiny", 0.1].width is None and got["g", "tiny", 0.5].width == 4.0


def test_coverage_on_exchangeable_rows(spark):
    """Groups of very different noise: each is covered, at each level, with its own width."""
    rng = np.random.default_rng(4)
    make = lambda n: spark.createDataFrame([(f"g{i % 3}", 0.0, float(e * (1 + 5 * (i % 3)))) for i, e in enumerate(rng.standard_normal(n))], "g string, y double, p double")
    got = {(r.group, r.alpha): r for r in uncertainty.conformal(make(6000), make(9000), "y", "p", ["g"]).collect()}
    for (g, alpha), r in got.items():
        assert 1 - alpha - 0.025 <= r.covered <= 1 - alpha + 0.025, (g, alpha, r)
    assert got["g0", 0.1].width < got["g1", 0.1].width < got["g2", 0.1].width and got["g0", 0.2].width < got["g0", 0.1].width
    lone = uncertainty.conformal(make(30), make(30).withColumn("g", F.lit("new")), "y", "p", ["g"]).where("axis = 'g'").collect()
    assert all(r.width is None and r.covered == 1 and r.n_calibration == 0 for r in lone)


# Kendall's tau


def brute_tau(x, y):
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    free = float((a != 0).sum()) * float((b != 0).sum())
    return (a * b).sum() / math.sqrt(free) if free else None


def test_inversions_equal_pairs():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 64, 200):
        for most in (2, 10, 10**6):
            v = rng.integers(0, most, n)
            assert explain.inversions(v) == sum(int((v[i] > v[i + 1 :]).sum()) for i in range(n))


@pytest.mark.parametrize("size", [1 << 18, 300, 40])
def test_tau_equals_all_pairs(spark, monkeypatch, size):
    """2,000 rows with ties, a third of them at one value of x, or of y."""
    monkeypatch.setattr(explain, "RANGE", size)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 300, 2000).astype(float)
    cases = {"close": np.round(x + rng.normal(0, 60, 2000)), "against": -x, "noise": rng.integers(0, 5, 2000).astype(float), "wide": rng.standard_normal(2000) + x / 200}
    for name, y in cases.items():
        x2, y2 = x.copy(), y.copy()
        x2[rng.random(2000) < 0.33] = 100.0
        if name == "wide":
            y2[rng.random(2000) < 0.33] = 0.5
        rows = [(float(a), float(b)) for a, b in zip(x2, y2, strict=True)]
        r = explain.kendall_tau(spark.createDataFrame([*rows, (None, 1.0), (2.0, float("nan"))], "x double, y double").repartition(5), "x", "y").first()
        assert r.n == 2000 and r.tau_b == pytest.approx(brute_tau(x2, y2), abs=1e-12), name


def test_tau_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert tuple(explain.kendall_tau(df, "x", "y").first()) == (2, None) and tuple(explain.kendall_tau(df.limit(0), "x", "y").first()) == (0, None)


# Explanations


def test_importance_uses_each_value_once(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.standard_normal(3))) for i in range(250)]
    df = spark.createDataFrame([(i, a, b, c, 2 * a + 0.5 * b) for i, a, b, c in rows], "id long, a double, b double, c double, y double").repartition(3)
    predict = lambda d: d.withColumn("prediction", 2 * F.col("a") + 0.5 * F.col("b"))
    got = {r.feature: r for r in explain.permutation_importance(df, predict, "y", ["a", "b", "c"], ["id"]).collect()}
    order = sorted(range(250), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    x = np.array([rows[i][1:] for i in order])
    for j, (f, slope) in enumerate((("a", 2.0), ("b", 0.5), ("c", 0.0))):
        want = np.mean([math.sqrt(np.mean((slope * (np.roll(x[:, j], -s) - x[:, j])) ** 2)) for s in (1, 2, 3)])
        assert got[f].importance == pytest.approx(want, abs=1e-12) and got[f].rmsle == pytest.approx(0, abs=1e-12) and got[f].n == 250
    one = explain.permutation_importance(df.where("id = 3"), predict, "y", ["a"], ["id"]).first()
    assert one.importance == pytest.approx(0, abs=1e-12)


def test_local_effects_of_a_known_function(spark):
    """Of a sum of functions, effects are the functions at the edges, but for a constant, whatever
    the correlation of features."""
    rng = np.random.default_rng(8)
    a = rng.uniform(0, 4, 800)
    b = a + rng.normal(0, 0.1, 800)
    df = spark.createDataFrame([(float(x), float(y), 1.0, None) for x, y in zip(a, b, strict=True)], "a double, b double, c double, d double")
    predict = lambda d: d.withColumn("prediction", F.col("a") * F.col("a") - 3 * F.col("b"))
    got = explain.local_effects(df, predict, ["a", "b", "c", "d"], 8).orderBy("feature", "bin").collect()
    assert {r.feature for r in got} == {"a", "b"}
    for f, x, fn in (("a", a, lambda v: v * v), ("b", b, lambda v: -3 * v)):
        own = [r for r in got if r.feature == f]
        edges = np.quantile(x, np.linspace(0, 1, 9))
        np.testing.assert_allclose([r.high for r in own], edges[1:])
        n = np.array([r.n for r in own])
        upto = fn(edges[1:]) - fn(edges[0])
        np.testing.assert_allclose([r.effect for r in own], upto - (upto * n).sum() / n.sum(), atol=1e-9)
        assert n.sum() == 800
