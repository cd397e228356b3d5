"""Joins, expressions, panel aggregations, preprocessing and provenance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import dates, numeric, text
from lodestrata.operators import aggregates, checks, linear, models, preprocess, redundancy, relational
from lodestrata.sources import archives, provenance, tables


def values(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def test_checked_join_raises_on_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k int, b int")
    assert checks.checked_join(a, b, "k", "inner", "many_to_one").count() == 3
    for kind, left, right in (("one_to_one", a, b), ("many_to_one", b, a), ("one_to_many", a, b)):
        with pytest.raises(ValueError, match="repeats"):
            checks.checked_join(left, right, "k", "inner", kind)
    with pytest.raises(ValueError):
        relational.chain_join([b, a], "k")
    with pytest.raises(ValueError, match="rows became"):
        relational.chain_join([b, b.where("k = 1").withColumnRenamed("b", "c")], "k")
    with pytest.raises(ValueError, match="missing"):
        checks.require_columns(a, ["k", "nope"])


def test_load_tables(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "k int, a int")
    out = relational.load_tables({"a": a, "b": a}, ["k"], rename={"b": {"a": "c"}})
    assert [df.count() for df in out.values()] == [2, 2] and out["b"].columns == ["k", "c"]
    with pytest.raises(ValueError, match="is in a and in b"):
        relational.load_tables({"a": a, "b": a}, ["k"])
    with pytest.raises(ValueError, match="differ in rows"):
        relational.load_tables({"a": a, "b": a.where("k = 1")}, ["k"], rename={"b": {"a": "c"}})


def test_cascade_uses_each_row_once(spark):
    left = spark.createDataFrame([("l1", "ann", 1), ("l2", "bob", 2), ("l3", "cy", 3), ("l4", "cy", 3), ("l5", None, 5), ("l6", "eve", 6)], "l string, n string, d int")
    right = spark.createDataFrame([("r1", "ann", 1), ("r2", "bob", 9), ("r3", "cy", 3), ("r5", None, 5), ("r6", "eva", 6), ("r7", "ann", 8)], "r string, n string, d int")
    got = relational.cascade_match(left, right, [("both", ["n", "d"], ["n", "d"]), ("day", ["d"], ["d"]), ("name", ["n"], ["n"])], "l", "r")
    assert values(got, "l", "r", "matched_by") == [("l1", "r1", "both"), ("l2", "r2", "name"), ("l5", "r5", "day"), ("l6", "r6", "day")]


def test_nearest_prefers_the_earlier_day(spark):
    facts = spark.createDataFrame([("p", 2020), ("q", 2020)], "e string, y int")
    cand = spark.createDataFrame([("p", "2020-06-28", 1), ("p", "2020-07-02", 2), ("p", "2020-06-30", None), ("q", "2020-10-05", 3)], "e string, d string, v int").withColumn("d", F.to_date("d"))
    at = lambda m, x: F.make_date("y", F.lit(m), F.lit(x))
    got = relational.nearest_in_window(facts, cand.where("v is not null"), "e", "d", at(4, 1), at(9, 30), at(6, 30), ["e", "y"], ["v"])
    assert values(got, "e", "days", "v") == [("p", 2, 1)]


def test_lag_needs_neighbours(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 4, 40), ("b", 2, 5)], "e string, t int, v int")
    assert values(relational.lag_pairs(rows, "e", "t", "v")) == [("a", 2, 10, 20)]


@pytest.mark.parametrize("parts", [1, 5])
def test_global_rank(spark, parts):
    rows = spark.range(200).withColumn("x", (F.col("id") * 37) % 200).repartition(parts)
    assert all(r["rank"] == r["x"] for r in relational.global_rank(rows, [F.col("x")]).collect())


def test_ties_go_to_the_smallest(spark):
    rows = spark.createDataFrame([("a", "y", 2.0), ("a", "x", 1.0), ("a", "x", 1.0), ("b", None, 9.0), ("b", "z", 1.0), (None, "z", 1.0)], "k string, v string, w double")
    assert values(aggregates.weighted_argmax(rows, "k", "v", "w")) == [("a", "x"), ("b", "z")]
    assert values(aggregates.most_frequent(rows, "k", "v")) == [("a", "x"), ("b", "z")]
    assert values(aggregates.most_frequent(rows.where("w = 2 or (w = 1 and k = 'a')").dropDuplicates(), "k", "v")) == [("a", "x")]


def test_sums_skip_missing_and_constants_are_checked(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", 2.0, 3.0)], "k string, x double, z double")
    assert values(aggregates.sums(rows, "k", ["x", "z"])) == [("a", 1.0, 0.0), ("b", 2.0, 3.0)]
    assert values(aggregates.constant(rows, "k", "x")) == [("a", 1.0), ("b", 2.0)]
    with pytest.raises(Exception, match="varies"):
        aggregates.constant(rows.withColumn("k", F.lit("one")), "k", "x").collect()


def test_expressions(spark):
    row = spark.createDataFrame([("José Ñandú-X", "Łukasz", None, "FW,AM", "eng ENG", "2024-04-29", "21-060", "x")], "a string, b string, c string, p string, n string, m string, age string, bad string")
    r = row.select(
        *(text.plain_name(F.col(c)).alias(c) for c in "abc"),
        text.first_part(F.col("p")).alias("p"),
        text.last_word(F.col("n")).alias("n"),
        dates.birth_date(F.to_date("m"), F.col("age")).alias("leap"),
        dates.birth_date(F.to_date("m"), F.lit("21-061")).alias("born"),
        dates.birth_date(F.to_date("m"), F.col("bad")).alias("none"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["p"], r["n"]) == ("jose nandux", "ukasz", None, "FW", "ENG")
    assert (r["leap"], str(r["born"]), r["none"]) == (None, "2003-02-28", None)
    nums = spark.createDataFrame([(5.0, 0.0), (7.0, 5.0), (None, 1.0), (math.nan, 1.0)], "x double, y double")
    got = [r["c"] for r in numeric.clean_frame(nums).select(numeric.clip(numeric.percentage(F.col("x"), F.col("y")), 0.0, 100.0).alias("c")).collect()]
    assert got == [None, 100.0, None, None]
    far = spark.createDataFrame([("2020-01-01", d) for d in ("2020-01-08", "2020-01-09", None)], "a string, b string")
    assert [r[0] for r in far.select(dates.is_far(F.to_date("a"), F.to_date("b"), 7)).collect()] == [False, True, False]


def test_concentration_and_shape(spark):
    rows = spark.createDataFrame([(v,) for v in [1.0] * 5 + [2.0] * 3 + [3.0, 10.0]], "v double")
    r = aggregates.concentration(rows, "v", 2).first()
    assert (r["n_values"], r["for_50"], r["for_90"], r["top_2_share"]) == (4, 1, 3, 0.8)
    s = aggregates.shape(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double"), [], "v").first()
    assert (s["skewness"], s["kurtosis"]) == (pytest.approx(1.7636, abs=1e-4), pytest.approx(3.2280, abs=1e-4))


FRAME = [(1.0, 2.0, 5.0, 1.0, "DEF", "L1", 9.0), (2.0, 4.0, 1.0, None, "MID", "L1", 9.0), (3.0, 6.0, 4.0, 3.0, "DEF", "L2", 9.0), (4.0, 8.0, 2.0, None, "FOR", "L2", 9.0), (5.0, 10.0, 3.0, 5.0, "MID", "L1", 9.0)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(FRAME, "a double, b double, c double, gap double, position string, league string, unused double")


def matrix(model, df):
    return np.array([r["features"].toArray() for r in model.transform(df).collect()])


def test_preprocessing(spark, frame, tmp_path):
    p = preprocess.Preprocessor(numeric=["a", "b", "c", "gap"], categorical=["position", "league"], threshold=0.95).fit(frame)
    assert p.features() == ["a", "c", "gap", "missing_gap", "position=DEF", "position=FOR", "position=MID", "league=L1", "league=L2"]
    x = matrix(p, frame)
    assert x.shape == (5, 9) and abs(x[:, :4].mean(0)).max() < 1e-12 and x[:, :4].std(0) == pytest.approx(1)
    assert len(set(x[:, 3].round(6))) == 2
    new = matrix(p, spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, "GK", None, 0.0)], frame.schema))
    assert (new[0, 4:] == 0).all()
    p.write().overwrite().save(str(tmp_path / "p"))
    assert (matrix(preprocess.PreprocessorModel.load(str(tmp_path / "p")), frame) == x).all()
    with pytest.raises(ValueError, match="missing columns"):
        p.transform(frame.drop("a"))


def test_greedy_filter():
    r = np.array([[1, 1, 0.1], [1, 1, 0.1], [0.1, 0.1, 1]])
    assert redundancy.greedy_filter(r, 0.95) == [True, False, True]
    assert redundancy.greedy_filter(r, None) == [True] * 3
    assert redundancy.greedy_filter(r, 1.0) == [True] * 3
    assert redundancy.target_aware_filter(r, [0.2, 0.9, 0.1], 0.95) == [False, True, True]
    assert redundancy.blocks(r) == [0, 0, 1]
    assert redundancy.spectrum(np.eye(4))["participation"] == pytest.approx(4)


def test_constant_column_stays(spark, frame):
    m = linear.moments(frame.withColumn("k", F.lit(1.0)), ["a", "b", "k"])
    assert redundancy.greedy_filter(m.correlation(), 0.95) == [True, False, True]


def test_least_squares_and_polynomial(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(5, 2, 400), rng.normal(size=400)
    y = 3 + 2 * x - z
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, x + z, y, strict=True)], "x double, z double, both double, y double")
    fit = linear.least_squares(linear.moments(df, ["x", "z", "y"]), ["x", "z"], "y")
    assert fit.coefficients == pytest.approx([2, -1]) and fit.intercept == pytest.approx(3)
    dependent = linear.least_squares(linear.moments(df, ["x", "z", "both", "y"]), ["x", "z", "both"], "y")
    assert linear.r_squared(df, dependent.column(), "y") == pytest.approx(1)
    model, alpha = linear.ridge_cv(df, ["x", "z"], "y", alphas=[0.0, 1e3])
    assert alpha == 0.0 and model.coefficients == pytest.approx([2, -1])
    curve = spark.createDataFrame([(float(v), float(1 - 4 * v + 2 * v * v)) for v in range(10)], "x double, y double")
    c = linear.polynomial(curve, "x", "y", 2)
    assert c == pytest.approx([1, -4, 2]) and linear.vertex(c) == pytest.approx(1)


def test_models_learn_and_search_is_stable(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), "u" if a > 0 else "v", 12 + 0.5 * float(a) - 0.2 * float(b) + 0.05 * float(e), i % 3) for i, (a, b, e) in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "a double, b double, c string, y double, fold int")
    parts = {"train": df.where("fold < 2"), "calibration": df.where("fold = 2")}
    f = models.final_fit(parts, models.elastic_net(1e-4, 0.5), ["a", "b"], ["c"], "y")
    assert f.metrics["calibration"].first()["r2_log"] > 0.95 and f.duan == pytest.approx(1, abs=0.05)
    s = models.search(df, "elastic_net", ["a", "b"], [], "y", "fold", n=2)
    assert list(models.draws(models.SPACES["boosting"], 3)) == list(models.draws(models.SPACES["boosting"], 3))
    assert s.score < 0.1 and s.log(spark).count() == 2


def test_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    f = lambda x: provenance.fingerprint(x).first()
    assert f(df) == f(df.repartition(5).select("v", "k")) and f(df) != f(df.distinct()) and f(df) != f(df.withColumn("v", F.lit("b")))
    path = tmp_path / "x.bin"
    path.write_bytes(b"abc")
    sha = provenance.file_sha256(path)
    assert provenance.agrees(sha, sha) and not provenance.agrees(None, sha, strict=False)
    with pytest.raises(ValueError):
        provenance.agrees("other", sha)
    seen, rows = provenance.counted(df, "stage 1")
    seen.collect()
    m = provenance.manifest(spark, {"file": path}, {}, {"seasons": {2, 1}, "at": (1, 2)}, {"stage 1": rows})
    assert m["rows"] == {"stage 1": 3} and m["parameters"] == {"seasons": [1, 2], "at": [1, 2]} and m["inputs"]["file"]["sha256"] == sha


def test_files(spark, tmp_path):
    import sqlite3
    import zipfile

    with sqlite3.connect(tmp_path / "m.db") as db:
        db.execute("create table t (k integer, v text, n real)")
        db.executemany("insert into t values (?, ?, ?)", [(1, "a", None), (2, None, 2.5)])
    assert values(tables.read_sqlite(spark, str(tmp_path / "m.db"), "t")) == [(1, "a", None), (2, None, 2.5)]
    df = spark.createDataFrame([(1, 'x,"y"\nz'), (2, None)], "k int, v string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert values(tables.read_csv(spark, str(tmp_path / "c"), df.schema)) == values(df)
    tables.write_json({"b": 1, "a": [2]}, tmp_path / "f.json")
    assert tables.read_json(tmp_path / "f.json") == {"a": [2], "b": 1}
    (tmp_path / "p.yaml").write_text("folds: 5\n")
    assert tables.read_protocol(tmp_path / "p.yaml") == {"folds": 5}
    with pytest.raises(FileNotFoundError):
        tables.read_protocol(tmp_path / "none.yaml")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("s1/a.html", '<link rel="canonical" href="http://a/1">')
        z.writestr("s1/b.html", "none")
    whole = archives.zip_entries(spark, str(tmp_path / "z.zip"))
    entries = archives.zip_entries(spark, str(tmp_path / "z.zip"), part_bytes=1)  # a task for each member
    assert entries.rdd.getNumPartitions() == 2 and sorted(entries.collect()) == sorted(whole.collect())
    assert archives.canonical("<p>" * 100_000 + "<LINK href='http://b' rel='canonical'>") == "http://b"
    assert values(entries, "name", "canonical") == [("s1/a.html", "http://a/1"), ("s1/b.html", None)]
    assert values(archives.archive_summary(entries, F.substring_index("name", "/", 1)), "season", "n") == [("s1", 2)]


def test_titles_behind_long_scripts_are_found(spark):
    df = spark.createDataFrame([("x" * 250_000 + "<title>late</title>",), ("<title>soon</title>",), (None,)], "html string")
    title = archives.extracted(F.col("html"), "<title>([^<]*)</title>")
    assert [r[0] for r in df.select(title).collect()] == ["late", "soon", None]


def test_filter_cost_and_incremental_search_the_penalty(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    y = 0.2 * x[:, 0] + rng.normal(size=60)
    df = spark.createDataFrame([tuple(map(float, (*r, v))) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    model, alpha = linear.ridge_cv(df, ["a", "b", "c"], "y")
    want, fixed = (linear.r_squared(df, m.column(), "y") for m in (model, linear.least_squares(linear.moments(df, ["a", "b", "c", "y"]), ["a", "b", "c"], "y", 1.0)))
    assert alpha != 1 and want != pytest.approx(fixed, abs=1e-7)
    got = {r["variant"]: r["r2"] for r in redundancy.filter_cost(df, df, ["a", "b", "c"], "y").collect()}
    assert got["all"] == pytest.approx(want, abs=1e-9)
    assert redundancy.incremental(df, df, [("ab", ["a", "b"]), ("c", ["c"])], "y").collect()[1]["r2"] == pytest.approx(want, abs=1e-9)
