"""Exploration of the panel: shape, persistence, premiums, redundancy, drift, breaks, models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import aggregates as agg
from ..operators import deflate, drift, elastic, linear, models, redundancy, relational, splits
from ..operators.boosting import MOST_CUTS, Boosting
from ..operators.preprocess import Preprocessor
from ..operators.stored import stored
from .case import Catalogue, model_table, panel, rounded, t, with_
from .evaluation import price_index

QUERIES = Catalogue()
FEATURES = ["quantity", "items", "orders", "returned", "accepted", "discount", "tax", "balance"]
#: What trees split by: none of it is the value that they learn, nor quantity, which nearly is.
TREE_FEATURES = ["items", "orders", "returned", "discount", "balance"]
LOGS = ["log_quantity", "log_items", "balance", "orders"]
EXTRA = ["returned", "discount", "tax"]


def _logged(df):
    return df.withColumns({"log_quantity": F.log1p("quantity"), "log_items": F.log1p("items"), "balance": F.col("balance") / 1000})


def _kept(df, *columns):
    """The columns that a query reads, written once: each pass over the panel would join and shuffle all orders again."""
    return stored(df.select(*columns))


@QUERIES.add(with_("panel") + """, f AS (SELECT segment || position AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY count(*) DESC, segment || position ROWS UNBOUNDED PRECEDING) AS c, sum(count(*)) OVER () AS tot FROM panel GROUP BY 1)
    SELECT (SELECT count(*) FROM panel) AS n, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis, round(median(value), 2) AS median, round(max(value), 2) AS largest,
           (SELECT count(*) FROM f) AS n_values, (SELECT count(*) FILTER (c / tot < 0.5) + 1 FROM f) AS for_50 FROM panel""")
def q1_target_shape(spark, d):
    p = _kept(panel(spark, d), "segment", "position", "value")
    s = agg.shape(p, [], "value").join(p.agg(F.round(F.max("value"), 2).alias("largest")), F.lit(True))
    s = s.join(agg.group_quantiles(p, [], "value", {"median": 0.5}).select(F.round("median", 2).alias("median")), F.lit(True))
    c = agg.concentration(p.withColumn("v", F.concat("segment", "position")), "v").select("n_values", "for_50")
    return rounded(s.join(c, F.lit(True)))


@QUERIES.add(with_("panel") + """, m AS (SELECT period, avg(y) AS m, median(y) AS md FROM panel GROUP BY 1)
    SELECT round(max(m) - min(m), 6) AS spread_of_means, round(max(md) - min(md), 6) AS spread_of_medians, round(100 * (exp(arg_max(m, period) - arg_min(m, period)) - 1), 6) AS growth FROM m""")
def q2_period_levels(spark, d):
    p = _kept(panel(spark, d), "period", "y")
    m = p.groupBy("period").agg(F.avg("y").alias("m")).join(agg.group_quantiles(p, ["period"], "y", {"md": 0.5}), "period")
    growth = numeric.percent_growth(F.max_by("m", "period") - F.min_by("m", "period"))
    return rounded(m.agg((F.max("m") - F.min("m")).alias("spread_of_means"), (F.max("md") - F.min("md")).alias("spread_of_medians"), growth.alias("growth")))


@QUERIES.add(with_("panel") + """ SELECT round(regr_slope(y, balance / 1000), 6) AS slope, round(regr_intercept(y, balance / 1000), 6) AS intercept, round(regr_r2(y, balance / 1000), 6) AS r2,
    round((SELECT 1 - var_pop(y - m) / var_pop(y) FROM (SELECT y, avg(y) OVER (PARTITION BY floor(balance / 1000)) AS m FROM panel)), 6) AS ceiling FROM panel""")
def q3_curve(spark, d):
    p = _kept(_logged(panel(spark, d)), "balance", "y")
    b = linear.polynomial(p, "balance", "y", 1)
    r2 = linear.variance_explained(p, F.lit(b[0]) + F.lit(b[1]) * F.col("balance"), "y")
    ceiling = linear.between_groups(p.withColumn("bin", F.floor("balance")), "bin", "y")
    return rounded(spark.createDataFrame([(b[1], b[0], r2, ceiling)], "slope double, intercept double, r2 double, ceiling double"))


@QUERIES.add(with_("panel") + """, curve AS (SELECT y, ln(1 + quantity) AS x FROM panel), slant AS (SELECT *, x * x - regr_intercept(x * x, x) OVER () - regr_slope(x * x, x) OVER () * x AS w FROM curve),
    bend AS (SELECT *, regr_slope(y, w) OVER () AS b2 FROM slant), line AS (SELECT *, regr_slope(y - b2 * x * x, x) OVER () AS b1, regr_intercept(y - b2 * x * x, x) OVER () AS b0 FROM bend)
    SELECT round(any_value(b0), 6) AS b0, round(any_value(b1), 6) AS b1, round(any_value(b2), 6) AS b2, round(any_value(-b1 / (2 * b2)), 6) AS vertex, round(1 - var_pop(y - b0 - b1 * x - b2 * x * x) / var_pop(y), 6) AS r2 FROM line""")
def q3_parabola(spark, d):
    p = _kept(_logged(panel(spark, d)), "log_quantity", "y")
    b = linear.polynomial(p, "log_quantity", "y", 2)
    fit = F.lit(b[0]) + F.lit(b[1]) * F.col("log_quantity") + F.lit(b[2]) * F.col("log_quantity") * F.col("log_quantity")
    return rounded(spark.createDataFrame([(*b, linear.vertex(b), linear.variance_explained(p, fit, "y"))], "b0 double, b1 double, b2 double, vertex double, r2 double"))


PAIRED = with_("panel") + """, r AS (SELECT *, dense_rank() OVER (ORDER BY period) AS place FROM panel),
    l AS (SELECT entity, place, y, lag(y) OVER w AS before, lag(place) OVER w AS p FROM r WINDOW w AS (PARTITION BY entity ORDER BY place))"""


@QUERIES.add(PAIRED + """ SELECT count(*) AS n_pairs, round(corr(y, before), 6) AS r, round(100 * avg(CASE WHEN abs(y - before) < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS near_same,
    (SELECT round(100 * avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT count(*) AS k FROM panel GROUP BY entity)) AS single_period FROM l WHERE p = place - 1""")
def q4_persistence(spark, d):
    p = _kept(panel(spark, d), "entity", "period", "y")
    places = relational.global_rank(p.select("period").distinct(), [F.col("period")], "place").withColumn("place", F.col("place").cast("int"))
    pairs = relational.lag_pairs(p.join(places, "period"), "entity", "place", "y")
    out = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("y", "y_before").alias("r"), (100 * F.avg(F.when(F.abs(F.col("y") - F.col("y_before")) < 0.05, 1.0).otherwise(0.0))).alias("near_same"))
    single = p.groupBy("entity").count().agg((100 * F.avg(F.when(F.col("count") == 1, 1.0).otherwise(0.0))).alias("single_period"))
    return rounded(out.join(single, F.lit(True)))


@QUERIES.add(with_("panel") + """, c AS (SELECT *, ln(1 + quantity) AS q FROM panel), f AS (SELECT *, regr_slope(y, q) OVER () AS b, regr_intercept(y, q) OVER () AS a FROM c)
    SELECT segment, count(*) AS n, round(avg(y - a - b * q), 6) + 0.0 AS premium, round(100 * (exp(avg(y - a - b * q)) - 1), 4) + 0.0 AS percent FROM f GROUP BY 1""")
def q5_premium(spark, d):
    p = _kept(_logged(panel(spark, d)), "segment", "log_quantity", "y")
    fit = linear.least_squares(linear.moments(p, ["log_quantity", "y"]), ["log_quantity"], "y")
    rest = p.withColumn("rest", F.col("y") - fit.column()).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("rest").alias("premium"))
    return rounded(rest.withColumn("percent", F.round(numeric.percent_growth(F.col("premium")), 4)))


@QUERIES.add()
def q6_filter_cost(spark, d):
    columns = [*FEATURES, "log_quantity", "log_items"]
    m = _kept(_logged(model_table(spark, d)).where("split in ('train', 'calibration')"), "split", "y", *columns)
    return rounded(redundancy.filter_cost(m.where("split = 'train'"), m.where("split = 'calibration'"), columns, "y"))


@QUERIES.add()
def q7_redundancy(spark, d):
    r = redundancy.matrix(panel(spark, d), FEATURES)
    block = redundancy.blocks(r)
    leads = set(redundancy.representatives(r, block))
    s = redundancy.spectrum(r)
    rows = [(f, b, i in leads, keep, s["for_90"], s["participation"]) for i, (f, b, keep) in enumerate(zip(FEATURES, block, redundancy.greedy_filter(r, 0.95), strict=True))]
    return rounded(spark.createDataFrame(rows, "feature string, block int, represents boolean, stays boolean, for_90 int, participation double"), 4)


@QUERIES.add(with_("panel") + """, p AS (SELECT segment, nullif(returned, 0) AS returned, y FROM panel)
    SELECT segment, count(*) FILTER (returned IS NULL) AS n_missing, round(count(*) FILTER (returned IS NULL) / count(*), 8) AS share,
           round(median(y) FILTER (returned IS NULL), 6) AS median_missing, round(median(y) FILTER (returned IS NOT NULL), 6) AS median_known FROM p GROUP BY 1""")
def q8_missingness(spark, d):
    p = _kept(panel(spark, d), "segment", F.nullif("returned", F.lit(0.0)).alias("returned"), "y")
    # One selection for both sides of all segments.
    sides = rounded(agg.group_quantiles(p.withColumn("gone", F.col("returned").isNull()), ["segment", "gone"], "y", {"q": 0.5}))
    side = lambda gone, name: F.max(F.when(F.col("gone") == gone, F.col("q"))).alias(name)
    medians = sides.groupBy("segment").agg(side(True, "median_missing"), side(False, "median_known"))
    return rounded(agg.missing(p, ["returned"], "segment").drop("feature"), 8).join(medians, "segment", "left")


@QUERIES.add(with_("panel") + """ SELECT least_quantity, count(*) AS n, count(DISTINCT entity) AS entities, round(stddev_samp(items / quantity) / avg(items / quantity), 6) AS cv, round(avg(y), 6) AS mean
    FROM panel, (SELECT unnest([50, 100, 150, 250])::INTEGER AS least_quantity) WHERE quantity >= least_quantity GROUP BY 1""")
def q9_threshold_sensitivity(spark, d):
    steps = F.explode(F.filter(F.array(*(F.lit(x) for x in (50, 100, 150, 250))), lambda x: x <= F.col("quantity"))).alias("least_quantity")
    rate = F.col("items") / F.col("quantity")
    rows = panel(spark, d).select("entity", "y", rate.alias("rate"), steps)
    return rounded(rows.groupBy("least_quantity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), (F.stddev_samp("rate") / F.avg("rate")).alias("cv"), F.avg("y").alias("mean")))


@QUERIES.add()
def q10_incremental(spark, d):
    m = _kept(_logged(model_table(spark, d)).where("split in ('train', 'calibration')"), "split", "y", "balance", "orders", "log_quantity", "log_items")
    steps = [("balance", ["balance"]), ("+ orders", ["orders"]), ("+ volume", ["log_quantity", "log_items"])]
    return rounded(redundancy.incremental(m.where("split = 'train'"), m.where("split = 'calibration'"), steps, "y"))


def psi_sql(c: str, a: str = "train", b: str = "test") -> str:
    return f"""SELECT '{c}' AS feature, round(sum((b - a) * ln(b / a)), 6) AS psi FROM (
        SELECT bin, greatest(count(*) FILTER (split = '{a}') / max(na), 0.0001) AS a, greatest(count(*) FILTER (split = '{b}') / max(nb), 0.0001) AS b FROM (
            SELECT split, len(list_filter(list_sort(list_distinct(list_transform(q, lambda v, i: CASE WHEN i = 1 OR i = 11 THEN NULL ELSE v END))), lambda e: e <= {c})) AS bin, na, nb
            FROM (SELECT split, {c} FROM model WHERE split IN ('{a}', '{b}')), (SELECT quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM model WHERE split = '{a}'),
                 (SELECT count(*) FILTER (split = '{a}') AS na, count(*) FILTER (split = '{b}') AS nb FROM model)) GROUP BY bin)"""


@QUERIES.add(with_("model") + " " + " UNION ALL ".join(psi_sql(c) for c in ("quantity", "value", "balance")))
def q11_psi(spark, d):
    columns = ["quantity", "value", "balance"]
    m = _kept(model_table(spark, d), "split", *columns)
    rows = stored(drift.long_form(m.where("split = 'train'"), m.where("split = 'test'"), columns))
    return rounded(spark.createDataFrame([(c, v[0]) for c, v in drift.stability(rows, columns).items()], "feature string, psi double"))


def ks_sql(c: str, a: str = "train", b: str = "test") -> str:
    return f"""SELECT '{c}' AS feature, ks, n_a, n_b, least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * scale * scale))))) AS p_value FROM (
        SELECT max(gap) AS ks, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, sqrt(max(na) * max(nb) / (max(na) + max(nb))) * max(gap) AS scale FROM (
            SELECT abs(sum(a) OVER o / sum(a) OVER () - sum(b) OVER o / sum(b) OVER ()) AS gap, sum(a) OVER () AS na, sum(b) OVER () AS nb
            FROM (SELECT {c} AS x, count(*) FILTER (split = '{a}') AS a, count(*) FILTER (split = '{b}') AS b FROM model WHERE split IN ('{a}', '{b}') AND {c} IS NOT NULL GROUP BY 1) WINDOW o AS (ORDER BY x)))"""


@QUERIES.add(with_("model") + f" SELECT round(ks, 8) AS ks, n_a, n_b, round(p_value, 8) AS p_value FROM ({ks_sql('value')})")
def q12_ks(spark, d):
    m = model_table(spark, d).where("split in ('train', 'test')")
    return rounded(drift.ks_statistic(m, "value", F.col("split") == "train"), 8)


@QUERIES.add()
def q12_ks_exact(spark, d):
    """Exact p-values by lattice paths, of all columns; tested against counted paths."""
    m = _kept(model_table(spark, d), "split", *DRIFTING)
    rows = stored(drift.long_form(m.where("split = 'test'"), m.where("split = 'held_out'"), DRIFTING))
    out = drift.with_exact(drift.distances(rows))
    return rounded(out.select("feature", "ks", "n_a", "n_b", drift.asymptotic(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("p_value"), "p_exact"), 8)


DRIFTING = ["quantity", "value", "returned", "balance"]


@QUERIES.add(with_("model") + ", stability AS (" + " UNION ALL ".join(psi_sql(c, "test", "held_out") for c in DRIFTING) + "), distance AS (" + " UNION ALL ".join(ks_sql(c, "test", "held_out") for c in DRIFTING) + "), means AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER (split = 'test') AS mean_a, avg({c}) FILTER (split = 'held_out') AS mean_b FROM model" for c in DRIFTING)
    + """) SELECT feature, CASE WHEN NOT isnan(psi) THEN psi END AS psi, round(ks, 6) AS ks, round(p_value, 6) AS ks_p, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
    CASE WHEN psi > 0.25 THEN 'large' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END AS band FROM stability JOIN distance USING (feature) JOIN means USING (feature)""")
def q12_drift_table(spark, d):
    m = _kept(model_table(spark, d), "split", *DRIFTING)
    return rounded(drift.drift_table(m.where("split = 'test'"), m.where("split = 'held_out'"), DRIFTING))


BREAKS = with_("panel") + """, m AS (SELECT period, avg(returned) AS returned, avg(quantity) AS quantity FROM panel GROUP BY 1),
    u AS (SELECT 'returned' AS feature, period, returned AS mean, (SELECT stddev_samp(returned) FROM panel) AS sd FROM m UNION ALL SELECT 'quantity', period, quantity, (SELECT stddev_samp(quantity) FROM panel) FROM m)"""


@QUERIES.add(BREAKS + """, j AS (SELECT *, abs(mean - lag(mean) OVER w) / sd AS jump, row_number() OVER w AS i, count(*) OVER (PARTITION BY feature) AS n FROM u WINDOW w AS (PARTITION BY feature ORDER BY period))
    SELECT feature, round(max(jump), 6) AS largest_jump, arg_max(period, (coalesce(jump, -1), -i)) AS jump_in, round(avg(mean) FILTER (i <= 2), 6) AS early, round(avg(mean) FILTER (i > n - 2), 6) AS late,
           round(100 * (arg_max(mean, period) - arg_min(mean, period)) / abs(arg_min(mean, period)), 6) AS change_percent FROM j GROUP BY 1""")
def q13_definition_breaks(spark, d):
    return rounded(drift.definition_breaks(_kept(panel(spark, d), "period", "returned", "quantity"), "period", ["returned", "quantity"]))


@QUERIES.add(BREAKS + " SELECT feature, period, round(abs(mean - (before + after) / 2) / sd, 6) AS anomaly FROM (SELECT *, lag(mean) OVER w AS before, lead(mean) OVER w AS after FROM u WINDOW w AS (PARTITION BY feature ORDER BY period)) WHERE before IS NOT NULL AND after IS NOT NULL")
def q13_local_anomaly(spark, d):
    return rounded(drift.local_anomaly(_kept(panel(spark, d), "period", "returned", "quantity"), "period", ["returned", "quantity"]))


@QUERIES.add(with_("panel") + " SELECT period, round(100 * avg(CASE WHEN round(returned + accepted - quantity, 6) = 0 THEN 1.0 ELSE 0.0 END), 6) AS percent FROM panel GROUP BY 1")
def q13_identity(spark, d):
    return rounded(drift.identity_share(panel(spark, d), "period", ["returned", "accepted"], "quantity"))


@QUERIES.add(with_("panel") + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, y), 6) AS r FROM panel" for c in FEATURES))
def q14_target_correlations(spark, d):
    return rounded(agg.with_target(panel(spark, d), FEATURES, "y"))


@QUERIES.add(with_("panel") + """, g AS (SELECT segment, corr(balance, y) AS r, count(*) AS n FROM panel GROUP BY 1)
    SELECT round((SELECT corr(balance, y) FROM panel), 6) AS overall, round(sum(r * n) / sum(n), 6) AS within, round(min(r), 6) AS least, round(max(r), 6) AS most FROM g""")
def q14_within_groups(spark, d):
    p = _kept(panel(spark, d), "segment", "balance", "y")
    g = p.groupBy("segment").agg(F.corr("balance", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    out = g.agg(agg.weighted_mean(F.col("r"), F.col("n")).alias("within"), F.min("r").alias("least"), F.max("r").alias("most"))
    return rounded(p.agg(F.corr("balance", "y").alias("overall")).join(out, F.lit(True)))


@QUERIES.add("""SELECT strftime(day, '%Y-%m-%d') AS day, n, round(n / t, 8) AS share FROM (SELECT ts::DATE AS day, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1)
    ORDER BY n DESC, day LIMIT 10""")
def q14_date_waves(spark, d):
    f = agg.frequencies(t(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")
    return rounded(relational.top(f.select("day", "n", "share"), [F.col("n").desc(), F.col("day")], 10), 8)


@QUERIES.add()
def x7_preprocessing(spark, d):
    """Rows and width of the features, and the largest mean of a scaled one (0)."""
    m = _logged(model_table(spark, d)).withColumn("returned", F.nullif("returned", F.lit(0.0)))
    numeric, categorical = ["log_quantity", "log_items", "balance", "returned", "quantity"], ["segment", "position"]
    train = _kept(m.where("split = 'train'"), *numeric, *categorical)
    p = Preprocessor(numeric=numeric, categorical=categorical, threshold=0.9).fit(train)
    from pyspark.ml.functions import vector_to_array

    x = p.transform(train).select(vector_to_array("features").alias("x"))
    width = sum("=" not in f for f in p.features())
    means = x.agg(*(F.avg(x.x[i]).alias(f"m{i}") for i in range(width))).first()
    return rounded(spark.createDataFrame([(train.count(), len(p.features()), max(abs(v) for v in means))], "n long, width int, largest_mean double"))


def _parts(spark, d):
    m = _kept(_logged(model_table(spark, d)), "entity", "split", "y", "segment", "position", *LOGS, *EXTRA)
    return {s: m.where(F.col("split") == s).drop("split") for s in ("train", "calibration", "test")}


@QUERIES.add()
def e1_elastic_net(spark, d):
    f = models.final_fit(_parts(spark, d), models.elastic_net(0.001, 0.5), LOGS, ["segment", "position"], "y", ["segment"])
    return rounded(f.metrics["test"], 4)


def _folds(spark, d):
    train = _parts(spark, d)["train"]
    return elastic.fold_moments(train.join(splits.fold_map(train, "entity", 3), "entity"), LOGS, ["segment"], "y", "fold")


@QUERIES.add()
def e8_grouped_validation(spark, d):
    """Fold scores of one elastic net from moments; tests hold them against fitted pipelines."""
    scores = elastic.path_scores(_folds(spark, d), [0.001], [0.5], scaled_label=True)
    return rounded(spark.createDataFrame([(f, s) for f, _, _, s in scores], "fold int, rmsle double"), 4)


@QUERIES.add()
def e8_elastic_net_path(spark, d):
    """Fold scores of 24 penalties from the same moments."""
    scores = elastic.path_scores(_folds(spark, d), [10.0**k for k in range(-5, 1)], [0.0, 0.3, 0.7, 1.0])
    return rounded(spark.createDataFrame(scores, "fold int, alpha double, l1_ratio double, rmsle double"))


@QUERIES.add()
def e10_search(spark, d):
    """Thirty trials of penalties, suggested by Parzen densities and scored from the moments of three folds."""
    log = models.search_elastic_net(_folds(spark, d), 30).log(spark)
    return rounded(log.select("trial", "state", "score", F.col("params")["alpha"].alias("alpha"), F.col("params")["l1_ratio"].alias("l1_ratio")))


def _vectors(spark, d):
    m = model_table(spark, d).where("split in ('train', 'calibration', 'test')")
    return m.select("entity", "period", "split", "y", array_to_vector(F.array(*(F.col(c).cast("double") for c in TREE_FEATURES))).alias("features"))


@QUERIES.add()
def e3_boosting(spark, d):
    """Predictions of test rows by trees that learn from training rows and stop by the others; tests search all splits."""
    m = stored(_vectors(spark, d).withColumn("stop", F.col("split") == "calibration"))
    model = Boosting(maxIter=12, maxDepth=3, stepSize=0.4, minChildWeight=5.0, labelCol="y", idCol="entity").stopping("stop", 3).fit(m.where("split <> 'test'"))
    return rounded(model.transform(m.where("split = 'test'")).select("entity", "period", "prediction", F.lit(model.getNumTrees).alias("trees")))


def split_sql(c: str) -> str:
    """Gain and leaves of each split of one feature, by window sums over the codes of its values."""
    cuts = "[" + ", ".join(str(j / MOST_CUTS) for j in range(MOST_CUTS + 1)) + "]"
    return f"""SELECT '{c}' AS feature, q[code + 1] AS threshold, sum(n) OVER w AS n_left, (sum(n) OVER ()) - n_left AS n_right, sum(g) OVER w AS g_left, (sum(g) OVER ()) - g_left AS g_right
        FROM (SELECT len(list_filter(q, lambda v: v < {c}))::INTEGER AS code, any_value(q) AS q, count(*) AS n, sum(base - y) AS g
              FROM t, (SELECT avg(y) AS base, list_sort(list_distinct(quantile_cont({c}::DOUBLE, {cuts})))[:-2] AS q FROM t) GROUP BY 1) WINDOW w AS (ORDER BY code)"""


@QUERIES.add(with_("model") + ", t AS (SELECT * FROM model WHERE split = 'train'), c AS (" + " UNION ALL ".join(map(split_sql, TREE_FEATURES)) + """),
    sp AS (SELECT *, g_left ** 2 / (n_left + 1) + g_right ** 2 / (n_right + 1) - (g_left + g_right) ** 2 / (n_left + n_right + 1) AS gain FROM c WHERE n_left >= 5 AND n_right >= 5)
    SELECT feature, round(threshold, 4) AS threshold, round(-g_left / (n_left + 1), 6) AS left_value, round(-g_right / (n_right + 1), 6) AS right_value FROM sp ORDER BY gain DESC LIMIT 1""")
def e3_first_split(spark, d):
    """The split of the largest gain over all features, and the Newton steps on its two sides."""
    m = _vectors(spark, d).where("split = 'train'")
    (tree,) = Boosting(maxIter=1, maxDepth=1, stepSize=1.0, minChildWeight=5.0, labelCol="y", idCol="entity").fit(m).learned()["trees"]
    row = (TREE_FEATURES[tree["feature"][0]], tree["threshold"][0], tree["value"][1], tree["value"][2])
    return rounded(spark.createDataFrame([row], "feature string, threshold double, left_value double, right_value double").withColumn("threshold", F.round("threshold", 4)))


@QUERIES.add()
def e12_variants(spark, d):
    m = stored(model_table(spark, d))
    index = deflate.extended_index(price_index(m), m, "period")
    real = _logged(deflate.deflate(m, index, "period", "value")).select("split", "y", "log_real", "factor", "segment", *LOGS, *EXTRA)
    parts = {s: real.where(F.col("split") == s).drop("split") for s in ("train", "calibration", "test")}
    features = {"numeric": LOGS, "categorical": ["segment"]}
    linear_model = {"estimator": models.elastic_net(0.001, 0.5), **features}
    runs = {
        "reference": linear_model,
        "deflated": {**linear_model, "fit_on": "log_real", "back": numeric.nominal(F.col("prediction"), F.col("factor"))},
        "extra": {**linear_model, "numeric": [*LOGS, *EXTRA]},
        "filtered": {**linear_model, "threshold": 0.95},
        "boosting": {"estimator": models.boosting(10, 3), "stop_on": "calibration", **features},
        "forest": {"estimator": models.random_forest(10, 5), **features},
    }
    best, out = models.variants(parts, runs, "y")
    return rounded(out.withColumn("best", F.lit(best)), 3)
