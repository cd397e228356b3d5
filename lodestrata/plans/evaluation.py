"""Aggregations, splits, deflation, baselines and metrics over the case's panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numeric
from ..operators import aggregates as agg
from ..operators import baselines, deflate, metrics, splits
from ..operators.stored import stored
from .case import HELD_OUT, Catalogue, events, exact, model_table, panel, rounded, t, with_

QUERIES = Catalogue()
CELL = ["segment"]


@QUERIES.add(with_("ev") + " SELECT entity, period, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, count(*) AS items, count(DISTINCT o_orderkey) AS orders FROM ev GROUP BY 1, 2")
def a2_named_aggregates(spark, d):
    return events(spark, d).groupBy("entity", "period").agg(exact("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("items"), F.count_distinct("o_orderkey").alias("orders"))


@QUERIES.add("SELECT o_custkey, min(c_mktsegment) AS c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a3_constant(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return agg.constant(o, "o_custkey", "c_mktsegment")


@QUERIES.add(with_("ev") + """ SELECT entity, period, o_orderpriority FROM ev GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY sum(l_quantity::DECIMAL(18,2)) DESC, o_orderpriority) = 1""")
def a4_weighted_argmax(spark, d):
    return agg.weighted_argmax(events(spark, d).withColumn("w", F.col("l_quantity").cast("decimal(18,2)")), ["entity", "period"], "o_orderpriority", "w")


@QUERIES.add("SELECT user_id, event_type FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1")
def a5_mode(spark, d):
    return agg.most_frequent(t(spark, d, "events"), "user_id", "event_type")


@QUERIES.add("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values, count(DISTINCT o_orderpriority) > 1 AS several FROM orders GROUP BY 1")
def a6_distinct(spark, d):
    return agg.distinct_count(t(spark, d, "orders"), "o_custkey", "o_orderpriority")


@QUERIES.add("SELECT o_custkey, (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::INTEGER AS days FROM orders GROUP BY 1")
def a7_spread(spark, d):
    return agg.date_spread(t(spark, d, "orders"), "o_custkey", "o_orderdate")


@QUERIES.add("SELECT unnest([0.0, 0.1, 0.5, 0.9]::DOUBLE[]) AS p, round(unnest(quantile_cont(o_totalprice, [0.0, 0.1, 0.5, 0.9])), 6) AS q FROM orders")
def a8_quantiles(spark, d):
    p = [0.0, 0.1, 0.5, 0.9]
    q = agg.quantiles(t(spark, d, "orders"), "o_totalprice", p)
    return rounded(spark.createDataFrame(list(zip(p, q, strict=True)), "p double, q double"))


@QUERIES.add("SELECT o_orderpriority, count(o_totalprice) AS n, round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def a10_summary(spark, d):
    return rounded(agg.summary(t(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4)


FREQUENCIES = """SELECT p_size, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_size) AS rank, sum(count(*)) OVER () AS total,
    sum(count(*)) OVER (ORDER BY count(*) DESC, p_size ROWS UNBOUNDED PRECEDING) AS c FROM part GROUP BY 1"""


@QUERIES.add(f"SELECT p_size, n, round(n / total, 8) AS share, rank::INTEGER AS rank, round(c / total, 8) AS up_to FROM ({FREQUENCIES})")
def a11_frequencies(spark, d):
    return rounded(agg.frequencies(t(spark, d, "part"), "p_size"), 8)


@QUERIES.add(f"SELECT count(*) AS n_values, count(*) FILTER (c / total < 0.5) + 1 AS for_50, count(*) FILTER (c / total < 0.9) + 1 AS for_90, round(max(c / total) FILTER (rank <= 10), 8) AS top_10_share FROM ({FREQUENCIES})")
def a11_concentration(spark, d):
    return rounded(agg.concentration(t(spark, d, "part"), "p_size"), 8)


@QUERIES.add("SELECT o_orderpriority, count(*) AS n, round(skewness(o_totalprice), 6) AS skewness, round(kurtosis(o_totalprice), 6) AS kurtosis FROM orders GROUP BY 1")
def a12_shape(spark, d):
    return rounded(agg.shape(t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"))


@QUERIES.add(with_("panel") + " SELECT round(max(m) - min(m), 6) AS spread FROM (SELECT avg(y) AS m FROM panel GROUP BY period)")
def a13_spread_of_means(spark, d):
    return rounded(agg.spread_of_means(panel(spark, d), "period", "y"))


@QUERIES.add("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean FROM orders")
def a14_group_mean(spark, d):
    return rounded(agg.with_group_mean(t(spark, d, "orders"), "o_custkey", "o_totalprice", "mean").select("o_orderkey", "mean"))


@QUERIES.add(with_("panel") + """ SELECT feature, round(cv, 6) AS cv FROM (UNPIVOT (SELECT stddev_samp(quantity) / avg(quantity) AS quantity, stddev_samp(value) / avg(value) AS value,
    stddev_samp(returned) / avg(returned) AS returned FROM panel) ON quantity, value, returned INTO NAME feature VALUE cv)""")
def a15_variation(spark, d):
    return rounded(agg.variation(panel(spark, d), ["quantity", "value", "returned"]))


@QUERIES.add(with_("panel") + " SELECT segment, round(sum(returned) / sum(quantity), 8) AS ratio FROM panel GROUP BY 1")
def a17_ratio_of_sums(spark, d):
    return rounded(agg.ratio_of_sums(panel(spark, d), "segment", "returned", "quantity"), 8)


@QUERIES.add("""SELECT c_mktsegment, count(*) AS n_before, count(*) FILTER (c_acctbal > 500) AS n_after,
    round(100 * (1 - count(*) FILTER (c_acctbal > 500) / count(*)), 6) AS lost FROM customer GROUP BY 1""")
def a18_coverage_loss(spark, d):
    c = t(spark, d, "customer")
    return rounded(agg.coverage_loss(c, c.where("c_acctbal > 500"), "c_mktsegment"))


NULLED = "SELECT c_mktsegment, nullif(greatest(c_acctbal, 0), 0) AS balance, nullif(c_nationkey, 3) AS nation FROM customer"


@QUERIES.add(f"""SELECT c_mktsegment, 'balance' AS feature, count(*) FILTER (balance IS NULL) AS n_missing, round(count(*) FILTER (balance IS NULL) / count(*), 8) AS share FROM ({NULLED}) GROUP BY 1
    UNION ALL SELECT c_mktsegment, 'nation', count(*) FILTER (nation IS NULL), round(count(*) FILTER (nation IS NULL) / count(*), 8) FROM ({NULLED}) GROUP BY 1""")
def a19_missing(spark, d):
    c = t(spark, d, "customer").select("c_mktsegment", F.nullif(F.greatest("c_acctbal", F.lit(0.0)), F.lit(0.0)).alias("balance"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return rounded(agg.missing(c, ["balance", "nation"], "c_mktsegment"), 8)


@QUERIES.add("""WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), e AS (
    SELECT n, (sum(n) OVER (PARTITION BY a)) * (sum(n) OVER (PARTITION BY b)) / (sum(n) OVER ()) AS e, a, b, sum(n) OVER () AS t FROM n),
    x AS (SELECT sum(n * n / e) - max(t) AS chi2, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::BIGINT AS dof FROM e)
    SELECT round(chi2, 6) AS chi2, dof, round(exp(-chi2 / 2) * list_sum(list_transform(range(dof // 2), lambda i: pow(chi2 / 2, i) / gamma(i + 1))), 6) AS p_value FROM x""")
def a20_independence(spark, d):
    return rounded(agg.independence(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


FEATURES = ["quantity", "value", "returned", "discount", "tax", "balance"]
PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@QUERIES.add(with_("panel") + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM panel" for a, b in PAIRS))
def a23_correlations(spark, d):
    return rounded(agg.correlations(panel(spark, d), FEATURES))


@QUERIES.add(with_("panel") + " " + " UNION ALL ".join(f"SELECT period, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM panel GROUP BY 1" for a, b in PAIRS[:3]))
def a24_grouped_correlations(spark, d):
    return rounded(agg.correlations(panel(spark, d), FEATURES, ["period"]).where(F.concat_ws(",", "a", "b").isin([f"{a},{b}" for a, b in PAIRS[:3]])))


@QUERIES.add(with_("panel") + """, f AS (SELECT entity, period, coalesce(returned, median(returned) OVER ()) AS returned, coalesce(n, median(n) OVER ()) AS n FROM (SELECT *, nullif(orders, 1)::DOUBLE AS n FROM panel))
    SELECT entity, period, round((returned - avg(returned) OVER ()) / stddev_samp(returned) OVER (), 6) AS returned, round((n - avg(n) OVER ()) / stddev_samp(n) OVER (), 6) AS n FROM f""")
def a26_standardised(spark, d):
    p = stored(panel(spark, d)).select("entity", "period", "returned", F.nullif("orders", F.lit(1)).cast("double").alias("n"))
    return rounded(agg.standardised(p, ["returned", "n"]))


@QUERIES.add("""SELECT o_orderpriority, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
    round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1""")
def a28_five_numbers(spark, d):
    return rounded(agg.five_numbers(t(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4)


# Splits


@QUERIES.add(with_("panel") + """, k AS (SELECT *, CASE WHEN domain = 'EUROPE' THEN 'held_out' WHEN period = 1995 THEN 'train' WHEN period = 1999 THEN 'calibration' WHEN period = 2000 THEN 'test' ELSE '' END AS split FROM panel)
    SELECT entity, period, split, split <> 'train' AND entity IN (SELECT entity FROM k WHERE split = 'train') AS known FROM k""")
def f1_split(spark, d):
    parts = {"train": [1995], "calibration": [1999], "test": [2000]}
    return splits.split(stored(panel(spark, d).select("entity", "period", "domain")), "period", "domain", parts, HELD_OUT, "entity", strict=False).select("entity", "period", "split", "known")


@QUERIES.add(with_("model") + """, g AS (SELECT entity, count(*) AS n FROM model WHERE split = 'train' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, entity) - 1 AS i FROM g)
    SELECT entity, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INTEGER AS fold FROM r""")
def f3_group_folds(spark, d):
    return splits.fold_map(model_table(spark, d).where("split = 'train'"), "entity", 5)


@QUERIES.add(with_("model").replace("WITH", "WITH RECURSIVE", 1) + """, g AS (SELECT entity, count(*) AS n FROM model WHERE split = 'train' GROUP BY 1), r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, entity) AS i FROM g),
    deal AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS lightest UNION ALL
        SELECT r.i, list_transform(loads, lambda v, k: v + CASE WHEN k = list_position(loads, list_min(loads)) THEN n ELSE 0 END), list_position(loads, list_min(loads)) - 1 FROM deal JOIN r ON r.i = deal.i + 1)
    SELECT entity, lightest::INTEGER AS fold FROM deal JOIN r USING (i)""")
def f3_balanced_folds(spark, d):
    return splits.balanced_folds(model_table(spark, d).where("split = 'train'"), "entity", 5)


@QUERIES.add(with_("model") + """, g AS (SELECT entity, count(*) AS n FROM model WHERE split = 'train' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, entity) - 1 AS i FROM g),
    f AS (SELECT n, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INTEGER AS fold FROM r)
    SELECT fold, (sum(sum(n)) OVER () - sum(n))::BIGINT AS n_train, sum(n)::BIGINT AS n_val, (sum(count(*)) OVER () - count(*))::BIGINT AS groups_train, count(*) AS groups_val, 0::BIGINT AS shared FROM f GROUP BY fold""")
def f4_fold_summary(spark, d):
    train = stored(model_table(spark, d).where("split = 'train'").select("entity"))
    return splits.fold_summary(train, splits.fold_map(train, "entity", 5), "entity")


@QUERIES.add(with_("model") + """, n AS (SELECT split, count(DISTINCT entity) AS g FROM model GROUP BY 1), e AS (SELECT DISTINCT split, entity FROM model),
    sh AS (SELECT x.split AS a, y.split AS b, count(*) AS c FROM e x JOIN e y USING (entity) WHERE x.split < y.split GROUP BY 1, 2)
    SELECT p.split AS a, q.split AS b, 0::BIGINT AS shared_keys, coalesce(c, 0)::BIGINT AS shared_groups, round(coalesce(c, 0) / q.g, 8) AS share_of_b
    FROM n p JOIN n q ON p.split < q.split LEFT JOIN sh ON sh.a = p.split AND sh.b = q.split""")
def f6_overlap(spark, d):
    return rounded(splits.overlap(stored(model_table(spark, d).select("split", "entity", "period")), "split", ["entity", "period"], "entity"), 8)


# Deflation

INDEX = with_("model") + """, tr AS (SELECT *, floor((balance + 1000) / 2750)::INTEGER AS bin FROM model WHERE split = 'train'),
    c AS (SELECT period, bin, segment, avg(ln(value)) AS m, count(*) AS n FROM tr GROUP BY 1, 2, 3),
    st AS (SELECT period AS earlier, lead(period) OVER (ORDER BY period) AS later FROM (SELECT DISTINCT period FROM tr)),
    ch AS (SELECT later, sum((b.m - a.m) * a.n) / sum(a.n) AS change FROM st JOIN c a ON a.period = earlier JOIN c b ON b.period = later AND a.bin = b.bin AND a.segment = b.segment
           WHERE a.n >= 20 AND b.n >= 20 GROUP BY 1),
    ix AS (SELECT period, exp(sum(coalesce(change, 0)) OVER (ORDER BY period)) AS factor FROM (SELECT DISTINCT period FROM tr) LEFT JOIN ch ON later = period)"""


def price_index(m):
    train = m.where("split = 'train'").withColumn("bin", F.floor((F.col("balance") + 1000) / 2750))
    return deflate.chained_index(train, "period", ["bin", "segment"], "value")


@QUERIES.add(INDEX + " SELECT period, round(factor, 8) AS factor FROM ix")
def d1_chained_index(spark, d):
    return rounded(price_index(stored(model_table(spark, d).select("split", "period", "balance", "segment", "value"))), 8)


@QUERIES.add(INDEX + """, f AS (SELECT m.*, coalesce(factor, (SELECT arg_max(factor, period) FROM ix)) AS factor FROM model m LEFT JOIN ix USING (period))
    SELECT entity, period, round(factor, 8) AS factor, round(value / factor, 2) AS real, round(ln(1 + value / factor), 8) AS log_real, round(ln(1 + value), 8) AS nominal FROM f""")
def d3_deflate(spark, d):
    m = stored(model_table(spark, d).select("entity", "split", "period", "balance", "segment", "value"))
    index = deflate.extended_index(price_index(m), m, "period")
    out = deflate.deflate(m, index, "period", "value")
    return rounded(out.select("entity", "period", "factor", F.round("real", 2).alias("real"), "log_real", numeric.nominal(F.col("log_real"), F.col("factor")).alias("nominal")), 8)


# Baselines and metrics

MEDIANS = with_("model") + """, w AS (SELECT median(y) AS m FROM model WHERE split = 'train'), c AS (SELECT segment, position, median(y) AS m FROM model WHERE split = 'train' AND position <> '5-LOW' GROUP BY 1, 2),
    b AS (SELECT t.*, (SELECT m FROM w) AS global, coalesce(c.m, (SELECT m FROM w)) AS cell, c.m IS NULL AS cell_filled FROM model t LEFT JOIN c USING (segment, position) WHERE split IN ('calibration', 'test'))"""


@QUERIES.add(MEDIANS + " SELECT entity, period, round(global, 8) AS global, round(cell, 8) AS cell, cell_filled FROM b")
def b2_medians(spark, d):
    m = stored(model_table(spark, d))
    train, target = m.where("split = 'train'"), m.where("split in ('calibration', 'test')").select("entity", "period", "segment", "position")
    out = baselines.global_median(train, target, "y", "global").join(
        baselines.cell_median(train.where("position <> '5-LOW'").unionByName(train.where("position = '5-LOW'").withColumn("segment", F.lit(None).cast("string"))), target, "y", ["segment", "position"], "cell").select("entity", "period", "cell", "cell_filled"), ["entity", "period"]
    )
    return rounded(out.select("entity", "period", "global", "cell", "cell_filled"), 8)


CARRIED = MEDIANS + """, h AS (SELECT entity, period + 1 AS period, y AS carried FROM model WHERE split <> 'held_out'),
    f AS (SELECT b.*, h.carried FROM b LEFT JOIN h USING (entity, period))"""


def _carried(spark, d):
    m = stored(model_table(spark, d))
    train, target = m.where("split = 'train'"), m.where("split in ('calibration', 'test')")
    out = baselines.carried_forward(m.where("split <> 'held_out'"), target, "entity", "period", "y", dates.previous_year, "carried")
    out = baselines.global_median(train, out, "y", "global")
    return baselines.filled(out, "carried", "global", "full")


@QUERIES.add(CARRIED + " SELECT entity, period, round(carried, 8) AS carried, carried IS NOT NULL AS covered, round(coalesce(carried, global), 8) AS full, carried IS NULL AS filled FROM f")
def b3_carried_forward(spark, d):
    out = _carried(spark, d).select("entity", "period", "carried", F.col("carried_covered").alias("covered"), "full", F.col("full_filled").alias("filled"))
    return rounded(out, 8)


def measures(p: str, y: str = "y", duan: str = "1.0") -> str:
    off, truth = f"abs((exp({p}) - 1) - (exp({y}) - 1))", f"(exp({y}) - 1)"
    return f"""count(*) AS n, round(sqrt(avg(({p} - {y}) ** 2)), 6) AS rmsle, round(exp(sqrt(avg(({p} - {y}) ** 2))), 6) AS multiple,
        round(100 * median({off} / {truth}), 4) AS mdape, CASE WHEN var_pop({y}) > 0 THEN round(1 - sum(({y} - {p}) ** 2) / (var_pop({y}) * count(*)), 6) END AS r2_log,
        round(avg({off}), 2) AS mae, round(100 * avg({off} / {truth}), 4) AS mape, round(sum(exp({p}) - 1) / sum({truth}), 6) AS aggregate,
        round(sum(exp({p}) * {duan} - 1) / sum({truth}), 6) AS aggregate_corrected"""


def tidy(df):
    digits = {"mae": 2, "mdape": 4, "mape": 4}
    return df.select(*(F.when(~F.isnan(c), F.round(F.col(c), digits.get(c, 6)) + F.lit(0.0)).alias(c) if ty == "double" else F.col(c) for c, ty in df.dtypes))


STRATA = with_("model") + """, e AS (SELECT DISTINCT entity FROM model WHERE split = 'train' AND period = 1995),
    w AS (SELECT median(y) AS m FROM model WHERE split = 'train'), c AS (SELECT segment, median(y) AS m FROM model WHERE split = 'train' GROUP BY 1),
    du AS (SELECT avg(exp(y - m)) AS duan FROM model JOIN c USING (segment) WHERE split = 'train'),
    b AS (SELECT y, segment, m AS p, position, CASE WHEN entity IN (SELECT entity FROM e) THEN 'True' ELSE 'False' END AS known, (SELECT duan FROM du) AS duan FROM model JOIN c USING (segment) WHERE split = 'test')"""


@QUERIES.add(STRATA + f""", x AS (SELECT 'all' AS axis, 'all' AS "group", * FROM b UNION ALL SELECT 'segment', segment, * FROM b UNION ALL SELECT 'position', position, * FROM b UNION ALL SELECT 'known', known, * FROM b)
    SELECT axis, "group", {measures("p", duan="max(duan)").replace("sum(exp(p) * max(duan) - 1)", "sum(exp(p) * duan - 1)")} FROM x GROUP BY 1, 2""")
def m10_stratified_metrics(spark, d):
    """Panel, split, cell medians, smearing and metrics by stratum: the whole way."""
    m = stored(model_table(spark, d))
    train = m.where("split = 'train'")
    early = train.where("period = 1995").select("entity").distinct().withColumn("k", F.lit(True))
    test = m.where("split = 'test'").join(early, "entity", "left").withColumn("known", F.coalesce("k", F.lit(False)))
    duan = metrics.smearing(baselines.cell_median(train, train, "y", CELL), "y", "prediction")
    scored = baselines.cell_median(train, test, "y", CELL)
    return tidy(metrics.evaluate(scored, "y", "prediction", ["segment", "position", "known"], duan))


@QUERIES.add(STRATA + """, g AS (SELECT segment, m AS p, y FROM model JOIN c USING (segment) WHERE split = 'train') SELECT round(avg(exp(y - p)), 8) AS duan, count(*) AS n FROM g""")
def m8_smearing(spark, d):
    train = stored(model_table(spark, d).where("split = 'train'"))
    scored = baselines.cell_median(train, train, "y", CELL)
    return rounded(spark.createDataFrame([(metrics.smearing(scored, "y", "prediction"), train.count())], "duan double, n long"), 8)


@QUERIES.add(CARRIED + f"""SELECT 'covered' AS baseline, {measures("carried")} FROM f WHERE carried IS NOT NULL UNION ALL SELECT 'full', {measures("coalesce(carried, global)")} FROM f
    UNION ALL SELECT 'global', {measures("global")} FROM f""")
def b5_baseline_metrics(spark, d):
    out = stored(_carried(spark, d))
    runs = {"covered": (out.where("carried_covered"), "carried"), "full": (out, "full"), "global": (out, "global")}
    parts = [metrics.evaluate(df, "y", p).drop("axis", "group").withColumn("baseline", F.lit(name)) for name, (df, p) in runs.items()]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@QUERIES.add(STRATA + """, q AS (SELECT quantile_cont(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM b),
    x AS (SELECT 'segment' AS axis, segment AS "group", y, p FROM b UNION ALL SELECT 'decile', len(list_filter(list_sort(list_distinct(q))[2:-2], lambda e: e < y))::VARCHAR, y, p FROM b, q)
    SELECT axis, "group", count(*) AS n, round(avg(y - p), 6) + 0.0 AS mean, round(stddev_pop(y - p), 6) AS sd, round(avg(p), 6) AS mean_prediction FROM x GROUP BY 1, 2""")
def m11_residuals(spark, d):
    m = stored(model_table(spark, d))
    scored = baselines.cell_median(m.where("split = 'train'"), m.where("split = 'test'"), "y", CELL)
    return rounded(metrics.residuals(agg.quantile_bins(scored, "y", 10, "decile"), "y", "prediction", ["segment", "decile"]))
