"""Uncertainty and explanation over the case's panel, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, explain, uncertainty
from ..operators.stored import stored
from .case import Catalogue, model_table, panel, rounded, with_

QUERIES = Catalogue()
REPLICATES = 40

SCORED = with_("model") + """, c AS (SELECT segment, median(y) AS p FROM model WHERE split = 'train' GROUP BY 1), sc AS (SELECT model.*, p FROM model JOIN c USING (segment))"""


def scored(spark, d):
    """The panel with its cell's training median as prediction, written once."""
    m = stored(model_table(spark, d))
    return stored(baselines.cell_median(m.where("split = 'train'"), m, "y", ["segment"], "p"))


@QUERIES.add(SCORED + f""", x AS (SELECT 'segment' AS axis, segment AS "group", concat_ws('|', entity, period) AS key, p - y AS off FROM sc WHERE split = 'test' UNION ALL
        SELECT 'position', position, concat_ws('|', entity, period), p - y FROM sc WHERE split = 'test'),
    r AS (SELECT -1 AS replicate UNION ALL SELECT unnest(range({REPLICATES}))),
    w AS (SELECT x.*, replicate, CASE WHEN replicate < 0 THEN 1 ELSE len(list_filter({uncertainty.POISSON}, lambda t: t <= ('0x' || substr(md5('1:' || key || '#' || (replicate // 4)), 1 + 8 * (replicate % 4), 8))::BIGINT)) END AS w FROM x, r),
    ws AS (SELECT axis, "group", replicate, sum(w) AS n, sum(w * off * off) AS q, sum(w * off) AS t FROM w WHERE w > 0 GROUP BY ALL),
    o AS (SELECT *, sum(n) OVER a - n AS rn, sum(q) OVER a - q AS rq, sum(t) OVER a - t AS rt FROM ws WINDOW a AS (PARTITION BY axis, replicate)),
    g AS (SELECT axis, "group", replicate, n, sqrt(q / n) - sqrt(rq / rn) AS gap, rt / rn - t / n AS bias FROM o WHERE rn > 0)
    SELECT axis, "group", max(n) FILTER (replicate < 0)::BIGINT AS n, round(max(gap) FILTER (replicate < 0), 6) AS gap, round(quantile_cont(gap, 0.025) FILTER (replicate >= 0), 6) AS gap_low, round(quantile_cont(gap, 0.975) FILTER (replicate >= 0), 6) AS gap_high,
           round(max(bias) FILTER (replicate < 0), 6) AS bias, round(quantile_cont(bias, 0.025) FILTER (replicate >= 0), 6) AS bias_low, round(quantile_cont(bias, 0.975) FILTER (replicate >= 0), 6) AS bias_high, count(*) FILTER (replicate >= 0) AS replicates
    FROM g GROUP BY 1, 2""")
def w5_group_gaps(spark, d):
    test = scored(spark, d).where("split = 'test'")
    return rounded(uncertainty.bootstrap_gaps(test, "y", "p", ["segment", "position"], ["entity", "period"], REPLICATES))


@QUERIES.add(SCORED + """, x AS (SELECT split, 'all' AS axis, 'all' AS "group", abs(y - p) AS off FROM sc UNION ALL SELECT split, 'segment', segment, abs(y - p) FROM sc UNION ALL SELECT split, 'position', position, abs(y - p) FROM sc),
    a AS (SELECT unnest([900, 800]) AS keep),
    k AS (SELECT axis, "group", off, row_number() OVER (PARTITION BY axis, "group" ORDER BY off) AS r, count(*) OVER (PARTITION BY axis, "group") AS n FROM x WHERE split = 'calibration'),
    q AS (SELECT axis, "group", keep, max(n) AS n_calibration, max(off) FILTER (r = ((n + 1) * keep + 999) // 1000) AS width FROM k, a GROUP BY ALL)
    SELECT axis, "group", round(1 - keep / 1000.0, 6)::DOUBLE AS alpha, coalesce(max(n_calibration), 0)::BIGINT AS n_calibration, count(*) AS n,
           round(avg(CASE WHEN width IS NULL OR off <= width THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS covered, round(2 * max(width), 6) AS width, round(exp(2 * max(width)), 6) AS factor
    FROM (SELECT * FROM x, a WHERE split = 'test') t LEFT JOIN q USING (axis, "group", keep) GROUP BY axis, "group", keep""")
def w3_conformal(spark, d):
    s = scored(spark, d)
    return rounded(uncertainty.conformal(s.where("split = 'calibration'"), s.where("split = 'test'"), "y", "p", ["segment", "position"]))


@QUERIES.add(with_("panel") + """, n AS (SELECT count(*)::BIGINT AS n, sum(CASE WHEN sign(a.quantity - b.quantity) * sign(a.returned - b.returned) > 0 THEN 1 WHEN sign(a.quantity - b.quantity) * sign(a.returned - b.returned) < 0 THEN -1 ELSE 0 END)::DOUBLE AS s,
        sum((a.quantity <> b.quantity)::INTEGER)::DOUBLE AS fx, sum((a.returned <> b.returned)::INTEGER)::DOUBLE AS fy
    FROM (SELECT * FROM panel) a JOIN (SELECT * FROM panel) b ON (a.entity, a.period) < (b.entity, b.period))
    SELECT (SELECT count(*) FROM panel) AS n, round(s / sqrt(fx * fy), 8) AS tau_b FROM n""")
def w4_kendall(spark, d):
    return rounded(explain.kendall_tau(panel(spark, d), "quantity", "returned"), 8)


FEATURES = ["quantity", "discount", "balance"]
RATE = "(SELECT sum(value) / sum(quantity) FROM model WHERE split = 'train')"


def predictor(spark, train):
    """A prediction from two of three features: quantity at the training rows' price, less a tenth of the discount."""
    rate = train.agg(F.sum("value") / F.sum("quantity")).first()[0]
    return lambda df: df.withColumn("prediction", F.ln(1 + F.col("quantity") * F.lit(rate) * (1 - F.col("discount") / 10 / F.col("items"))))


P_SQL = "ln(1 + {q} * rate * (1 - {dd} / 10 / items))"


@QUERIES.add(with_("model") + f""", t AS (SELECT *, {RATE} AS rate, row_number() OVER (ORDER BY md5(concat_ws('|', entity, period)), entity, period) - 1 AS rank, count(*) OVER () AS total FROM model WHERE split = 'test'),
    j AS (SELECT t.*, s, o.quantity AS oq, o.discount AS od FROM t, (SELECT unnest([1, 2, 3]) AS s) JOIN t o ON o.rank = (t.rank + s) % t.total),
    e AS (SELECT 'quantity' AS feature, sqrt(avg((y - {P_SQL.format(q='oq', dd='discount')}) ** 2)) AS r FROM j GROUP BY s UNION ALL SELECT 'discount', sqrt(avg((y - {P_SQL.format(q='quantity', dd='od')}) ** 2)) FROM j GROUP BY s UNION ALL
          SELECT 'balance', sqrt(avg((y - {P_SQL.format(q='quantity', dd='discount')}) ** 2)) FROM j GROUP BY s),
    b AS (SELECT sqrt(avg((y - {P_SQL.format(q='quantity', dd='discount')}) ** 2)) AS rmsle, count(*) AS n FROM t)
    SELECT feature, n, round(rmsle, 6) AS rmsle, round(avg(r), 6) AS permuted, round(avg(r) - rmsle, 6) + 0.0 AS importance FROM e, b GROUP BY feature, n, rmsle""")
def w4_importance(spark, d):
    m = stored(model_table(spark, d))
    out = explain.permutation_importance(m.where("split = 'test'"), predictor(spark, m.where("split = 'train'")), "y", FEATURES, ["entity", "period"])
    return rounded(out)


def ale_sql(c: str) -> str:
    at = lambda v: P_SQL.format(q=v if c == "quantity" else "quantity", dd=v if c == "discount" else "discount")
    return f"""SELECT '{c}' AS feature, bin, e[bin] AS low, e[bin + 1] AS high, count(*) AS n, avg({at('e[bin + 1]')} - {at('e[bin]')}) AS step
        FROM (SELECT t.*, e, greatest(len(list_filter(e, lambda v: v < {c})), 1)::INTEGER AS bin FROM t, (SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM t)) GROUP BY bin, e"""


@QUERIES.add(with_("model") + f", t AS (SELECT *, {RATE} AS rate FROM model WHERE split = 'test'), st AS (" + " UNION ALL ".join(map(ale_sql, FEATURES)) + """),
    u AS (SELECT *, sum(step) OVER (PARTITION BY feature ORDER BY bin) AS upto FROM st)
    SELECT feature, bin, round(low, 4) AS low, round(high, 4) AS high, n, round(upto - sum(upto * n) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature), 6) + 0.0 AS effect FROM u""")
def w4_local_effects(spark, d):
    m = stored(model_table(spark, d))
    out = explain.local_effects(m.where("split = 'test'"), predictor(spark, m.where("split = 'train'")), FEATURES)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("low", "high")}))
