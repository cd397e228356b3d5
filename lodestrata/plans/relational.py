"""Scans, expressions, joins, sets and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numeric, text
from ..operators import aggregates as agg
from ..operators import checks, relational
from ..operators.stored import shared_folder, stored
from ..sources import archives, files, provenance
from .case import Catalogue, panel, rounded, t, with_

QUERIES = Catalogue()
CODES = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "middle", "5-LOW": "low"}
REGIONS = {"first": ["NATION_0", "NATION_1", "NATION_2"], "second": ["NATION_5", "NATION_7"]}


@QUERIES.add("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS status FROM orders")
def s2_chain_join(spark, d):
    o = t(spark, d, "orders").unionByName(t(spark, d, "orders"))
    parts = relational.load_tables(
        {"keys": o.select("o_orderkey", "o_custkey"), "money": o.select("o_orderkey", "o_totalprice", "o_orderdate"), "state": o.select("o_orderkey", "o_orderstatus")},
        ["o_orderkey"],
        drop={"money": ["o_orderdate"]},
        rename={"state": {"o_orderstatus": "status"}},
    )
    return relational.chain_join(list(parts.values()), "o_orderkey")


@QUERIES.add("""WITH h AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
    s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b, sum(('0x' || substr(h, 31, 15))::BIGINT) AS c, sum(('0x' || substr(h, 46, 15))::BIGINT) AS d FROM h)
    SELECT 'orders' AS what, n, sha256(concat_ws('-', a, b, c, d)) AS sha256 FROM s""")
def s9_fingerprint(spark, d):
    a = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    same = provenance.fingerprint(a).first() == provenance.fingerprint(a.repartition(7)).first()
    return provenance.fingerprint(a).select(F.lit("orders" if same else "differs").alias("what"), "n", "sha256")


@QUERIES.add("SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS size, nullif(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def s12_zip_pages(spark, d):
    """Pages packed into ZIP files in the shared folder, then read by tasks that share archives."""
    folder = shared_folder(spark)
    pages = t(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), "html")
    files.write_zip(pages, "name", "html", folder).agg(F.sum("members")).first()
    back = files.read_zip(spark, folder, part_bytes=1 << 20)
    page = F.decode("content", "UTF-8")
    return back.select(F.substring_index("name", ".", 1).cast("long").alias("page_id"), "size", archives.extracted(page, "<title>([^<]*)</title>").alias("title"))


@QUERIES.add("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 100 AND c_custkey >= 10")
def s1_sqlite_rows(spark, d):
    """Customers in SQLite files in the shared folder, read in ranges of row ids with pushed filters."""
    folder = shared_folder(spark).removeprefix("file://")
    files.write_sqlite(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "customer", folder).agg(F.sum("members")).first()
    return files.read_sqlite(spark, folder, "customer", rows=500).where("c_acctbal > 100 and c_custkey >= 10")


@QUERIES.add("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def s12_page_scan(spark, d):
    return t(spark, d, "pages").select("page_id", archives.extracted(F.col("html"), "<title>([^<]*)</title>").alias("title"))


@QUERIES.add("""SELECT count(*) FILTER (a) AS n_left, count(*) FILTER (b) AS n_right, count(*) FILTER (a AND b) AS n_both,
    count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right FROM (
    SELECT coalesce(x.k, y.k), x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders) x
    FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) y ON x.k = y.k)""")
def s13_reconcile(spark, d):
    a = t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return relational.reconcile(a, b, "k")


@QUERIES.add("""SELECT l_suppkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS l_quantity, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS l_extendedprice,
    sum(l_discount::DECIMAL(18,2))::DOUBLE AS l_discount, sum(l_tax::DECIMAL(18,2))::DOUBLE AS l_tax FROM lineitem GROUP BY 1""")
def a1_counter_sums(spark, d):
    lines = t(spark, d, "lineitem")
    skip = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
    names = agg.counters(lines, skip)
    out = agg.sums(lines.withColumns({c: F.col(c).cast("decimal(18,2)") for c in names}), "l_suppkey", names)
    return out.withColumns({c: F.col(c).cast("double") for c in names})


@QUERIES.add("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 AND c_acctbal BETWEEN 100 AND 5000 AND nullif(c_name, '') IS NOT NULL")
def p5_filters(spark, d):
    c = t(spark, d, "customer").where(F.nullif("c_name", F.lit("")).isNotNull() & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return checks.require_columns(c.where((F.col("c_acctbal") > 0) & F.col("c_acctbal").between(100, 5000)), ["c_custkey", "c_name", "c_mktsegment"])


@QUERIES.add("""SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', -1) AS last,
    trim(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS plain FROM part""")
def p11_text(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", text.first_part(F.col("p_name"), " ").alias("first"), text.last_word(F.col("p_name")).alias("last"), text.plain_name(F.concat_ws(" ", "p_brand", "p_type")).alias("plain"))


@QUERIES.add("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'middle' WHEN '5-LOW' THEN 'low' END AS level FROM orders""")
def p12_mapping(spark, d):
    return t(spark, d, "orders").select("o_orderkey", text.mapped(F.col("o_orderpriority"), CODES).alias("level"))


@QUERIES.add("""SELECT n_nationkey, CASE WHEN code IN ('NATION_0', 'NATION_1', 'NATION_2') THEN 'first' WHEN code IN ('NATION_5', 'NATION_7') THEN 'second'
    WHEN code IS NOT NULL THEN 'rest' END AS class FROM (SELECT n_nationkey, nullif(n_name, 'NATION_9') AS code FROM nation)""")
def p13_classes(spark, d):
    n = t(spark, d, "nation").withColumn("code", F.nullif("n_name", F.lit("NATION_9")))
    return n.select("n_nationkey", text.classed(F.col("code"), REGIONS, "rest").alias("class"))


@QUERIES.add(r"""WITH e AS (SELECT event_id, ts::DATE AS day, 18 + user_id % 20 AS years, event_id % 366 AS days FROM events),
    b AS (SELECT event_id, day, years, day - days::INTEGER AS shifted FROM e),
    c AS (SELECT event_id, day, try_cast(lpad((year(shifted) - years)::VARCHAR, 4, '0') || strftime(shifted, '-%m-%d') AS DATE) AS birth FROM b)
    SELECT event_id, strftime(birth, '%Y-%m-%d') AS birth, (year(day) - year(birth) - CASE WHEN month(birth) > 6 THEN 1 ELSE 0 END)::INTEGER AS age,
           coalesce(abs(birth - DATE '1999-06-30') > 700, false) AS far FROM c""")
def p14_birth_dates(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("birth", dates.birth_date(F.col("day"), F.format_string("%d-%03d", 18 + F.col("user_id") % 20, F.col("event_id") % 366)))
    return e.select(
        "event_id",
        dates.day_text(F.col("birth")).alias("birth"),
        dates.age_in_june(F.year("day"), F.col("birth")).alias("age"),
        dates.is_far(F.col("birth"), F.to_date(F.lit("1999-06-30")), 700).alias("far"),
    )


@QUERIES.add("""SELECT DISTINCT (y - 1)::VARCHAR || '-' || y::VARCHAR AS season, (y - 2)::VARCHAR || '-' || (y - 1)::VARCHAR AS previous, y::INTEGER AS ends
    FROM (SELECT year(o_orderdate) AS y FROM orders)""")
def p16_periods(spark, d):
    y = F.year("o_orderdate")
    s = t(spark, d, "orders").select(F.concat_ws("-", (y - 1).cast("string"), y.cast("string")).alias("season")).distinct()
    return s.select("season", dates.previous_season(F.col("season")).alias("previous"), dates.season_end(F.col("season")).alias("ends"))


@QUERIES.add(with_("panel") + """ SELECT entity, period, round(100 * accepted / nullif(returned, 0), 6) AS raw,
    round(CASE WHEN 100 * accepted / nullif(returned, 0) > 100 THEN 100 ELSE 100 * accepted / nullif(returned, 0) END, 6) AS clipped,
    returned + accepted AS both, round(100 * accepted / nullif(returned, 0), 6) = 100 AS whole FROM panel""")
def p18_ratios(spark, d):
    raw = numeric.percentage(F.col("accepted"), F.col("returned"))
    out = panel(spark, d).select("entity", "period", raw.alias("raw"), numeric.clip(raw, 0.0, 100.0).alias("clipped"), numeric.row_sum([F.col("returned"), F.col("accepted")]).alias("both"), numeric.rounds_to(raw, 100.0).alias("whole"))
    return rounded(out)


@QUERIES.add(with_("panel") + """ SELECT entity, period, round(items / (quantity / 90), 6) AS items_rate, round(orders / (quantity / 90), 6) AS orders_rate,
    round(returned / (quantity / 90), 6) AS returned_rate, (period - 1990) * (period - 1990) AS square, round(ln(1 + value), 6) AS log_value, isfinite(balance) AS known FROM panel""")
def p20_rates(spark, d):
    p = panel(spark, d)
    age = F.col("period") - 1990
    rates = [numeric.per_unit(F.col(c), F.col("quantity"), 90).alias(f"{c}_rate") for c in ("items", "orders", "returned")]
    return rounded(p.select("entity", "period", *rates, (age * age).alias("square"), F.log1p("value").alias("log_value"), numeric.finite(F.col("balance")).alias("known")))


@QUERIES.add("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j2_fact_to_dimension(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    out = checks.checked_join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "inner", "many_to_one")
    return checks.checked_join(out, n, "n_nationkey", "left", "many_to_one").select("o_orderkey", "c_mktsegment", "n_name")


MATCHED = r"""WITH c AS (SELECT c_custkey, c_nationkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, floor(c_acctbal / 50)::BIGINT AS bucket FROM customer),
    s AS (SELECT s_suppkey, s_nationkey, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits, floor(s_acctbal / 50)::BIGINT AS bucket FROM supplier),
    m1 AS (SELECT c_custkey, s_suppkey FROM (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY digits, c_nationkey) = 1) a
           JOIN (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY digits, s_nationkey) = 1) b ON a.digits = b.digits AND c_nationkey = s_nationkey)"""


def _sides(spark, d):
    clean = lambda df, p: df.select(f"{p}key", "nationkey", F.regexp_replace("name", "[^0-9]", "").alias("digits"), F.floor(F.col("acctbal") / 50).alias("bucket"))
    c = t(spark, d, "customer").withColumnsRenamed({"c_nationkey": "nationkey", "c_name": "name", "c_acctbal": "acctbal"})
    s = t(spark, d, "supplier").withColumnsRenamed({"s_nationkey": "nationkey", "s_name": "name", "s_acctbal": "acctbal"})
    return clean(c, "c_cust"), clean(s, "s_supp")


@QUERIES.add(MATCHED + " SELECT * FROM m1")
def j4_unique_match(spark, d):
    c, s = _sides(spark, d)
    return relational.unique_match(c, s, ["digits", "nationkey"], ["digits", "nationkey"], "c_custkey", "s_suppkey")


@QUERIES.add(MATCHED + """, c2 AS (SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM m1)), s2 AS (SELECT * FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM m1)),
    m2 AS (SELECT c_custkey, s_suppkey FROM (SELECT * FROM c2 QUALIFY count(*) OVER (PARTITION BY bucket, c_nationkey) = 1) a
           JOIN (SELECT * FROM s2 QUALIFY count(*) OVER (PARTITION BY bucket, s_nationkey) = 1) b ON a.bucket = b.bucket AND c_nationkey = s_nationkey),
    m3 AS (SELECT c_custkey, s_suppkey FROM (SELECT * FROM c2 WHERE c_custkey NOT IN (SELECT c_custkey FROM m2) QUALIFY count(*) OVER (PARTITION BY digits) = 1) a
           JOIN (SELECT * FROM s2 WHERE s_suppkey NOT IN (SELECT s_suppkey FROM m2) QUALIFY count(*) OVER (PARTITION BY digits) = 1) b ON a.digits = b.digits)
    SELECT *, 'name and nation' AS matched_by FROM m1 UNION ALL SELECT *, 'nation and balance' FROM m2 UNION ALL SELECT *, 'name' FROM m3""")
def j5_cascade(spark, d):
    c, s = _sides(spark, d)
    both = lambda *k: (list(k), list(k))
    return relational.cascade_match(c, s, [("name and nation", *both("digits", "nationkey")), ("nation and balance", *both("bucket", "nationkey")), ("name", *both("digits"))], "c_custkey", "s_suppkey")


@QUERIES.add("""SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) WHERE r = 1""")
def j6_learned_mapping(spark, d):
    return relational.learned_mapping(t(spark, d, "documents"), "source", "lang")


@QUERIES.add("""SELECT c_custkey AS entity, yr AS period, abs(datediff('day', ref, day)) AS days, strftime(day, '%Y-%m-%d') AS day, price, o_orderkey FROM (
    SELECT c_custkey, year(o_orderdate)::INTEGER AS yr, o_orderdate::DATE AS day, make_date(year(o_orderdate), 6, 30) AS ref, o_totalprice AS price, o_orderkey
    FROM customer JOIN orders ON c_custkey = o_custkey WHERE month(o_orderdate) BETWEEN 4 AND 9)
    QUALIFY row_number() OVER (PARTITION BY c_custkey, yr ORDER BY abs(datediff('day', ref, day)), day, price, o_orderkey) = 1""")
def j9_nearest_in_window(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), "o_orderkey")
    years = o.select("entity", F.year("day").alias("period")).distinct()
    at = lambda m, x: F.make_date(F.col("period"), F.lit(m), F.lit(x))
    out = relational.nearest_in_window(years, o, "entity", "day", at(4, 1), at(9, 30), at(6, 30), ["entity", "period"], ["price", "o_orderkey"])
    return out.withColumns({"day": dates.day_text(F.col("day")), "days": F.col("days").cast("long")})


@QUERIES.add(with_("panel") + """, r AS (SELECT *, dense_rank() OVER (ORDER BY period)::INTEGER AS place FROM panel)
    SELECT entity, place, value_before, value FROM (SELECT entity, place, value, lag(value) OVER w AS value_before, lag(place) OVER w AS p FROM r
    WINDOW w AS (PARTITION BY entity ORDER BY place)) WHERE p = place - 1""")
def j13_lag_pairs(spark, d):
    p = stored(panel(spark, d).select("entity", "period", "value"))
    periods = relational.global_rank(p.select("period").distinct(), [F.col("period")], "place").withColumn("place", (F.col("place") + 1).cast("int"))
    return relational.lag_pairs(p.join(periods, "period"), "entity", "place", "value")


@QUERIES.add("""SELECT 'with orders' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
    UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def j14_semi_anti(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    o = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda df, name: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return n(relational.semi(c, o, "c_custkey"), "with orders").unionByName(n(relational.anti(c, o, "c_custkey"), "without"))


@QUERIES.add("SELECT k, only_in FROM (SELECT o_custkey AS k, 'left' AS only_in FROM orders EXCEPT SELECT c_custkey, 'left' FROM customer WHERE c_acctbal > 0) UNION ALL (SELECT c_custkey, 'right' FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey, 'right' FROM orders)")
def u8_differences(spark, d):
    a = t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return relational.both_ways(a, t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@QUERIES.add("SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def u3_keep_none(spark, d):
    return relational.drop_repeated(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@QUERIES.add("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def u4_repeated_keys(spark, d):
    return checks.repeated(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@QUERIES.add("SELECT count(*) AS n FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def u9_common_values(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(t(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def w1_first_per_key(spark, d):
    return relational.first_per_key(t(spark, d, "orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")])


@QUERIES.add("SELECT earlier, later FROM (SELECT y AS earlier, lead(y) OVER (ORDER BY y) AS later FROM (SELECT DISTINCT year(o_orderdate)::INTEGER AS y FROM orders WHERE year(o_orderdate) <> 1997)) WHERE later IS NOT NULL")
def w4_consecutive(spark, d):
    return relational.consecutive(t(spark, d, "orders").select(F.year("o_orderdate").alias("y")).where("y <> 1997"), "y")


@QUERIES.add("SELECT c_custkey, CASE WHEN c_acctbal >= -1000 AND c_acctbal < 0 THEN 0 WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN 1 WHEN c_acctbal >= 2500 AND c_acctbal < 9000 THEN 2 END::INTEGER AS closed_left, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 0 WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 1 WHEN c_acctbal > 2500 AND c_acctbal <= 9000 THEN 2 END::INTEGER AS closed_right FROM customer")
def w8_fixed_bins(spark, d):
    edges = [-1000.0, 0.0, 2500.0, 9000.0]
    return t(spark, d, "customer").select("c_custkey", numeric.binned(F.col("c_acctbal"), edges).alias("closed_left"), numeric.binned(F.col("c_acctbal"), edges, right=True).alias("closed_right"))


@QUERIES.add("""WITH e AS (SELECT quantile_cont(c_acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM customer)
    SELECT bin, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM (
      SELECT c_acctbal, len(list_filter(list_sort(list_distinct(q))[2:-2], lambda x: x < c_acctbal))::INTEGER AS bin FROM customer, e) GROUP BY bin""")
def w7_quantile_bins(spark, d):
    out = agg.quantile_bins(t(spark, d, "customer"), "c_acctbal", 10, "bin")
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@QUERIES.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t2_top_k(spark, d):
    return relational.top(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25)


@QUERIES.add("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def t4_extremes(spark, d):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by(k, F.struct(p, -k)).alias("dearest"), F.min_by(k, F.struct(p, k)).alias("cheapest"))


@QUERIES.add("SELECT 'customer' AS side, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def u5_union(spark, d):
    c = t(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = t(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s)


