"""The case: customers as entities, years as periods, orders as what is observed.

1997 is left out, so that the calendar's year before and the data's year
before differ. ``Query`` pairs a plan with SQL; ``CTE`` holds the SQL of the
case's tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clean_frame
from ..operators.splits import split_label

HELD_OUT, PARTS = "EUROPE", {"train": [1995, 1996, 1998], "calibration": [1999], "test": [2000]}
LEAST_QUANTITY = 50
#: Order lines that one task of the panel adds up.
LINES = 250_000
#: Up to so many tasks by entity take the orders of two tasks of lines each; more take those of eight.
TASKS = 24


@dataclass(frozen=True)
class Query:
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Catalogue(dict):
    """Queries by name; used as a decorator that takes the SQL."""

    def add(self, sql: str | None = None) -> Callable:
        def put(plan):
            self[plan.__name__] = Query(plan, sql)
            return plan

        return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return clean_frame(spark.read.parquet(f"{d}/{name}.parquet"))


def exact(c: str | Column, scale: int = 2) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")).cast("double")


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison; NaN and negative zero as null and zero."""
    return df.select(*(F.when(~F.isnan(c), F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if ty == "double" and c not in skip else F.col(c) for c, ty in df.dtypes))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with entity, period and day."""
    orders = t(spark, d, "orders").where(F.year("o_orderdate") != 1997)
    lines = t(spark, d, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").alias("period"),
        F.col("o_orderdate").cast("date").alias("day"),
        "o_orderkey",
        "o_orderpriority",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (t(spark, d, x) for x in ("customer", "nation", "region"))
    wide = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return wide.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("domain"), F.col("c_acctbal").alias("balance"))


def entity_tasks(n: int) -> int:
    """Tasks by entity that follow ``n`` tasks of lines. An exchange has a block for every two tasks of its sides,
    and blocks of few rows compress badly: shuffled bytes would grow faster than the rows."""
    return max(min(math.ceil(n / 2), TASKS), math.ceil(n / 8))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """One row for each entity and period with enough quantity.

    Lines are added up by order where they meet it, then orders by entity, period and
    priority, then those by entity and period. So rows are shuffled by order and once more, one an
    order, by entity, which serves all groupings and the join of customers; sums of
    decimals are exact in any order. The number of tasks grows with the lines, so that their memory does not. Of orders that share a key, an entity and a period one counts."""
    lines = t(spark, d, "lineitem")
    n = max(1, math.ceil(lines.count() / LINES))
    o = t(spark, d, "orders").where(F.year("o_orderdate") != 1997)
    o = o.select("o_orderkey", F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"), "o_orderpriority").repartition(n, "o_orderkey")
    same = Window.partitionBy("o_orderkey", "entity", "period").orderBy("o_orderpriority")
    o = o.withColumn("first", (F.row_number().over(same) == 1).cast("int"))
    cents = lambda c: F.sum(c.cast("decimal(18,2)"))
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    terms = {
        "quantity": quantity,
        "value": F.col("l_extendedprice"),
        "returned": F.when(flag == "R", quantity).otherwise(0),
        "accepted": F.when(flag == "A", quantity).otherwise(0),
        "discount": F.col("l_discount"),
        "tax": F.col("l_tax"),
    }
    lines = lines.repartition(n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    orders = lines.groupBy("o_orderkey", "entity", "period", "o_orderpriority", "first").agg(*(cents(c).alias(name) for name, c in terms.items()), F.count(F.lit(1)).alias("items"))
    counts = [F.sum("items").alias("items"), F.sum("orders").alias("orders")]
    whole = lambda: (F.sum(name).alias(name) for name in terms)
    each = orders.withColumnRenamed("first", "orders").repartition(entity_tasks(n), "entity").groupBy("entity", "period", "o_orderpriority").agg(*whole(), *counts)
    heaviest = F.min_by("o_orderpriority", F.when(F.col("o_orderpriority").isNotNull(), F.struct(-F.col("quantity"), F.col("o_orderpriority"))))
    sums = each.groupBy("entity", "period").agg(*whole(), *counts, heaviest.alias("position"))
    sums = sums.withColumns({name: F.col(name).cast("double") for name in terms})
    kept = sums.where((F.col("quantity") >= LEAST_QUANTITY) & F.col("position").isNotNull())
    kept = kept.select("entity", "period", "quantity", "value", "returned", "accepted", "items", "orders", "discount", "tax", "position")
    return kept.join(customers(spark, d), "entity").withColumn("y", F.log1p("value"))


def model_table(spark: SparkSession, d: str) -> DataFrame:
    """The panel with its split; rows in no split are left out."""
    return panel(spark, d).withColumn("split", split_label(F.col("period"), F.col("domain"), PARTS, HELD_OUT)).where(F.col("split") != "")


CTE = {
    "ev": """
        ev AS (SELECT o_custkey AS entity, year(o_orderdate)::INTEGER AS period, o_orderdate::DATE AS day, o_orderkey, o_orderpriority,
                      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) <> 1997)""",
    "cu": """
        cu AS (SELECT c_custkey AS entity, c_mktsegment AS segment, n_name AS nation, r_name AS domain, c_acctbal AS balance
               FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "panel": """
        s AS (SELECT entity, period, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value,
                     sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END::DECIMAL(18,2))::DOUBLE AS returned,
                     sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END::DECIMAL(18,2))::DOUBLE AS accepted,
                     count(*) AS items, count(DISTINCT o_orderkey) AS orders,
                     sum(l_discount::DECIMAL(18,2))::DOUBLE AS discount, sum(l_tax::DECIMAL(18,2))::DOUBLE AS tax
              FROM ev GROUP BY 1, 2),
        pos AS (SELECT entity, period, o_orderpriority AS position FROM (
                  SELECT entity, period, o_orderpriority, row_number() OVER (PARTITION BY entity, period ORDER BY sum(l_quantity::DECIMAL(18,2)) DESC, o_orderpriority) AS r
                  FROM ev GROUP BY 1, 2, 3) WHERE r = 1),
        panel AS (SELECT s.*, position, segment, nation, domain, balance, ln(1 + value) AS y
                  FROM s JOIN pos USING (entity, period) JOIN cu USING (entity) WHERE quantity >= 50)""",
    "model": """
        model AS (SELECT *, CASE WHEN domain = 'EUROPE' THEN 'held_out' WHEN period IN (1995, 1996, 1998) THEN 'train'
                                 WHEN period = 1999 THEN 'calibration' WHEN period = 2000 THEN 'test' END AS split
                  FROM panel WHERE domain = 'EUROPE' OR period IN (1995, 1996, 1998, 1999, 2000))""",
}


def with_(*names: str) -> str:
    """A WITH clause of the named tables and those they need; more may follow."""
    order = ["ev", "cu", "panel", "model"]
    needs = {"ev": ["ev"], "cu": ["cu"], "panel": ["ev", "cu", "panel"], "model": order}
    wanted = {x for n in names for x in needs[n]}
    return "WITH " + ",".join(CTE[n] for n in order if n in wanted)
