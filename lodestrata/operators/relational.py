"""Joins, set operations, deduplication and ordered operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import key_profile, keys
from .stored import stored

# Scans


def load_tables(tables: dict[str, DataFrame], key: Sequence[str], drop: dict[str, Sequence[str]] | None = None, rename: dict[str, dict[str, str]] | None = None, equal_rows: bool = True) -> dict[str, DataFrame]:
    """Tables without repeated rows, redundant columns and clashing names.

    Apart from the key no name may occur twice; with ``equal_rows`` all tables
    must have as many rows as the first. Each cleaned table is written once, as its
    rows are counted, profiled and joined.
    """
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        df = df.dropDuplicates().drop(*(drop or {}).get(name, ()))
        out[name] = stored(df.withColumnsRenamed((rename or {}).get(name, {})))
    seen: dict[str, str] = {}
    for name, df in out.items():
        for c in df.columns:
            if c not in key and c in seen:
                raise ValueError(f"{c} is in {seen[c]} and in {name}")
            seen[c] = name
    if equal_rows and out:
        counts = {name: df.count() for name, df in out.items()}
        if len(set(counts.values())) > 1:
            raise ValueError(f"tables of one key differ in rows: {counts}")
    return out


# Joins


def chain_join(tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """All tables side by side, one to one, without losing a row of the first.

    Each table is profiled once, which gives both its uniqueness and its size."""
    sizes = []
    for i, df in enumerate(tables):
        n, most = key_profile(df, on)
        if most > 1:
            raise ValueError(f"table {i} of a chained join: the key {keys(on)} repeats")
        sizes.append(n)
    out = reduce(lambda a, b: a.join(b, keys(on)), tables)
    if (n := out.count()) != sizes[0]:
        raise ValueError(f"chained join: {sizes[0]} rows became {n}")
    return out


def drop_repeated(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is complete and occurs once: of a repeated key, none stays."""
    on, n, row = keys(on), "__n", "__row"
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))
    # Combined in map tasks, so that a hot key costs a row a task.
    once = df.where(whole).groupBy(*on).agg(F.count(F.lit(1)).alias(n), F.first(F.struct(*df.columns)).alias(row)).where(F.col(n) == 1)
    return once.select(f"{row}.*")


def unique_match(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows whose key is complete and unique on both sides."""
    names = [f"__k{i}" for i in range(len(left_on))]
    a = drop_repeated(left.select(left_id, *(F.col(c).alias(n) for c, n in zip(left_on, names, strict=True))), names)
    b = drop_repeated(right.select(right_id, *(F.col(c).alias(n) for c, n in zip(right_on, names, strict=True))), names)
    return a.join(b, names).select(left_id, right_id)


def cascade_match(left: DataFrame, right: DataFrame, passes: Sequence[tuple[str, Sequence[str], Sequence[str]]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, matched_by): in each pass, unique matches among the rows that
    no earlier pass matched, on either side."""
    found: DataFrame | None = None
    for name, left_on, right_on in passes:
        a = left if found is None else left.join(found.select(left_id), left_id, "left_anti")
        b = right if found is None else right.join(found.select(right_id), right_id, "left_anti")
        new = unique_match(a, b, left_on, right_on, left_id, right_id).withColumn("matched_by", F.lit(name))
        found = new if found is None else found.unionByName(new)
    return found


def learned_mapping(pairs: DataFrame, code: str, value: str) -> DataFrame:
    """For each code the value it goes with most often; ties go to the smallest."""
    n = pairs.where(F.col(code).isNotNull() & F.col(value).isNotNull()).groupBy(code, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(code).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def nearest_in_window(facts: DataFrame, candidates: DataFrame, on: str | Sequence[str], date: str, start: Column, end: Column, reference: Column, key: Sequence[str], value: Sequence[str]) -> DataFrame:
    """For each key, the candidate nearest to the reference day in [start, end].

    Ties go to the earlier date, then to the smallest values. One aggregation
    finds it, without sorting the candidates.
    """
    joined = facts.join(candidates, keys(on)).where(F.col(date).between(start, end))
    gap = F.abs(F.datediff(F.col(date), reference))
    best = F.min(F.struct(gap.alias("days"), F.col(date).alias(date), *(F.col(v).alias(v) for v in value)))
    return joined.groupBy(*key).agg(best.alias("b")).select(*key, "b.days", f"b.{date}", *(f"b.{v}" for v in value))


def lag_pairs(df: DataFrame, entity: str, position: str, value: str) -> DataFrame:
    """Each row beside its entity's row one position before; gaps give no pair."""
    w = Window.partitionBy(entity).orderBy(position)
    before = F.lag(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))).over(w)
    return df.withColumn("__b", before).where(F.col("__b.p") == F.col(position) - 1).select(entity, position, F.col("__b.v").alias(f"{value}_before"), F.col(value))


def semi(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys(on)).distinct(), keys(on), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys(on)), keys(on), "left_anti")


# Sets


def both_ways(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    left, right = a.select(*keys(on)).distinct(), b.select(*keys(on)).distinct()
    only = lambda x, y, name: x.join(y, keys(on), "left_anti").withColumn("only_in", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def reconcile(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """One row: keys of each side, common keys and differences, in one full join."""
    left, right = a.select(*keys(on)).distinct().withColumn("__a", F.lit(1)), b.select(*keys(on)).distinct().withColumn("__b", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    one, two = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return left.join(right, keys(on), "full").agg(n(one).alias("n_left"), n(two).alias("n_right"), n(one & two).alias("n_both"), n(one & ~two).alias("only_left"), n(two & ~one).alias("only_right"))


# Ordered operators


def first_per_key(df: DataFrame, on: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the order must be total for a stable result."""
    w = Window.partitionBy(*keys(on)).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 0, in a total order.

    Rows are sorted by ranges; a place is the row's number in its range plus the
    sizes of the ranges before, of which there is one row each. A window
    without partitions would sort everything in one task.
    """
    rows = df.orderBy(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    rows = stored(rows)
    sizes = rows.groupBy("__p").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("__p", (before - F.col("__first")).alias("__shift"))
    return rows.join(F.broadcast(places), "__p").withColumn(name, F.col("__i") + F.col("__shift")).drop("__p", "__i", "__shift")


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def consecutive(df: DataFrame, position: str) -> DataFrame:
    """(earlier, later): each distinct position and the next one. One row a position."""
    distinct = df.select(F.col(position).alias("earlier")).where(F.col(position).isNotNull()).distinct()
    return distinct.withColumn("later", F.lead("earlier").over(Window.orderBy("earlier"))).where("later is not null")


def jumps(df: DataFrame, series: str, position: str, value: str, scale: str) -> DataFrame:
    """Absolute change from one position to the next, in units of ``scale``."""
    w = Window.partitionBy(series).orderBy(position)
    return df.withColumn("jump", F.abs(F.col(value) - F.lag(value).over(w)) / F.nullif(F.col(scale), F.lit(0.0)))
