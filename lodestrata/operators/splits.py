"""Splits in time with a held-out domain, grouped folds, and audits of what splits share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import keys, require_all
from .relational import global_rank
from .stored import stored


def split_label(period: Column, domain: Column, parts: dict[str, Sequence], held_out: str, held_out_name: str = "held_out") -> Column:
    """The split of a row: the held-out domain before any period, else the part that
    lists the period, else an empty text."""
    out = F.lit("")
    for name, periods in reversed(parts.items()):
        out = F.when(period.isin(*periods), name).otherwise(out)
    return F.when(domain == held_out, held_out_name).otherwise(out)


def split(df: DataFrame, period: str, domain: str, parts: dict[str, Sequence], held_out: str, entity: str, train: str = "train", strict: bool = True) -> DataFrame:
    """``df`` with ``split`` and ``known``: whether a row outside of the training part
    has an entity that is in it. ``strict`` raises for a row in no split."""
    out = df.withColumn("split", split_label(F.col(period), F.col(domain), parts, held_out))
    if strict:
        out = require_all(out, F.col("split") != "", "a row belongs to no split")
    seen = out.where(F.col("split") == train).select(entity).distinct().withColumn("__seen", F.lit(True))
    known = F.coalesce("__seen", F.lit(False)) & (F.col("split") != train)
    return out.join(seen, entity, "left").withColumn("known", known).drop("__seen")


def _sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows of each group, written once: they are counted before they are dealt."""
    return stored(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))


def fold_map(df: DataFrame, group: str, n: int = 5) -> DataFrame:
    """(group, fold): each group in one fold, folds of near equal size.

    Groups, largest first and ties by name, are dealt to and fro over the folds,
    which needs one distributed sort of the groups and no state. ``balanced_folds`` is the
    greedy form for few groups.
    """
    sizes = _sizes(df, group)
    if sizes.limit(n).count() < n:
        raise ValueError(f"fewer groups than {n} folds")
    lap, place = F.floor(F.col("__at") / n), F.col("__at") % n
    return global_rank(sizes, [F.col("n").desc(), F.col(group)], "__at").select(group, F.when(lap % 2 == 0, place).otherwise(n - 1 - place).cast("int").alias("fold"))


def balanced_folds(df: DataFrame, group: str, n: int = 5, most: int = 1_000_000) -> DataFrame:
    """(group, fold) by greedy assignment: the largest group goes to the lightest fold.

    Sequential by nature, so it runs on the driver, over groups and not rows, and
    refuses more than ``most`` groups; use ``fold_map`` for those.
    """
    import heapq

    sizes = _sizes(df, group)
    count = sizes.count()
    if count < n:
        raise ValueError(f"{count} groups for {n} folds")
    if count > most:
        raise ValueError(f"{count} groups are more than {most}")
    heap = [(0, f) for f in range(n)]
    out = []
    for r in sizes.orderBy(F.col("n").desc(), group).collect():
        weight, f = heapq.heappop(heap)
        out.append((r[group], f))
        heapq.heappush(heap, (weight + r["n"], f))
    return df.sparkSession.createDataFrame(out, f"`{group}` {df.schema[group].dataType.simpleString()}, fold int")


def fold_summary(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Per fold: rows and groups to learn from and to validate on, and groups in both."""
    sized = df.join(folds, group).groupBy("fold").agg(F.count(F.lit(1)).alias("n_val"), F.count_distinct(group).alias("groups_val"))
    shared = folds.groupBy(group).agg(F.collect_set("fold").alias("f")).where(F.size("f") > 1).select(F.explode("f").alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("shared"))
    whole = Window.partitionBy()
    return (
        sized.withColumns({"n_train": F.sum("n_val").over(whole) - F.col("n_val"), "groups_train": F.sum("groups_val").over(whole) - F.col("groups_val")})
        .join(shared, "fold", "left")
        .select("fold", "n_train", "n_val", "groups_train", "groups_val", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))
    )


def overlap(df: DataFrame, split: str, key: str | Sequence[str], group: str) -> DataFrame:
    """For each pair of splits a < b: shared keys, shared groups, and the share of b's
    groups that a has. Pairs that share nothing are listed with zeros.

    Each key and group is met once, with the set of its splits, so no pair of
    rows is built.
    """

    def pairs(on: list[str], name: str) -> DataFrame:
        sets = df.where(F.col(split).isNotNull()).groupBy(*on).agg(F.array_sort(F.collect_set(split)).alias("s"))
        a = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
        return a.groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))

    names = df.where(F.col(split).isNotNull()).groupBy(F.col(split).alias("b")).agg(F.count_distinct(group).alias("groups_b"))
    every = names.select(F.col("b").alias("a")).join(names, F.col("a") < F.col("b"))
    out = every.join(pairs(keys(key), "shared_keys"), ["a", "b"], "left").join(pairs([group], "shared_groups"), ["a", "b"], "left").fillna(0, ["shared_keys", "shared_groups"])
    return out.select("a", "b", "shared_keys", "shared_groups", (F.col("shared_groups") / F.col("groups_b")).alias("share_of_b"))
