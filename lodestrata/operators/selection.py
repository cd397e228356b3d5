"""Exact quantiles of all columns and groups at once, by counting in ever narrower ranges."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Values of a group, or of a range, that one task may sort: 512 KB of doubles.
FEW = 65_536
#: Parts of a range that one pass counts.
PARTS = 4_096


def part_of(x: Column, low: Column, high: Column) -> Column:
    """The number of the part of [low, high] that a value lies in, never falling with the value.

    Ranges within a factor of ``PARTS`` on one side of zero are cut evenly, others by the
    logarithm. As every step rounds in order, equal values stay together and larger ones
    never come first, which is all that selection needs. So a first pass over any
    doubles cuts factors of two in half, and four more cut them to single values."""
    infinite = F.lit(float("inf"))
    size = lambda v: F.when(F.abs(v) == infinite, F.lit(1025.0)).otherwise(F.log2(F.abs(v))) + 1100.0
    order = lambda v: F.when(v > 0, size(v)).when(v < 0, -size(v)).otherwise(F.lit(0.0))
    even = ((low > 0) & (high / PARTS <= low)) | ((high < 0) & (low / PARTS >= high))
    share = lambda v, a, b: F.least(F.floor((v - a) / (b - a) * PARTS), F.lit(PARTS - 1))
    return F.when(even, share(x, low, high)).otherwise(share(order(x), order(low), order(high))).cast("int")


def _narrow(values: DataFrame, key: list[str], ranges: DataFrame) -> DataFrame:
    """``ranges`` (key, rank, low, high, below, n) each cut down to its rank's part, by one pass over ``values``."""
    at = [*key, "__low", "__high"]
    cut = values.join(ranges.select(*at).distinct(), key).where(F.col("__x").between(F.col("__low"), F.col("__high")))
    parts = cut.groupBy(*at, part_of(F.col("__x"), F.col("__low"), F.col("__high")).alias("__part")).agg(F.count(F.lit(1)).alias("__k"), F.min("__x").alias("__a"), F.max("__x").alias("__b"))
    upto = parts.withColumn("__upto", F.sum("__k").over(Window.partitionBy(*at).orderBy("__part")))
    inside = F.col("__rank") - F.col("__below")
    mine = ranges.join(upto, at).where((inside < F.col("__upto")) & (inside >= F.col("__upto") - F.col("__k")))
    return mine.select(*key, "__rank", F.col("__a").alias("__low"), F.col("__b").alias("__high"), (F.col("__below") + F.col("__upto") - F.col("__k")).alias("__below"), F.col("__k").alias("__n"))


def long_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], probabilities: Sequence[float] = (), places: Callable[[Column], Sequence[Column]] | None = None) -> DataFrame:
    """(the columns of ``by``, which must be complete; feature; q): for each group and column its
    exact quantiles, linear between ranks, as an array in the order of ``probabilities``.
    ``places`` may give other ranks, from 0 and within the group, as expressions of its size.

    Null and NaN are left out; a group of nothing else has no row. A group of ``FEW``
    values at most is sorted in a task. Of larger ones each pass counts the parts of
    all ranges that wanted ranks lie in, for all groups and columns together, and keeps the
    parts that they fall in, until a part is one value or few; so a
    group may hold all rows of a table, and six passes do for any number of columns.
    """
    names = F.array(*(F.lit(c) for c in columns))
    each = F.arrays_zip(names.alias("f"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    values = df.select(*by, F.explode(each).alias("__e")).select(*by, F.col("__e.f").alias("feature"), F.col("__e.x").alias("__x"))
    values = values.where(F.col("__x").isNotNull() & ~F.isnan("__x")).withColumn("__x", F.col("__x") + F.lit(0.0))
    key = [*by, "feature"]
    places = places or (lambda n: [F.lit(float(p)) * (n - 1) for p in probabilities])

    def between(at: Column, low: Column, high: Column) -> Column:
        return low + F.when(low == high, F.lit(0.0)).otherwise((high - low) * (at - F.floor(at)))

    def sorted_(rows: DataFrame) -> DataFrame:
        """Quantiles of groups that a task may sort."""
        s, n = F.col("__s"), F.size("__s")
        q = F.transform(F.array(*places(n)), lambda at: between(at, F.element_at(s, (F.floor(at) + 1).cast("int")), F.element_at(s, (F.ceil(at) + 1).cast("int"))))
        return rows.groupBy(*key).agg(F.sort_array(F.collect_list("__x")).alias("__s")).select(*key, q.alias("q"))

    about = values.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    large = stored(about.where(F.col("__n") > FEW))
    if large.isEmpty():
        return sorted_(values)
    ranks = F.array_distinct(F.flatten(F.transform(F.array(*places(F.col("__n"))), lambda at: F.array(F.floor(at).cast("long"), F.ceil(at).cast("long")))))
    ranges = large.select(*key, F.explode(ranks).alias("__rank"), "__low", "__high", F.lit(0).cast("long").alias("__below"), "__n")
    found = None
    while True:
        wide = (F.col("__n") > FEW) & (F.col("__low") < F.col("__high"))
        ready = ranges.where(~wide)
        found = ready if found is None else found.unionByName(ready)
        ranges = ranges.where(wide)
        if ranges.isEmpty():
            break
        ranges = stored(_narrow(values, key, ranges))
    found = stored(found)
    single = found.where(F.col("__low") == F.col("__high")).select(*key, "__rank", F.col("__low").alias("__v"))
    at = [*key, "__low", "__high"]
    few = values.join(found.where(F.col("__low") < F.col("__high")).select(*at).distinct(), key).where(F.col("__x").between(F.col("__low"), F.col("__high")))
    few = few.groupBy(*at).agg(F.sort_array(F.collect_list("__x")).alias("__s"))
    several = found.join(few, at).select(*key, "__rank", F.element_at("__s", (F.col("__rank") - F.col("__below") + 1).cast("int")).alias("__v"))
    by_rank = single.unionByName(several).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__m")).join(large.select(*key, "__n"), key)
    v = lambda r: F.element_at(F.col("__m"), r.cast("long"))
    chosen = by_rank.select(*key, F.transform(F.array(*places(F.col("__n"))), lambda at: between(at, v(F.floor(at)), v(F.ceil(at)))).alias("q"))
    return sorted_(values.join(large.select(*key), key, "left_anti")).unionByName(chosen)


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of one column in each group: ``by`` and a column for each name in
    ``probabilities`` (see ``long_quantiles``)."""
    q = long_quantiles(df, by, [value], list(probabilities.values()))
    return q.select(*by, *(F.col("q")[i].alias(name) for i, name in enumerate(probabilities)))


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns; None for a column without a value."""
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if columns:
        out |= {r["feature"]: list(r["q"]) for r in long_quantiles(df, [], list(columns), probabilities).collect()}
    return out


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Exact quantiles, linear between ranks, of a column of any length."""
    return column_quantiles(df, [column], probabilities)[column]
