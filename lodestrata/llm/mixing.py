"""Mixing sources to target weights by hash thresholds, without sorting the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, table, words

#: A document's place in the order of its source: this many bits of its id's MD5,
#: refined by so many bits at a time.
HASH_BITS, LEVEL_BITS = 60, 12


def place(key: Column, seed: str = "mix") -> Column:
    """A reproducible 60-bit number of an id; null ids share one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Per source (columns source, source_size): its target, copies and budget.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes; a target stops at ``most`` times its source's size and
    the excess is shared by weight among the others. With sources sorted by cap
    over weight, the common share per weight is the largest of
    (total - caps before) / (weights from here on). ``copies`` whole copies of a
    source are taken, and documents up to ``budget`` once more. One row per
    source; the windows see no more than that.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * F.lit(float(most))
    return (
        sizes.withColumn("weight", weight)
        .withColumns({"cap": cap, "ratio": cap / F.col("weight"), "total": F.sum("source_size").over(whole).cast("double")})
        .withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("target", F.least("cap", F.max("share").over(whole) * F.col("weight")))
        .withColumn("copies", F.floor(F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))))
        .withColumn("budget", F.col("target") - (F.col("copies") * F.col("source_size")).cast("double"))
        .select("source", "source_size", "target", "copies", "budget")
    )


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``limit``: documents placed up to it are taken once more.

    Each level sums sizes by source and hash bucket (combined in the map tasks,
    so that a hot source costs a task no more than its buckets), finds the
    bucket in which the budget ends, and passes on only that bucket's rows. The
    last level decides by which side is nearer. Levels end when every boundary
    bucket is a single place.
    """
    open_ = plan.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("spent"))
    bits = HASH_BITS
    while bits > 0:
        bits = max(0, bits - LEVEL_BITS)
        width = 1 << bits
        inside = rows.join(open_.select(F.col("source").alias("s"), "low"), F.col("source").eqNullSafe(F.col("s")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + (width << LEVEL_BITS)))
        hist = inside.groupBy("source", (F.col("place") - F.pmod("place", F.lit(width))).alias("bucket")).agg(F.sum("size").alias("n"))
        cum = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        found = (
            hist.where("n > 0")
            .join(open_.select(F.col("source").alias("s"), "budget", "spent"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("after", F.col("spent") + cum)
            .groupBy("source")
            # The first bucket that runs over the budget; a budget that is never reached takes all.
            .agg(F.min(F.when(F.col("after") > F.col("budget"), F.struct("bucket", (F.col("after") - F.col("n")).alias("spent"), "n"))).alias("b"))
        )
        open_ = table(
            open_.select(F.col("source").alias("s"), "budget", F.col("low").alias("was"), F.col("spent").alias("before"))
            .join(found, F.col("source").eqNullSafe(F.col("s")), "left")
            .select(F.col("s").alias("source"), "budget", F.coalesce("b.bucket", "was").alias("low"), F.coalesce("b.spent", "before").alias("spent"), F.col("b.n").alias("n"))
        )
    nearer = (F.col("spent") + F.col("n") - F.col("budget")) < (F.col("budget") - F.col("spent"))
    edge = open_.select(F.col("source").alias("s"), F.when(F.col("n").isNull(), F.lit(1 << HASH_BITS)).when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("limit"))
    return plan.join(edge, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, copies.

    ``copies`` is how often the mix holds the document (0 to ``most``), ``taken``
    the words that makes. A null source is a source of its own; null texts have
    size 0. Rows that repeat an id are taken or left together. Same ids, same
    mix, whatever the partitioning. The texts are read once; sizes and places
    go to the shared folder, and all later passes read only those.
    """
    rows = table(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), place(F.col(key)).alias("place")))
    plan = table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    edges = table(thresholds(rows, plan)).withColumnRenamed("source", "s")
    copies = F.col("copies") + F.when((F.col("place") <= F.col("limit")) & (F.col("budget") > 0), 1).otherwise(0)
    return (
        rows.join(edges, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", F.least(copies, F.lit(int(most))))
        .select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int"))
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix holds it, with all their columns."""
    size, at, s = (free_name(docs, n) for n in ("__size", "__place", "__s"))
    rows = table(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), place(F.col(key)).alias("place")))
    plan = table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    edges = table(thresholds(rows, plan)).select(F.col("source").alias(s), F.col("copies").alias(size), F.when(F.col("budget") > 0, F.col("limit")).otherwise(-1).alias(at))
    copies = F.least(F.col(size) + F.when(place(F.col(key)) <= F.col(at), 1).otherwise(0), F.lit(int(most))).cast("int")
    out = docs.join(edges, F.col(source).eqNullSafe(F.col(s)))
    return out.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(size)).select(docs.columns)
