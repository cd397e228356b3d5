"""Exact deduplication: groups by a 128-bit hash, with bytes compared inside them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, squeeze_out, table

#: A class keeps the row with the most code points, then the smallest id. Both
#: go into one decimal, as fixed-width buffers let Spark hash-aggregate texts.
_STEP = Decimal("2e19").quantize(Decimal(1))
_TOP = Decimal(2**63)


def _rank(text: Column, key: Column) -> Column:
    """length * step + (2^63 - id), where a null id ranks last (0)."""
    ident = F.coalesce(F.lit(_TOP) - key.cast("decimal(19,0)"), F.lit(Decimal(0)))
    return (F.length(F.coalesce(text, F.lit(""))).cast("decimal(10,0)") * F.lit(_STEP) + ident).cast("decimal(38,0)")


def exact_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per class of equal texts: h, text_sha256, keep_id, group_size.

    Texts are equal when they are identical without white space; a null text
    equals an empty one. Rows are grouped by the 128-bit hash and the bytes
    themselves, so two texts with one hash stay apart, and copies of a hot text
    are merged in the map tasks, before any exchange. The class is addressed by
    hash and SHA-256; should two different texts ever share both, the query
    raises an error instead of merging them.
    """
    norm = squeeze_out(F.col(text))
    per_text = (
        docs.select(F.unhex(F.md5(norm)).alias("h"), norm.alias("norm"), _rank(F.col(text), F.col(key)).alias("rank"))
        .groupBy("h", "norm")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
        .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "rank", "n")
    )
    back = F.col("rank") % F.lit(_STEP)
    return (
        per_text.groupBy("h", "text_sha256")
        .agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("k"))
        .select(
            "h",
            F.when(F.col("k") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("string")).otherwise(F.col("text_sha256")).alias("text_sha256"),
            F.when(back != 0, F.lit(_TOP) - back).cast("long").alias("keep_id"),
            "group_size",
        )
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the id of the row that stays in the row's class. Repeated
    rows (same id and equal text) count in ``group_size`` and all carry
    ``kept``; ``deduplicate`` returns one of them. A null id can only stay where
    a class has no other. An empty table gives an empty result.

    The classes are written to the shared folder, so that the join back has
    plain exchanges on both sides and a hot class is split over many tasks.
    """
    norm = squeeze_out(F.col(text))
    classes = table(exact_classes(docs, key, text))
    rows = docs.select(F.col(key), F.unhex(F.md5(norm)).alias("h"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"))
    return rows.join(classes, ["h", "text_sha256"]).select(
        key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, each once, with all their columns.

    Where a class has several rows of the key that stays, its longest text does, of
    these the first in order."""
    h, sha, keep, repeats = (free_name(docs, n) for n in ("__h", "__sha", "__keep", "__repeats"))
    norm = squeeze_out(F.col(text))
    classes = table(exact_classes(docs, key, text)).select(F.col("h").alias(h), F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    rows = docs.withColumns({h: F.unhex(F.md5(norm)), sha: F.sha2(norm.cast("binary"), 256)})
    kept = rows.join(classes, [h, sha]).where(F.col(key).eqNullSafe(F.col(keep)))
    # Only where a key is repeated can a class keep several rows; then whole rows are exchanged again.
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias(repeats)).where(F.col(repeats) > 1).isEmpty():
        return kept.select(docs.columns)
    first = F.struct(-F.length(F.coalesce(F.col(text), F.lit(""))), F.col(text), F.xxhash64(*docs.columns))
    best = kept.groupBy(h, sha).agg(F.min_by(F.struct(*docs.columns), first).alias(keep))
    return best.select(f"{keep}.*")
