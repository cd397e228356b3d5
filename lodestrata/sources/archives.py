"""Archives of pages: what is in a ZIP, and how it compares with a table."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MEMBER_BYTES, read_zip

#: A page's canonical address: a link element of that kind, with its attributes in either order and quoting.
_LINK = re.compile(r"<link\b[^>]*>", re.I)
_KIND = re.compile(r"""\brel\s*=\s*["']?canonical\b""", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)


def canonical(page: str) -> str | None:
    """The first canonical address that a page states."""
    for link in _LINK.finditer(page):
        if _KIND.search(link[0]) and (href := _HREF.search(link[0])):
            return href[1] or href[2]
    return None


def zip_entries(spark: SparkSession, path: str, part_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(archive, name, modified, size, canonical) of every page in the ZIP files at a path.

    An archive's members are spread over tasks and read one at a time, each as a whole."""

    @F.arrow_udf("string")
    def address(pages: pa.Array) -> pa.Array:
        return pa.array([canonical(p.as_buffer().to_pybytes().decode("utf-8", "replace")) for p in pages], pa.string())

    return read_zip(spark, path, part_bytes=part_bytes).select("archive", "name", "modified", "size", address(F.coalesce("content", F.lit(b""))).alias("canonical"))


def archive_summary(entries: DataFrame, season: Column) -> DataFrame:
    """Pages, first and last modification by season."""
    return entries.groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n"), F.min("modified").alias("first"), F.max("modified").alias("last"))


def extracted(page: Column, pattern: str, chars: int | None = None) -> Column:
    """The first group of a pattern in a page, or in its first ``chars`` characters; null
    where it does not match."""
    return F.nullif(F.regexp_extract(page if chars is None else F.substring(page, 1, chars), pattern, 1), F.lit(""))
