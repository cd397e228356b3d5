"""Text expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_part(c: Column, separator: str = ",") -> Column:
    """What stands before the first separator, trimmed."""
    return F.trim(F.substring_index(c, separator, 1))


def last_word(c: Column) -> Column:
    """The last of the words of a text; null for a text without words."""
    return F.nullif(F.element_at(F.split(F.trim(c), r"\s+"), -1), F.lit(""))


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """The value of a key; null for an unknown or null key."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c) if table else F.lit(None).cast("string")


def classed(c: Column, classes: Mapping[str, Iterable[str]], otherwise: str) -> Column:
    """The first class that lists a code, else ``otherwise``; a null code stays null."""
    out = F.lit(otherwise)
    for name, codes in reversed(classes.items()):
        out = F.when(c.isin(*codes), name).otherwise(out)
    return F.when(c.isNotNull(), out)


def plain_name(c: Column) -> Column:
    """A name as a join key: NFKD, ASCII, lower case, letters and single spaces.

    A null name stays null and so never matches. Letters without a
    decomposition go, like all else that is not ASCII. Spark has no NFKD: this
    is the one expression that needs Arrow.
    """

    def ascii_only(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"), na_action="ignore")

    letters = F.regexp_replace(F.lower(F.pandas_udf(ascii_only, "string")(c)), "[^a-z ]", "")
    return F.trim(F.regexp_replace(letters, " +", " "))


def true_false(c: Column) -> Column:
    """A flag as the text True or False."""
    return F.initcap(c.cast("string"))
