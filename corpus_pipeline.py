"""A text corpus from raw documents to packed sequences, stage by stage.

Each stage takes what the one before kept, and its decisions take effect: rows
that it rejects go, rows that the mix repeats occur that often. All stages but
the last return the columns of ``documents``. Empty tables pass through; null
and letterless texts end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.exact_dedup import deduplicate
from lodestrata.llm.langid import keep_identified, learn
from lodestrata.llm.mixing import mixed
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.shared import load, table
from lodestrata.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no language; filters are learned from the labels present."""
    return keep_identified(docs, learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints or similar texts."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources holds it."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SimHash components and packing have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs
