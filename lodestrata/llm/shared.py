"""Shared folders, table loading and small helpers used by the text operators."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every text contract.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all nodes share.

    Where the setting is absent on one machine (tests), a temporary folder is set
    as the session's checkpoint folder; on a cluster that is an error. The folder is deleted when the driver
    ends, through Spark's own file system, so any store works.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/lodestrata-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone already
        pass


def table(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again.

    It cuts lineage so that a lost executor costs no upstream work, and gives
    the planner true sizes (a join of two such tables can split hot keys).
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def enter(user: str) -> types.ModuleType:
    """A module that lives as long as the Python worker, for bounded caches.

    What an operator keeps there goes when another one comes to the worker, so
    caches do not add up over the stages of a pipeline."""
    state = sys.modules.setdefault("_lodestrata_worker", types.ModuleType("_lodestrata_worker"))
    if state.__dict__.get("user") != user:
        state.__dict__.clear()
        state.user = user
        gc.collect()
    return state


def words(text: Column) -> Column:
    """Number of words in a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def squeeze_out(text: Column) -> Column:
    """The text without any character of the word-separating white space."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\v\f\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores before it, unused in ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
