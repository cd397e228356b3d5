"""Tables from and to Parquet, CSV, JSON and JDBC, with missing values as null."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.numeric import clean_frame
from .files import read_sqlite  # noqa: F401  one of the readers


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_frame(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with a header; the schema is given, as inferring one reads the file twice."""
    return clean_frame(spark.read.csv(path, header=True, schema=schema, enforceSchema=False, escape='"', multiLine=True))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; give partitionColumn, bounds and numPartitions to read in parallel."""
    return clean_frame(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape=chr(34))


def write_json(value: Any, path: str | Path) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_protocol(path: str | Path) -> dict:
    """A YAML protocol; FileNotFoundError where there is none."""
    import yaml

    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no protocol at {path}")
    return yaml.safe_load(path.read_text(encoding="utf-8"))


def facts(values: dict[str, Any], spark: SparkSession) -> DataFrame:
    """Named facts as a table (name, value as JSON)."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(values.items())], "name string, value string")
