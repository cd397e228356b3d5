"""Fingerprints and manifests."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import _store, files_below

#: Bytes that one task hashes of a file.
CHUNK = 64 << 20


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n and a fingerprint of the content, whatever the order, the partitions or
    the files. Row hashes are added up in 64-bit lanes, so repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    lanes = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("string") for x in lanes]
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("-", *sums), 256).alias("sha256"))


def directory_fingerprint(spark, path: str) -> DataFrame:
    """(file, length, sha256) of every file below a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def tree_hashes(spark: SparkSession, path: str, suffix: str = "", chunk: int = CHUNK) -> DataFrame:
    """(file, length, tree_sha256) of the files with a suffix at or below a path, of any size.

    A file is cut into chunks of ``chunk`` bytes, each read and hashed in a task; the
    file's hash is the SHA-256 of its chunks' digests, one after the other (of nothing for an
    empty file). It depends on the chunk's size, not on tasks. The driver sees names
    and lengths only."""
    sizes = []
    for name in files_below(path, suffix):
        store, at = _store(name)
        sizes.append((name, store.get_file_info(at).size))
    files = spark.createDataFrame(sizes, "path string, length long")
    parts = files.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / chunk) - 1, F.lit(0).cast("long")))))

    def run(batches):
        for batch in batches:
            digests = []
            for name, i in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, at = _store(name)
                with store.open_input_file(at) as f:
                    f.seek(i * chunk)
                    left, digest = chunk, hashlib.sha256()
                    while left and (block := f.read(min(left, 1 << 20))):
                        digest.update(block)
                        left -= len(block)
                digests.append(digest.digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["path", "length", "i", "digest"])

    many = max(1, min(10_000, sum(-(-n // chunk) for _, n in sizes)))
    hashed = parts.repartition(many, "path", "i").mapInArrow(run, "path string, length long, i long, digest binary")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", F.hex("digest").alias("d")))), lambda x: x["d"])
    whole = F.when(F.col("length") > 0, F.sha2(F.unhex(F.array_join("d", "")), 256)).otherwise(F.lit(hashlib.sha256().hexdigest()))
    return hashed.groupBy("path", "length").agg(ordered.alias("d")).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", whole.alias("tree_sha256"))


def agrees(expected: str | None, found: str, strict: bool = True) -> bool:
    """Whether a fingerprint is the expected one; ``strict`` raises if it is not."""
    same = expected == found
    if strict and not same:
        raise ValueError(f"the data has fingerprint {found}, the protocol {expected}")
    return same


def counted(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its rows, filled by whatever action reads it."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def plain(value: Any, root: Path | None = None) -> Any:
    """Parameters as JSON can hold them: paths relative to ``root``, sets in order, else what
    has no form in JSON as text."""

    def other(x: Any) -> Any:
        if isinstance(x, set | frozenset):
            return sorted(x, key=str)
        if isinstance(x, Path) and root and root in x.parents:
            return x.relative_to(root).as_posix()
        return str(x)

    return json.loads(json.dumps(value, default=other))


def table_state(df: DataFrame) -> dict[str, Any]:
    """What identifies a table: schema, rows and fingerprint of the content."""
    found = fingerprint(df).first()
    return {"schema": df.schema.simpleString(), "rows": found["n"], "sha256": found["sha256"]}


def manifest(spark: SparkSession, inputs: Mapping[str, DataFrame | str | Path], outputs: Mapping[str, DataFrame | str | Path], parameters: Mapping[str, Any], rows: Mapping[str, Observation | int], **more: Any) -> dict[str, Any]:
    """A run, by name: its input and output tables or files, parameters, rows after each
    stage, and the settings and versions it ran with."""

    def state(x: DataFrame | str | Path) -> dict[str, Any]:
        if isinstance(x, DataFrame):
            return table_state(x)
        return {"file": Path(x).name, "bytes": Path(x).stat().st_size, "sha256": file_sha256(x)}

    settings = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")
    return {
        "engine": {"spark": spark.version, "python": platform.python_version(), "settings": {k: spark.conf.get(k, None) for k in settings}},
        "inputs": {k: state(x) for k, x in inputs.items()},
        "outputs": {k: state(x) for k, x in outputs.items()},
        "parameters": plain(parameters),
        "rows": {k: v.get["rows"] if isinstance(v, Observation) else v for k, v in rows.items()},
        **plain(more),
    }
