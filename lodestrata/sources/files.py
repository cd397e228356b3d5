"""ZIP archives and SQLite files as Spark data sources: planned in parts, read where tasks run."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..functions.numeric import clean_frame

#: Compressed bytes of ZIP members, and rows of a table, that one task reads.
MEMBER_BYTES, TABLE_ROWS = 32 << 20, 500_000
#: Members, and rows, of one Arrow batch; bytes of members in it.
ROWS, BYTES = 10_000, 8 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str, suffix: str) -> list[str]:
    """The file at a path, or those with a suffix below it, in order; as ``pyarrow.fs`` opens them."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(prefix + x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(suffix))


def _column(f: Filter) -> str | None:
    """The column of a filter that is one column's; None for fields of structures."""
    return f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None


class _File(io.RawIOBase):
    """A file of ``pyarrow.fs`` that fails like others when a place before its start is sought."""

    def __init__(self, store: Any, at: str):
        super().__init__()
        self.file = store.open_input_file(at)
        self.size = self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + (0, self.file.tell(), self.size)[whence]
        if to < 0:
            raise OSError("a place before the start")
        self.file.seek(min(to, self.size))
        return to

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer: Any) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def _reader(store: Any, at: str) -> io.BufferedReader:
    return io.BufferedReader(_File(store, at), 1 << 16)


# ZIP archives


class Members(InputPartition):
    """Members of one archive, by their place in its central directory."""

    def __init__(self, archive: str, places: list[int]):
        self.archive, self.places = archive, places


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.content = options["path"], options.get("content", "true") == "true"
        self.part_bytes = int(options.get("partbytes", MEMBER_BYTES))
        self.names: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters of member names choose members before any is opened."""
        for f in filters:
            if _column(f) == "name" and isinstance(f, EqualTo | In | StringStartsWith):
                self.names.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        return all(name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) for f in self.names)

    def partitions(self) -> Sequence[InputPartition]:
        """Runs of wanted members of about as many compressed bytes, from the central directories:
        the end of each archive is all that is read for it."""
        out: list[Members] = []
        for archive in files_below(self.path, ".zip"):
            store, at = _store(archive)
            with _reader(store, at) as f, zipfile.ZipFile(f) as z:
                places, size = [], 0
                for i, e in enumerate(z.infolist()):
                    if e.is_dir() or not self._wanted(e.filename):
                        continue
                    places.append(i)
                    size += e.compress_size
                    if size >= self.part_bytes:
                        out.append(Members(archive, places))
                        places, size = [], 0
                if places:
                    out.append(Members(archive, places))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.places:
            return
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            archive, name, modified, length, content = zip(*rows, strict=True)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((archive, name, modified, length, content), kinds, strict=True)], ["archive", "name", "modified", "size", "content"])

        store, at = _store(partition.archive)
        with _reader(store, at) as f, zipfile.ZipFile(f) as z:
            listed = z.infolist()
            for i in partition.places:
                e = listed[i]
                content = z.read(e) if self.content else None
                rows.append((partition.archive.rsplit("/", 1)[-1], e.filename, "%04d-%02d-%02d %02d:%02d:%02d" % e.date_time, e.file_size, content))
                size += len(content or b"")
                if len(rows) >= ROWS or size >= BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class ZipSource(DataSource):
    """(archive, name, modified, size, content) of the members of the ZIP files at ``path``. One archive
    may be read by many tasks. ``content`` = false leaves members closed."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, modified string, size long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(self.options)


def read_zip(spark: SparkSession, path: str, content: bool = True, part_bytes: int = MEMBER_BYTES) -> DataFrame:
    """The members of the ZIP files at a path (see ``ZipSource``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("content", str(content).lower()).option("partbytes", str(part_bytes)).load(path)


def write_zip(df: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """A ZIP file for each partition of ``df``, with a member for each row, in a folder that all nodes
    share; (file, members) of each. Files are written under attempt names and renamed
    when complete, so a task that runs again replaces its own. A null content is an empty member."""

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        final, attempt = f"{at}/part-{context.partitionId():05d}.zip", f"{at}/_attempt-{context.taskAttemptId()}"
        members = 0
        with store.open_output_stream(attempt) as f:
            with zipfile.ZipFile(_Forward(f), "w", zipfile.ZIP_DEFLATED) as z:
                for batch in batches:
                    for n, c in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                        z.writestr(zipfile.ZipInfo(n or "", (2000, 1, 1, 0, 0, 0)), c.as_py() or b"", zipfile.ZIP_DEFLATED)
                        members += 1
        store.move(attempt, final)
        yield pa.RecordBatch.from_pydict({"file": [final], "members": pa.array([members], pa.int64())})

    return df.select(name, content).mapInArrow(run, "file string, members long")


class _Forward(io.RawIOBase):
    """A stream that is only written forward, as object stores offer."""

    def __init__(self, sink: Any):
        super().__init__()
        self.sink, self.at = sink, 0

    def writable(self) -> bool:
        return True

    def write(self, data: Any) -> int:
        self.sink.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        raise OSError("a stream without places")  # so members carry their sizes behind them


# SQLite files

#: Spark's type for a declared type that has one of these words in it; the first that fits counts.
DECLARED = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("NUM", "double"), ("DEC", "double"), ("BLOB", "binary"))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    store, at = _store(path)
    return sqlite3.connect(f"file:{at}?mode=ro&immutable=1", uri=True)


class RowRange(InputPartition):
    """Row ids from ``low`` to ``high`` of one file; without bounds the whole table."""

    def __init__(self, file: str, low: int | None, high: int | None):
        self.file, self.low, self.high = file, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[tuple[str, str]]):
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.rows = int(options.get("rows", TABLE_ROWS))
        self.where: list[str] = []
        self.values: list[Any] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of numbers become SQL; texts stay with Spark, as collations differ."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        kinds = dict(self.columns)
        for f in filters:
            c = _column(f)
            if kinds.get(c) in ("long", "double") and type(f) in signs and isinstance(f.value, int | float):
                self.where.append(f"{quoted(c)} {signs[type(f)]} ?")
                self.values.append(f.value)
            elif c in kinds and isinstance(f, IsNotNull):
                self.where.append(f"{quoted(c)} IS NOT NULL")
                yield f
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of row ids between the least and the largest, found by the table's own index.
        A table without row ids is one part."""
        out: list[RowRange] = []
        for file in files_below(self.path, ".db"):
            with _open(file) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:
                    out.append(RowRange(file, None, None))
                    continue
            if low is not None:
                out += [RowRange(file, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
        return out or [RowRange("", None, None)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.insert(0, "rowid BETWEEN ? AND ?")
            values = [partition.low, partition.high, *values]
        names = [c for c, _ in self.columns]
        kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[k] for _, k in self.columns]
        makes = {"long": int, "double": float, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        with _open(partition.file) as db:
            cursor = db.execute(f"SELECT {', '.join(map(quoted, names))} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            while rows := cursor.fetchmany(ROWS):
                # Any value may stand in any column of such a file: it takes the column's declared type.
                yield pa.RecordBatch.from_arrays([pa.array([None if r[i] is None else makes[k](r[i]) for r in rows], kind) for i, ((_, k), kind) in enumerate(zip(self.columns, kinds, strict=True))], names)


class SqliteSource(DataSource):
    """A table of the SQLite files at ``path`` (equal schemas), in ranges of row ids, with the declared types."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def _columns(self) -> list[tuple[str, str]]:
        files = files_below(self.options["path"], ".db")
        if not files:
            raise FileNotFoundError(f"no SQLite file at {self.options['path']}")
        with _open(files[0]) as db:
            found = db.execute(f"SELECT name, type FROM pragma_table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return [(c, next((k for word, k in DECLARED if word in declared.upper()), "string")) for c, declared in found]

    def schema(self) -> str:
        return ", ".join(f"`{c}` {k}" for c, k in self._columns())

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, self._columns())


def read_sqlite(spark: SparkSession, path: str, table: str, rows: int = TABLE_ROWS) -> DataFrame:
    """A table of the SQLite files at a path that all nodes see, read by row ids where tasks run
    (see ``SqliteSource``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return clean_frame(spark.read.format("sqlite_rows").option("table", table).option("rows", str(rows)).load(path))


def write_sqlite(df: DataFrame, table: str, folder: str) -> DataFrame:
    """An SQLite file for each partition of ``df``, in a folder on a file system that all nodes
    mount; (file, members) of each. Files appear under their names when complete."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}
    columns = [(c, kinds[k]) for c, k in df.dtypes]

    def run(batches):
        import os

        from pyspark import TaskContext

        context = TaskContext.get()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        final, attempt = f"{at}/part-{context.partitionId():05d}.db", f"{at}/_attempt-{context.taskAttemptId()}"
        members = 0
        db = sqlite3.connect(attempt)
        db.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(c)} {k}' for c, k in columns)})")
        for batch in batches:
            db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(columns))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            members += len(batch)
        db.commit()
        db.close()
        os.replace(attempt, final)
        yield pa.RecordBatch.from_pydict({"file": [final], "members": pa.array([members], pa.int64())})

    return df.mapInArrow(run, "file string, members long")
