"""ZIP and SQLite sources and tree hashes against zipfile, sqlite3 and hashlib."""

import hashlib
import os
import random
import sqlite3
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

from lodestrata.sources import files, provenance


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    content = {f"d{i % 3}/{i}.bin": rng.randbytes(rng.choice([0, 10, 30_000])) for i in range(60)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("empty")
        for n, c in content.items():
            z.writestr(n, c)
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "b.zip", "w") as z:
        z.writestr("other", b"x")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    df = files.read_zip(spark, str(tmp_path), part_bytes=100_000)
    assert df.rdd.getNumPartitions() >= 4
    rows = df.collect()
    assert {(r.archive, r.name): bytes(r.content) for r in rows} == {("a.zip", n): c for n, c in content.items()} | {("b.zip", "other"): b"x"} and len(rows) == 61
    assert all(r.size == len(r.content) for r in rows)
    assert {r.content for r in files.read_zip(spark, str(tmp_path / "a.zip"), content=False).collect()} == {None}
    some = df.where("name = 'd0/3.bin'")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 1  # only its member is planned
    assert df.where("name like 'd1/%' and size > 0").count() == sum(n.startswith("d1/") and len(c) > 0 for n, c in content.items())
    assert files.read_zip(spark, str(tmp_path / "none.zip")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        files.read_zip(spark, str(tmp_path / "nowhere.zip")).count()


def test_written_archives_open_anywhere(spark, tmp_path):
    rows = [(f"{i}.txt", "é" * i if i % 7 else None) for i in range(50)]
    made = files.write_zip(spark.createDataFrame(rows, "name string, text string").repartition(3), "name", "text", str(tmp_path / "z")).collect()
    assert sum(r.members for r in made) == 50 and not list((tmp_path / "z").glob("_attempt*"))
    got = {}
    for r in made:
        with zipfile.ZipFile(r.file) as z:
            assert z.testzip() is None
            got |= {n: z.read(n).decode() for n in z.namelist()}
    assert got == {n: t or "" for n, t in rows}


@pytest.fixture
def database(tmp_path):
    rows = [(i, f"name {i}" if i % 5 else None, i / 4 if i % 3 else None, bytes([i % 256])) for i in range(1000) if not 300 <= i < 500]
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute('create table "odd ""name" (id integer primary key, "the text" varchar(10), v real, b blob)')
        db.executemany('insert into "odd ""name" values (?, ?, ?, ?)', rows)
        db.execute("create table bare (k text primary key, v int) without rowid")
        db.executemany("insert into bare values (?, ?)", [("a", 1), ("b", None)])
        db.execute("create table mixed (v text)")
        db.executemany("insert into mixed values (?)", [(1,), ("x",), (None,), (b"raw",)])
        db.execute("create table none_ (v int)")
    return tmp_path / "a.db", rows


def test_tables_are_read_in_ranges_of_row_ids(spark, database):
    path, rows = database
    df = files.read_sqlite(spark, str(path), 'odd "name', rows=100)
    assert df.dtypes == [("id", "bigint"), ("the text", "string"), ("v", "double"), ("b", "binary")]
    assert df.rdd.getNumPartitions() == 10  # two of them empty
    assert sorted(tuple(r) for r in df.collect()) == rows
    got = df.where("v > 100 and v <= 200 and id >= 450").select("id").collect()
    assert sorted(r.id for r in got) == [i for i, _, v, _ in rows if v is not None and 100 < v <= 200 and i >= 450]
    assert df.where("`the text` = 'name 7'").count() == 1 and df.where("`the text` is null").count() == sum(r[1] is None for r in rows)
    assert sorted(map(tuple, files.read_sqlite(spark, str(path), "bare").collect())) == [("a", 1), ("b", None)]
    assert sorted(str(r.v) for r in files.read_sqlite(spark, str(path), "mixed").collect()) == ["1", "None", "raw", "x"]
    assert files.read_sqlite(spark, str(path), "none_").count() == 0
    with pytest.raises(Exception, match="no table"):
        files.read_sqlite(spark, str(path), "nothing").count()


def test_filters_reach_the_file(spark, database):
    path, _ = database
    plan = files.read_sqlite(spark, str(path), 'odd "name').where("v > 100")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "BatchScan" in plan
    reader = files.SqliteReader({"path": str(path), "table": 'odd "name'}, [("id", "long"), ("the text", "string"), ("v", "double")])
    left = list(reader.pushFilters([files.GreaterThan(("v",), 100.0), files.EqualTo(("the text",), "x")]))
    assert reader.where == ['"v" > ?'] and reader.values == [100.0] and len(left) == 1
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert min(b.column(2).to_pylist()[0] for b in read) > 100


def test_written_tables_come_back(spark, tmp_path):
    rows = [(i, f"t{i}" if i % 2 else None, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, v double").repartition(3)
    assert sum(r.members for r in files.write_sqlite(df, "x", str(tmp_path / "s")).collect()) == 40
    assert sorted(map(tuple, files.read_sqlite(spark, str(tmp_path / "s"), "x", rows=5).collect())) == rows


def test_tree_hashes_of_files_of_any_size(spark, tmp_path):
    rng = random.Random(2)
    content = {"a": b"", "b": b"x" * 10, "c": rng.randbytes(5000), "d": rng.randbytes(4096)}
    for n, c in content.items():
        (tmp_path / n).write_bytes(c)

    def tree(c, chunk):
        return hashlib.sha256(b"".join(hashlib.sha256(c[i : i + chunk]).digest() for i in range(0, len(c), chunk))).hexdigest()

    for chunk in (512, 4096, 1 << 20):
        got = {r.file: (r.length, r.tree_sha256) for r in provenance.tree_hashes(spark, str(tmp_path), chunk=chunk).collect()}
        assert got == {n: (len(c), tree(c, chunk)) for n, c in content.items()}


def test_entry_without_the_text_operators(tmp_path):
    """Copies of the entry without the subpackage, with a leftover cache of it, and with a broken one."""
    root = Path(__file__).resolve().parent.parent
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    package = tmp_path / "lodestrata"
    package.mkdir()
    for f in (root / "lodestrata").iterdir():
        if f.name not in ("llm", "__pycache__"):
            (package / f.name).symlink_to(f)
    plain = run()
    assert int(plain.stdout) > 90, plain.stderr
    (package / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "corpus_pipeline.py").write_text("import nothing_here")
    assert run().stdout == plain.stdout
    (package / "llm" / "__init__.py").write_text("")
    assert "nothing_here" in run().stderr
