"""Language identification against plain sets and dictionaries, without any filter."""

import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodestrata.llm import langid, queries
from lodestrata.llm.shared import load

SF = "/root/testdata/sf0.01"


def windows(text):
    """All four-byte windows of the folded text but those with a space at the second or third byte."""
    b = langid.fold(text)
    return [b[i : i + 4] for i in range(len(b) - 3) if b[i + 1 : i + 2] != b" " and b[i + 2 : i + 3] != b" "]


def exact_model(rows):
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(windows(text))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    top = Counter()
    for k, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / totals[k])
    return {k: {g for g, n in c.items() if n >= langid.LEAST_COUNT and n / totals[k] >= langid.LEAST_RATE and n / totals[k] >= top[g] * langid.LEAST_SHARE} for k, c in counts.items()}


def test_every_document_as_with_exact_sets(spark):
    docs = load(spark, SF, "documents").collect()
    held_out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    sets = exact_model([(r.text, r.lang) for r in docs if not held_out[r.doc_id]])
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    every = load(spark, SF, "documents")
    filters = langid.learn(every.where(langid.fold_of(every.doc_id, 3) != 1))
    assert len(got) == len(docs) and set(filters.languages) == set(sets)
    false = max(filters.false)
    clear = 0
    for r in docs:
        g = windows(r.text or "")
        mine = got[r.doc_id]
        assert mine.held_out == held_out[r.doc_id]
        if r.text is None or not langid.has_letter(r.text):
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        share = {k: sum(x in s for x in g) / max(1, len(g)) for k, s in sets.items()}
        # What false positives may add or take, in one text: grams repeat, so by distinct ones.
        off = false + 6 * (max(1, max(Counter(g).values(), default=1)) * false / max(1, len(g))) ** 0.5
        assert abs(mine.score - share.get(mine.lang_pred, 0)) <= off
        best = max(share.values())
        assert share[mine.lang_pred] >= best - 2 * off
        if sorted(share.values())[-2] < best - 2 * off:
            clear += 1
            assert share[mine.lang_pred] == best
    assert clear > 0.9 * len(docs)


def test_filters_hold_every_gram_and_few_others(spark):
    rows = [("the river and the hills near the river", "en"), ("der fluss und die berge und der fluss", "de"), ("la rivière et la montagne et la rivière", "fr")] * 6 + [(None, "en"), ("nobody says", None), ("", "de")]
    f = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    sets = exact_model(rows)
    for i, k in enumerate(f.languages):
        own = np.array([int.from_bytes(g, "little") for g in sorted(sets[k])], np.uint32)
        assert f.hits(own)[i] == len(own) > 0
    every = np.random.default_rng(1).integers(0, 2**32, 100_000, dtype=np.uint64).astype(np.uint32)
    assert (f.hits(every) <= 100_000 * f.false + 6 * np.sqrt(100_000 * f.false) + 1).all()


def test_extra_columns_and_clashing_names(spark):
    rows = [(i, t, lang, 0.5, "x", 1) for i, (t, lang) in enumerate([("the river and the hills", "en"), ("der fluss und die berge", "de"), (None, None)] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, gram int")
    f = langid.learn(df)
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(df, f).collect()} == {(r[0], r[2] or "und") for r in rows}
    kept = langid.keep_identified(df, f)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[1]}
    odd = df.selectExpr("text AS lang", "lang AS text", "cast(null as long) AS doc_id")
    assert langid.identify(odd, langid.learn(odd, "lang", "text"), "doc_id", "lang").count() == 15


def test_many_labels_raise_or_fit(spark, monkeypatch):
    rows = [(f"text number {i} of the many words{i} " * 4, f"l{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "text string, lang string")
    f = langid.learn(df)
    assert len(f.languages) == 70 and f.bits.shape[1] == 2
    monkeypatch.setattr(langid, "MOST_BYTES", 1 << 13)
    with pytest.raises(ValueError, match="70 languages"):
        langid.learn(df)


def test_workers_need_no_package(tmp_path):
    """A session whose workers cannot import this library: filters travel by value."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {str(root)!r})
from lodestrata.llm import langid
df = spark.createDataFrame([(1, "the river and the hills the river", "en"), (2, "der fluss und die berge der fluss", "de")] * 4, "doc_id long, text string, lang string")
f = langid.learn(df)
assert langid.keep_identified(df, f).count() == 8 and langid.identify(df, f).where("lang_pred = lang_pred").count() == 8
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-1500:]
