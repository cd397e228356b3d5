"""Fill-in-the-middle against a plain reading of its contract, whitening against NumPy."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lodestrata.llm import fim, whitening
from lodestrata.llm.queries import op11_fill_in_middle, op13_whitening

SF = "/root/testdata/sf0.01"


def plain_fim(key, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "A-Z\t\v\n  zßé\U0001f600x"), (6, "<P"), (7, "x<P>y"), (8, "a<M>"), (9, "ab <S> c"), (None, "null key, words"), (None, "null key, words"),
    (10, "<S<S< <M< P> S> M>"), (11, "ab" * 100_000 + " " + "é1 " * 50_000), (12, "[`{@"), (5, "repeated id"), (13, "<" * 50), (14, "ends<"),
]


def test_runs_give_every_unit_its_place():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abZ é1 \n\U0001f600@[`{") for _ in range(rng.randrange(40)))
        runs = fim.encode(text)
        at, places = 0, []
        for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S):
            places.append(at)
            at += len(u)
        assert runs.n == len(places) and [runs.offset(i) for i in range(runs.n + 1)] == [*places, len(text)]
        assert all(runs.letters[:-1] != runs.letters[1:])


def test_fill_in_middle_of_odd_texts(spark):
    docs = spark.createDataFrame([(k, t, "x", 0, "<P>") for k, t in ODD * 3], "doc_id long, text string, n string, form long, output string")
    out = fim.fill_in_middle(docs)
    back = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(out.output, out.form).alias("back")).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r)[:6] for r in back), key=key) == sorted(((k, *plain_fim(k, t)) for k, t in ODD * 3), key=key)
    want = sorted((str(k), t or "") for k, t in ODD * 3)
    assert sorted((str(r.doc_id), r.back) for r in back) == want
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_restores_any_text_in_any_form(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", ">", "P", "S", "M", "<S", "P>", "a b", "é"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = fim.fill_in_middle(docs)
    rows = out.select("doc_id", "form", fim.restored(out.output, out.form).alias("back")).collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and all(r.back == texts[r.doc_id] for r in rows)


def test_op11_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = op11_fill_in_middle(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        *rest, output = plain_fim(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, *rest, sha(output), sha(docs[r.doc_id] or ""))


# Whitening


def plain_whitening(x):
    """Components of distinct integer vectors by a dense eigensolver, and exact deviations."""
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    z = ((n * fit - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return n, sums, values[::-1], vectors[:, ::-1], values.sum()


def check(rows, x, tolerance=1e-6):
    n, sums, values, vectors, trace = plain_whitening(list(x.values()))
    k = min(16, int((values > 1e-11 * values[0]).sum()))
    assert len(rows) == k * len(x)
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True)) == r.deviation_wide
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-6) and 0 <= r.identity_error < 1e-7
    for i in range(k):
        got = np.array([r.whitened for r in sorted(by[i + 1], key=lambda r: r.vec_id)])
        z = np.array([[(n * c - s) / n for c, s in zip(x[v], sums, strict=True)] for v in sorted(x)], float)
        want = z @ vectors[:, i] / np.sqrt(values[i])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < tolerance


def test_op13_whole_table(spark):
    x = {r.vec_id: tuple(math.floor(64 * c) + 1_000_000 for c in r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(op13_whitening(spark, SF).collect(), x)


def test_whitening_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    basis = rng.standard_normal((3, 6))
    good = [(rng.standard_normal(3) * [9, 3, 1] @ basis).tolist() for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, good[0]) for i in range(40)]
    bad = [(200, None), (201, [1.0, None, 0, 0, 0, 0]), (202, [math.nan] * 6), (203, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows + [(k, v and [c if c is None else float(c) for c in v]) for k, v in bad]], "vec_id long, embedding array<double>, component string, n long")
    x = {k: tuple(math.floor(64 * c) + 1_000_000 for c in v) for k, v in rows}
    check(whitening.whiten(df).collect(), x)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id >= 100 and vec_id < 200")).count() == 0  # one distinct vector has no component
    null = df.selectExpr("cast(null as long) AS vec_id", "embedding").union(df.select("vec_id", "embedding"))
    assert whitening.whiten(null).where("vec_id is null").count() == 6 * 100
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("spectrum", ["flat", "repeated", "falling", "low rank", "zero"])
def test_block_lanczos_finds_all_kinds_of_spectra(spectrum):
    rng = np.random.default_rng(2)
    d = 90
    values = {"flat": np.ones(d), "repeated": np.repeat([9.0, 4.0, 1.0], 30), "falling": 0.7 ** np.arange(d), "low rank": np.r_[np.arange(5, 0, -1.0), np.zeros(d - 5)], "zero": np.zeros(d)}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * values) @ q.T
    got, vectors, stats = whitening.block_lanczos(lambda v: a @ v, d, 8, 4)  # a block is widened to 8
    np.testing.assert_allclose(got, np.sort(values)[::-1][:8], atol=1e-12 * max(1, values.max()))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-12 * max(1.0, values.max())
    assert stats["passes"] <= -(-d // 8)
    if spectrum == "falling":
        assert stats["passes"] < 10  # the residuals end it before the space is whole
    if spectrum == "low rank":
        assert stats["restarts"] > 0


def test_squared_lengths_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    for most in (10, 1 << 30, (1 << 55) - 1):
        y = rng.integers(-most, most, (5, 130))
        assert whitening.squared_lengths(y) == [sum(int(v) ** 2 for v in row) for row in y]
