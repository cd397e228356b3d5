"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from lodestrata.llm import embedding_dedup as ed
from lodestrata.llm.queries import op12_embedding_near_dedup

SF = "/root/testdata/sf0.1"


def brute(rows, least=0.93):
    """(n_links, component) by row, from all pairs of rows (key, vector, label)."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ok = [v is not None and lab is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, lab in rows]
    links = [0] * len(rows)
    groups = {}
    for i, (_, v, lab) in enumerate(rows):
        if ok[i]:
            groups.setdefault((lab, len(v)), []).append(i)
    for at in groups.values():
        x = np.array([rows[i][1] for i in at], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= least), strict=True):
            if a != b:
                links[at[a]] += 1
                p, q = top(at[a]), top(at[b])
                parent[max(p, q)] = min(p, q)
    least_key = {}
    for i, (k, _, _) in enumerate(rows):
        r = top(i)
        least_key[r] = k if least_key.get(r) is None else least_key[r] if k is None else min(k, least_key[r])
    return links, [least_key[top(i)] for i in range(len(rows))]


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(k, v, lab, 1, "x") for k, v, lab in rows], f"vec_id long, embedding {kind}, label int, n_links int, component_id string")


def near(rng, v, cosine):
    """A vector at an exact cosine of ``v``."""
    v = v / np.linalg.norm(v)
    w = rng.standard_normal(len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


def test_small_groups_and_odd_rows_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        v = rng.standard_normal(16)
        rows += [(10 * i + j, near(rng, v, c).tolist(), i % 3) for j, c in enumerate((1.0, 0.99, 0.96, 0.94, 0.9))]
    rows += [(5000 + i, rows[0][1], 0) for i in range(30)] + [(5000, rows[0][1], 0), (None, rows[0][1], 0), (None, rows[600 - 1][1], 2)]
    rows += [(6001, None, 0), (6002, [], 0), (6003, [0.0] * 16, 0), (6004, [math.nan] * 16, 0), (6005, [math.inf] + [0.0] * 15, 0), (6006, [None] + [1.0] * 15, 0), (6007, rows[0][1], None), (6008, rows[0][1][:8], 0), (6009, (2 * np.array(rows[0][1])).tolist(), 0), (6010, [1e-30] * 16, 1), (6011, [1.0] * 16, 1)]
    rows = [(k, v and [c if c is None else float(np.float32(c)) for c in v], lab) for k, v, lab in rows]
    links, component = brute(rows)
    got = sorted(map(tuple, ed.near_duplicate_vectors(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((k, n, c, k is not None and k == c) for (k, _, _), n, c in zip(rows, links, component, strict=True)), key=str)
    assert ed.near_duplicate_vectors(frame(spark, []), "vec_id").count() == 0
    double = [(k, v, lab) for k, v, lab in rows if k and k < 6000]
    links, component = brute(double)
    got = {tuple(r) for r in ed.near_duplicate_vectors(frame(spark, double, "array<double>")).collect()}
    assert got == {(k, n, c, k == c) for (k, _, _), n, c in zip(double, links, component, strict=True)}


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 64)
    monkeypatch.setattr(ed, "SAMPLE", 512)


def test_forest_finds_nearly_all_pairs_at_the_threshold(spark, small_leaves):
    """Two to six rounds of splits; every planted pair lies barely above the threshold."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(2500):
        v = rng.standard_normal(32)
        rows += [(2 * i, v.tolist(), i % 5 and 1), (2 * i + 1, near(rng, v, 0.931 if i % 2 else 0.97).tolist(), i % 5 and 1)]
    links, component = brute(rows)
    got = {r.vec_id: r for r in ed.near_duplicate_vectors(frame(spark, rows, "array<double>")).collect()}
    assert len(got) == len(rows) and all(got[k].n_links <= n for (k, _, _), n in zip(rows, links, strict=True))
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links)
    assert sum(got[k].component_id == c for (k, _, _), c in zip(rows, component, strict=True)) >= 0.99 * len(rows)


def test_a_dense_group_is_counted_whole_without_pairs(spark, small_leaves):
    """A third of a label are near copies of one vector, with copies among them; two smaller
    groups lie beside it."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(24).tolist(), 1) for i in range(1200)]
    for start, size, cosine in ((2000, 900, 0.997), (4000, 150, 0.998), (6000, 80, 0.999)):
        v = rng.standard_normal(24)
        rows += [(start + i, near(rng, v, cosine).tolist(), 1) for i in range(size)]
    rows += [(8000 + i, rows[1250][1], 1) for i in range(50)]
    links, component = brute(rows)
    got = {r.vec_id: r for r in ed.near_duplicate_vectors(frame(spark, rows, "array<double>")).collect()}
    assert all(got[k].n_links <= n for (k, _, _), n in zip(rows, links, strict=True))
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links)
    assert [got[k].component_id for k, _, _ in rows] == component
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_equal_directions_still_split(spark, small_leaves):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(8)
    rows = [(i, ((1 + i) * v).tolist(), 0) for i in range(400)]
    got = ed.near_duplicate_vectors(frame(spark, rows, "array<double>")).collect()
    assert {r.component_id for r in got} == {0} and all(r.n_links == 399 for r in got)


def test_op12_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links, component = brute(rows)
    got = {tuple(r) for r in op12_embedding_near_dedup(spark, SF).collect()}
    assert got == {(k, n, c, k == c) for (k, _, _), n, c in zip(rows, links, component, strict=True)}
