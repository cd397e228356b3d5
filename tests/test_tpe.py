"""Suggestions against random search, and trials that run at once."""

import math
import statistics
import threading

import pytest

from lodestrata.operators import models
from lodestrata.operators.tpe import TPE, Density

SPACE = {"a": ("uniform", -5.0, 5.0), "b": ("log", 1e-3, 1e3), "c": ("int", 2, 20, 3)}


def bowl(p):
    return (p["a"] - 1.7) ** 2 + math.log10(p["b"] / 4) ** 2 + ((p["c"] - 11) / 6) ** 2


def tried(seed, n=40):
    t = TPE(SPACE, seed)
    for _ in range(n):
        (p,) = t.suggest()
        t.tell(p, bowl(p))
    return t.trials


def test_beats_random_search_in_forty_trials():
    best = [min(s for s, _, _ in tried(seed)) for seed in range(15)]
    random = [min(bowl(p) for p in models.draws(SPACE, 40, seed)) for seed in range(15)]
    assert statistics.median(best) < statistics.median(random) / 2


def test_the_same_seed_gives_the_same_points_inside_of_the_bounds():
    assert tried(3) == tried(3) and tried(3) != tried(4)
    for _, _, p in tried(5, 80):
        assert -5 <= p["a"] <= 5 and 1e-3 <= p["b"] <= 1e3 and p["c"] in range(2, 21, 3)


def test_densities_add_up_to_one():
    for seen in ([], [0.1], [0.0, 0.0, 1.0, 0.97]):
        d = Density(seen, 0.0, 1.0)
        assert sum(math.exp(d.log((i + 0.5) / 4000)) for i in range(4000)) / 4000 == pytest.approx(1, abs=1e-3)


def test_failed_trials_count_as_the_poorest():
    t = TPE({"a": ("uniform", 0.0, 1.0)}, 1, startup=2)
    for a, s in [(0.1, math.nan), (0.9, 1.0), (0.12, None), (0.15, math.inf)]:
        t.tell({"a": a}, s)
    assert statistics.fmean(p["a"] for p in t.suggest(40)) > 0.55


def test_trials_that_end_in_any_order_give_the_same_search(spark):
    seen = set()

    def trial(p, after):
        seen.add((threading.get_ident(), spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
        total = spark.range(10).count() - 10 + bowl(p)
        for done in (1, 2, 3):
            if after(done, total):
                break
        return total

    a, b = (models.optimise(trial, SPACE, 14, seed=2, prune_after=6, parallel=3) for _ in range(2))
    assert a.trials == b.trials and len(a.trials) == 14 and len({pool for _, pool in seen}) == 14
    assert {t["state"] for t in a.trials} == {"PRUNED", "COMPLETE"} and all(t["state"] == "COMPLETE" for t in a.trials[:6])
    assert a.score == min(t["score"] for t in a.trials if t["state"] == "COMPLETE") == bowl(a.best)


def test_the_query_scores_what_it_suggests(spark):
    from lodestrata.operators import elastic
    from lodestrata.plans import analysis

    sf = "/root/testdata/sf0.001"
    rows = analysis.e10_search(spark, sf).collect()
    m = analysis._folds(spark, sf)
    score = lambda r: statistics.fmean(s for *_, s in elastic.path_scores(m, [r["alpha"]], [r["l1_ratio"]], scaled_label=True))
    whole = [r for r in rows if r["state"] == "COMPLETE"]
    assert [r["trial"] for r in rows] == list(range(30)) and len(whole) >= 10
    assert all(r["score"] == pytest.approx(score(r), abs=1e-5) for r in whole)
    grid = min(statistics.fmean(s for *_, s in elastic.path_scores(m, [a], [q], scaled_label=True)) for a in (1e-3, 1e-2, 1e-1, 1.0) for q in (0.0, 0.5, 1.0))
    assert min(r["score"] for r in whole) <= grid + 1e-3
