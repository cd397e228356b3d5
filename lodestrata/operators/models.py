"""Regressors, grouped validation, search and comparison of variants."""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosting
from .elastic import FoldMoments, path_scores
from .metrics import evaluate, residuals, smearing
from .preprocess import Preprocessor
from .stored import stored
from .tpe import TPE

SEED = 20260829


def elastic_net(alpha: float = 0.01, l1_ratio: float = 0.5, max_iter: int = 200):
    """Least squares with both penalties, on features as they come (they are scaled)."""
    return LinearRegression(regParam=alpha, elasticNetParam=l1_ratio, maxIter=max_iter, standardization=False)


def random_forest(n_estimators: int = 100, max_depth: int = 10, min_samples_leaf: int = 1, max_features: float = 0.5, seed: int = SEED):
    return RandomForestRegressor(numTrees=n_estimators, maxDepth=min(30, max_depth), minInstancesPerNode=min_samples_leaf, featureSubsetStrategy=str(max_features), seed=seed)


def boosting(n_estimators: int = 50, max_depth: int = 4, learning_rate: float = 0.1, subsample: float = 0.8, min_child_weight: float = 5, reg_lambda: float = 1.0, colsample_bytree: float = 1.0, seed: int = SEED):
    return Boosting(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, subsample=subsample, minChildWeight=float(min_child_weight), regLambda=reg_lambda, colsample=colsample_bytree, seed=seed)


def rounds(errors: Sequence[float], patience: int = 50) -> int:
    """How many rounds boosting keeps: up to its best one, when it ends after ``patience``
    rounds without a better one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


MODELS = {"elastic_net": elastic_net, "random_forest": random_forest, "boosting": boosting}

#: Per model: parameter, kind and bounds. "log" is uniform in the logarithm; an
#: "int" has a step.
SPACES: dict[str, dict[str, tuple]] = {
    "elastic_net": {"alpha": ("log", 1e-4, 1.0), "l1_ratio": ("uniform", 0.0, 1.0)},
    "random_forest": {"n_estimators": ("int", 50, 300, 50), "max_depth": ("int", 4, 16, 2), "min_samples_leaf": ("int", 1, 10, 1), "max_features": ("uniform", 0.2, 1.0)},
    "boosting": {"n_estimators": ("int", 20, 100, 10), "max_depth": ("int", 2, 8, 1), "learning_rate": ("log", 0.02, 0.3), "subsample": ("uniform", 0.5, 1.0), "min_child_weight": ("int", 1, 20, 1), "reg_lambda": ("log", 1e-3, 1e2), "colsample_bytree": ("uniform", 0.3, 1.0)},
}


def draws(space: dict[str, tuple], n: int, seed: int = SEED) -> Iterator[dict[str, float]]:
    """``n`` points of a search space, the same for the same seed."""
    rng = random.Random(seed)
    for _ in range(n):
        point = {}
        for name, (kind, low, high, *step) in space.items():
            if kind == "log":
                point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            elif kind == "int":
                point[name] = rng.randrange(low, high + 1, step[0])
            else:
                point[name] = rng.uniform(low, high)
        yield point


def build(estimator, numeric: Sequence[str], categorical: Sequence[str], target: str, threshold: float = 0.0) -> Pipeline:
    """Preprocessing and an estimator as one pipeline, so that nothing is learned outside
    of the rows it is fitted on."""
    estimator = estimator.copy().setFeaturesCol("features").setLabelCol(target).setPredictionCol("prediction")
    return Pipeline(stages=[Preprocessor(numeric=list(numeric), categorical=list(categorical), threshold=threshold), estimator])


def fold_scores(df: DataFrame, pipeline: Pipeline, target: str, fold: str, after: Callable[[int, float], bool] | None = None) -> list[float]:
    """RMSLE of each fold of a model fitted on the others; ``after`` may end the loop.

    The rows are kept in memory or on disk meanwhile, as every fold reads them often."""
    df = df.persist()
    out: list[float] = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        model = pipeline.fit(df.where(F.col(fold) != k))
        e = F.col("prediction") - F.col(target)
        out.append(model.transform(df.where(F.col(fold) == k)).agg(F.sqrt(F.avg(e * e))).first()[0])
        if after and after(len(out), statistics.fmean(out)):
            break
    df.unpersist()
    return out


@dataclass
class Search:
    """The best point of a search and a log of all trials."""

    best: dict[str, float]
    score: float
    trials: list[dict] = field(default_factory=list)

    def log(self, spark) -> DataFrame:
        rows = [(t["trial"], t["state"], t["score"], t["params"]) for t in self.trials]
        return spark.createDataFrame(rows, "trial int, state string, score double, params map<string,double>")


def search(df: DataFrame, model: str, numeric: Sequence[str], categorical: Sequence[str], target: str, fold: str, n: int = 20, seed: int = SEED, prune_after: int = 10, parallel: int = 1) -> Search:
    """Search by tree-structured Parzen densities under grouped folds (see ``optimise``)."""

    def trial(point: dict[str, float], after: Callable[[int, float], bool]) -> float:
        return statistics.fmean(fold_scores(df, build(MODELS[model](**point), numeric, categorical, target), target, fold, after))

    return optimise(trial, SPACES[model], n, seed, prune_after, parallel)


def optimise(trial: Callable[[dict, Callable[[int, float], bool]], float], space: dict[str, tuple], n: int, seed: int = SEED, prune_after: int = 10, parallel: int = 1) -> Search:
    """The point of least score among ``n`` trials. ``trial`` gets a point and a function that it may
    tell after each fold how many are done and their mean, and that says whether to give up.

    ``parallel`` trials run at once, each as jobs of a pool of its own. They are suggested
    together, count as poor for one another, and are held only against trials of earlier rounds; so the same seed
    gives the same trials whichever ends first. From ``prune_after`` trials on, one whose mean so far is above the
    median of earlier trials at that fold is given up; the first fold gives up none. It still tells
    the densities what it knows."""
    sampler, found = TPE(space, seed), Search({}, math.inf)
    history: dict[int, list[float]] = {}

    def run(number: int, point: dict[str, float]) -> dict:
        means: list[float] = []
        pruned = False

        def after(done: int, mean: float) -> bool:
            nonlocal pruned
            means.append(mean)
            before = history.get(done, [])
            pruned = number >= prune_after and done > 1 and len(before) > 0 and mean > statistics.median(before)
            return pruned

        score = trial(point, after)
        return {"trial": number, "state": "PRUNED" if pruned else "COMPLETE", "score": score, "params": {k: float(v) for k, v in point.items()}, "point": point, "means": means}

    with ThreadPoolExecutor(parallel) as pool:
        while len(found.trials) < n:
            start = len(found.trials)
            points = sampler.suggest(min(parallel, n - start))
            running = [pool.submit(in_pool(run, f"trial-{i}"), i, point) for i, point in enumerate(points, start)]
            for t in [r.result() for r in running]:
                sampler.tell(t["point"], t["score"])
                for done, mean in enumerate(t.pop("means"), 1):
                    history.setdefault(done, []).append(mean)
                point = t.pop("point")
                if t["state"] == "COMPLETE" and t["score"] < found.score:
                    found.best, found.score = point, t["score"]
                found.trials.append(t)
    return found


def search_elastic_net(m: FoldMoments, n: int = 20, seed: int = SEED, prune_after: int = 10) -> Search:
    """The same search over elastic nets, whose fold scores need no rows once their moments are there."""

    def trial(point: dict[str, float], after: Callable[[int, float], bool]) -> float:
        seen: list[float] = []
        for _, _, _, score in path_scores(m, [point["alpha"]], [point["l1_ratio"]], scaled_label=True):
            seen.append(score)
            if after(len(seen), statistics.fmean(seen)):
                break
        return statistics.fmean(seen)

    return optimise(trial, SPACES["elastic_net"], n, seed, prune_after)


def in_pool(run: Callable, name: str) -> Callable:
    """``run`` for another thread, with a copy of the caller's job properties and a scheduler pool."""
    session = SparkSession.getActiveSession()
    if session is None:
        return run

    def pooled(*args):
        session.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return run(*args)

    return inheritable_thread_target(session)(pooled)


@dataclass
class Final:
    """A fitted model, its smearing factor, and its metrics and residuals by part."""

    model: PipelineModel
    duan: float
    metrics: dict[str, DataFrame]
    residuals: dict[str, DataFrame]


def final_fit(parts: dict[str, DataFrame], estimator, numeric: Sequence[str], categorical: Sequence[str], target: str, axes: Sequence[str] = (), train: str = "train", stop_on: str | None = None, patience: int = 50, threshold: float = 0.0, fit_on: str | None = None, back: Column | None = None) -> Final:
    """Fit on the training part; the smearing factor comes from its residuals alone.

    With ``stop_on`` that part's errors say after which round boosting stops, inside of its one fit;
    nothing else is learned from its rows.
    ``fit_on`` names another target to learn, from whose ``prediction`` the
    expression ``back`` makes one of ``target``. The parts are written once, as every pass reads them.
    """
    return _final_fit({k: stored(v) for k, v in parts.items()}, estimator, numeric, categorical, target, axes, train, stop_on, patience, threshold, fit_on, back)


def _final_fit(parts: dict[str, DataFrame], estimator, numeric: Sequence[str], categorical: Sequence[str], target: str, axes: Sequence[str] = (), train: str = "train", stop_on: str | None = None, patience: int = 50, threshold: float = 0.0, fit_on: str | None = None, back: Column | None = None) -> Final:
    """``final_fit`` of parts that lie in the shared folder."""
    label = fit_on or target
    fitted = build(estimator, numeric, categorical, label, threshold)
    if stop_on and not isinstance(estimator, Boosting):
        raise ValueError("only boosting stops by the errors of a part")
    if stop_on:
        preprocessor, trees = fitted.getStages()
        prepared = preprocessor.fit(parts[train])
        both = [prepared.transform(parts[p]).select("features", F.col(label), F.lit(p == stop_on).alias("__stop")) for p in (train, stop_on)]
        model = PipelineModel([prepared, trees.stopping("__stop", patience).fit(both[0].unionByName(both[1]))])
    else:
        model = fitted.fit(parts[train])
    predict = lambda df: model.transform(df) if back is None else model.transform(df).withColumn("prediction", back)
    duan = smearing(predict(parts[train]), target, "prediction")
    scored = {k: stored(predict(v).select(*dict.fromkeys([target, "prediction", *axes]))) for k, v in parts.items() if k != train}
    return Final(model, duan, {k: evaluate(v, target, "prediction", axes, duan) for k, v in scored.items()}, {k: residuals(v, target, "prediction", axes) for k, v in scored.items()} if axes else {})


def variants(parts: dict[str, DataFrame], runs: dict[str, dict], target: str, choose_on: str = "calibration") -> tuple[str, DataFrame]:
    """The metrics of all runs (keyword arguments of ``final_fit``) on all parts, and the name
    of the run with the least RMSLE on the part that may be looked at for choosing. All runs
    read the same parts, which are written once; a run's metrics are computed once."""
    out, scores = None, {}
    parts = {k: stored(v) for k, v in parts.items()}
    for name, kwargs in runs.items():
        f = _final_fit(parts, target=target, **kwargs)
        f.metrics = {part: stored(m) for part, m in f.metrics.items()}
        for part, m in f.metrics.items():
            row = m.withColumns({"variant": F.lit(name), "part": F.lit(part)})
            out = row if out is None else out.unionByName(row)
        scores[name] = f.metrics[choose_on].where("axis = 'all'").first()["rmsle"]
    return min(scores, key=lambda k: (scores[k], k)), out
