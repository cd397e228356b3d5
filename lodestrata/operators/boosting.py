"""Boosted trees by Newton steps, on histograms of gradients that Spark adds up."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import column_quantiles
from .stored import stored

#: A value's code is the number of cuts below it, in one byte; the last code is a missing value.
GONE, MOST_CUTS = 255, 254
#: Codes of one row must stay small against a batch, and cuts of all features go with each task.
MOST_FEATURES = 4_096
#: Bytes of sums that a task holds; beyond, it hands on those of each batch for Spark to combine.
TASK_BYTES = 64 << 20
#: Margins are written after so many trees; a pass applies the trees since.
TREES_A_TABLE = 10
#: A tree's nodes are numbered as in a heap.
DEEPEST = 12

_SUMS = "node int, feature int, code int, g long, h long, loss double, rows long"
_ROWS = "codes binary, y double, id long, stop boolean, margin double"


def cuts_of(columns: dict[str, list[float | None]]) -> list[np.ndarray]:
    """The thresholds of each feature: its distinct quantiles but the largest."""
    return [np.unique([v for v in q if v is not None])[:-1] for q in columns.values()]


def codes_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """One byte for each value: the number of cuts below it, ``GONE`` for NaN."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), GONE, np.searchsorted(c, x[:, j], side="left"))
    return out


def unit_of(largest: float, n: int) -> float:
    """A power of two so small, yet so large, that ``n`` numbers up to ``largest`` add up exactly as whole multiples in 64 bits."""
    return 2.0 ** (math.ceil(math.log2(max(largest, 1e-200))) - min(36, 61 - math.ceil(math.log2(n + 1))))


def empty_tree(depth: int) -> dict[str, np.ndarray]:
    n = 2 ** (depth + 1) - 1
    return {"feature": np.full(n, -1, np.int32), "code": np.zeros(n, np.int32), "gone_left": np.zeros(n, bool), "value": np.zeros(n)}


def walk(tree: dict[str, np.ndarray], x: np.ndarray, gone: np.ndarray, at: str = "code") -> np.ndarray:
    """The node that each row of ``x`` ends in; ``at`` names the thresholds to compare with."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(int(math.log2(len(tree["feature"]) + 1)) - 1):
        f = tree["feature"][node]
        if (f < 0).all():
            break
        left = np.where(gone[rows, f], tree["gone_left"][node], x[rows, f] <= tree[at][node])
        node = np.where(f < 0, node, 2 * node + 2 - left)
    return node


def drawn(ids: np.ndarray, seed: int, tree: int, rate: float) -> np.ndarray:
    """Which rows a tree sees: a hash of the row's id, so that no partitioning changes it."""
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2**64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) < np.uint64(int(rate * 2**53))


def _slopes(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the margin, and the loss."""
    if objective == "logistic":
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - y, p * (1 - p), np.logaddexp(0, margin) - y * margin
    return margin - y, np.ones(len(y)), (margin - y) ** 2


def _columns(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, features)
    y, ids, stop, margin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "id", "stop", "margin"))
    return codes, y, ids, stop.astype(bool), margin


def _in_parts(batches: Iterator[pa.RecordBatch], rows: int = 8_192) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))


def _margins(recent: Sequence[dict], codes: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for t in recent:
        margin = margin + t["value"][walk(t, codes, codes == GONE)]
    return margin


def _histograms(tree: dict, level: int, recent: Sequence[dict], features: int, used: np.ndarray, objective: str, unit: float, draw: tuple[int, int, float]):
    """A function for ``mapInArrow``: sums of slopes by node of a level, feature and code.

    Slopes are rounded to whole numbers of ``unit``, so that sums are exact in any order:
    trees depend neither on partitions nor on tasks that run twice. On the first level a row of
    node -1 holds the loss of rows that only say when to stop."""
    first, nodes = 2**level - 1, 2**level
    size = nodes * len(used) * 256
    names = ["node", "feature", "code", "g", "h", "loss", "rows"]

    def out(at: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        node, rest = np.divmod(at, len(used) * 256)
        columns = [(node + first).astype(np.int32), used[rest // 256].astype(np.int32), (rest % 256).astype(np.int32), g, h, np.zeros(len(at)), np.zeros(len(at), np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64) if size * 16 <= TASK_BYTES else None
        loss, stops = 0.0, 0
        for batch in _in_parts(batches):
            codes, y, ids, stop, margin = _columns(batch, features)
            g, h, lost = _slopes(objective, _margins(recent, codes, margin), y)
            if level == 0:
                loss, stops = loss + float(lost[stop].sum()), stops + int(stop.sum())
            node = walk(tree, codes, codes == GONE) - first
            mine = ~stop & (node >= 0) & drawn(ids, *draw)
            place = ((node[mine, None] * len(used) + np.arange(len(used))) * 256 + codes[mine][:, used]).ravel()
            # 8,192 numbers below 2^36 add up exactly in doubles.
            g, h = (np.repeat(np.rint(v[mine] / unit), len(used)) for v in (g, h))
            if sums is not None:
                sums += np.array([np.bincount(place, v, size) for v in (g, h)]).astype(np.int64)
            elif len(place):
                at, where = np.unique(place, return_inverse=True)
                yield out(at, *(np.bincount(where, v).astype(np.int64) for v in (g, h)))
        if sums is not None:
            at = np.flatnonzero(sums.any(axis=0))
            yield out(at, *sums[:, at])
        if level == 0:
            last = [np.array([-1], np.int32), np.array([-1], np.int32), np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([loss]), np.array([stops], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)

    return run


def best_splits(sums: DataFrame, unit: float, reg_lambda: float, min_child_weight: float) -> DataFrame:
    """(node, g, h, loss, rows, split) of ``sums`` by node, feature and code: the split of the largest gain,
    of equals the one of the first feature and least code. It is null where no split gains.

    A split sends codes up to its own to the left, and missing values to the better side."""
    upto, whole = "OVER (PARTITION BY node, feature ORDER BY code)", "OVER (PARTITION BY node, feature)"
    each = lambda e: [e.replace("$", c) for c in "gh"]
    score = lambda g, h: f"{g} * {g} / ({h} + {float(reg_lambda)!r}D)"
    right = "(g_node - g_left)", "(h_node - h_left)"
    w = sums.groupBy("node", "feature", "code").agg({c: "sum" for c in ("g", "h", "loss", "rows")}).withColumnsRenamed({f"sum({c})": c for c in ("g", "h", "loss", "rows")})
    w = w.selectExpr("*", *each(f"sum($) {upto} AS $_upto"), *each(f"sum($) {whole} AS $_all"), *each(f"sum(if(code = {GONE}, $, 0L)) {whole} AS $_gone"))
    w = w.selectExpr("*", "explode(if(g_gone != 0 OR h_gone != 0, array(false, true), array(false))) AS gone_left")
    w = w.selectExpr("node", "feature", "code", "gone_left", "if(gone_left, 0, loss) AS loss", "if(gone_left, 0, rows) AS rows", *each(f"($_upto + if(gone_left, $_gone, 0L)) * {unit!r}D AS $_left"), *each(f"$_all * {unit!r}D AS $_node"))
    allowed = f"node >= 0 AND code != {GONE} AND least(h_left, {right[1]}) >= {max(float(min_child_weight), unit)!r}D"
    w = w.selectExpr("*", f"if({allowed}, {score('g_left', 'h_left')} + {score(*right)} - {score('g_node', 'h_node')}, 0D) AS gain")
    split = "if(gain > 0, struct(gain, -feature AS feature, -code AS code, gone_left, g_left, h_left), null)"
    return w.groupBy("node").agg(*map(F.expr, ("max(g_node) AS g", "max(h_node) AS h", "sum(loss) AS loss", "sum(rows) AS rows", f"max({split}) AS split")))


class Boosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trees that each take one Newton step of a loss ("squared", or "logistic" for labels 0 and 1).

    Features are vectors, NaN is a missing value; rows without a label are left out, a table of
    nothing else is an error. Values become one byte each by exact quantiles (254 at most; every pair
    of values is told apart in a table of 255 rows). Each level of a tree is one pass: tasks add up slopes by
    node, feature and code, Spark adds up tasks and finds the best split of each node, and the driver gets
    a row for each node. So its work grows with nodes, never with rows. A leaf's value is
    ``-stepSize * G / (H + regLambda)``, and a child needs ``minChildWeight`` of H.

    ``subsample`` draws rows for each tree by a hash of ``idCol`` (or of features and label, so
    that repeated rows are drawn together), ``colsample`` features. Rows where ``stopCol`` is true are not
    learned from: fitting ends after ``patience`` trees without a lower loss on them, and the trees
    up to the best one stay. The same rows give the same trees in any partitioning."""

    maxIter = Param(Params._dummy(), "maxIter", "most trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a step that is taken", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "penalty of squared leaf values", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least second derivative of a child", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows a tree sees", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of features a tree sees", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of both", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "trees without a better one", TypeConverters.toInt)
    objective = Param(Params._dummy(), "objective", "squared or logistic", TypeConverters.toString)
    stopCol = Param(Params._dummy(), "stopCol", "rows that only say when to stop; empty: none", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "column that rows are drawn by; empty: their values", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, maxIter: int = 50, maxDepth: int = 4, stepSize: float = 0.1, regLambda: float = 1.0, minChildWeight: float = 1.0, subsample: float = 1.0, colsample: float = 1.0, seed: int = 0, patience: int = 50, objective: str = "squared", stopCol: str = "", idCol: str = "", featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(maxIter=50, maxDepth=4, stepSize=0.1, regLambda=1.0, minChildWeight=1.0, subsample=1.0, colsample=1.0, seed=0, patience=50, objective="squared", stopCol="", idCol="")
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, value: str) -> Boosting:
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> Boosting:
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> Boosting:
        return self._set(predictionCol=value)

    def stopping(self, column: str, patience: int) -> Boosting:
        """A copy that stops by the rows where ``column`` is true."""
        return self.copy()._set(stopCol=column, patience=patience)

    def _coded(self, dataset: DataFrame) -> tuple[DataFrame, list[np.ndarray], float, int, float]:
        """Rows with a byte for each feature, written once; cuts; the first margin; the number of rows; the largest slope."""
        p = self.getOrDefault
        features = F.col(p("featuresCol"))
        dataset = dataset.where(F.col(p("labelCol")).isNotNull() & ~F.isnan(F.col(p("labelCol")).cast("double")))
        stop = F.coalesce(F.col(p("stopCol")), F.lit(False)) if p("stopCol") else F.lit(False)
        x, y = vector_to_array(features), F.col(p("labelCol")).cast("double")
        number = F.xxhash64(F.col(p("idCol"))) if p("idCol") else F.xxhash64(x, y)
        rows = stored(dataset.select(x.alias("x"), y.alias("y"), number.alias("id"), stop.alias("stop")))
        learned = rows.where(~F.col("stop"))
        n, low, high, width = learned.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to learn from")
        if width > MOST_FEATURES or p("maxDepth") > DEEPEST:
            raise ValueError(f"at most {MOST_FEATURES} features and {DEEPEST} levels")
        unit = unit_of(max(abs(low), abs(high)), n)
        mean = learned.agg(F.sum(F.rint(F.col("y") / unit).cast("long"))).first()[0] * unit / n
        if p("objective") == "logistic":
            if low < 0 or high > 1:
                raise ValueError("labels of the logistic loss lie from 0 to 1")
            rate = min(max(mean, 1e-6), 1 - 1e-6)
            base, slope = math.log(rate / (1 - rate)), 1.0
        else:
            base, slope = mean, max(high - mean, mean - low)
        names = [f"x{i}" for i in range(width)]
        values = learned.select(*(F.col("x")[i].alias(c) for i, c in enumerate(names)))
        cuts = cuts_of(column_quantiles(values, names, [j / MOST_CUTS for j in range(MOST_CUTS + 1)]))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _in_parts(batches):
                flat = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                packed = codes_of(flat, cuts)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), b.column("y"), b.column("id"), b.column("stop"), pa.array(np.full(len(flat), base))], names=["codes", "y", "id", "stop", "margin"])

        return stored(rows.mapInArrow(code, _ROWS)), cuts, base, n, slope

    def _fit(self, dataset: DataFrame) -> BoostingModel:
        p = self.getOrDefault
        rows, cuts, base, n, slope = self._coded(dataset)
        width, trees, since, errors = len(cuts), [], [], []
        for number in range(p("maxIter") + 1):
            only_loss = number == p("maxIter")
            if only_loss and not p("stopCol"):
                break
            unit = unit_of(max(slope, 1.0), n)
            used = np.sort(np.random.default_rng([p("seed"), number]).permutation(width)[: max(1, round(p("colsample") * width))])
            tree = empty_tree(p("maxDepth"))
            for level in range(p("maxDepth")):
                sums = rows.mapInArrow(_histograms(tree, level, since, width, used, p("objective"), unit, (p("seed"), number, p("subsample"))), _SUMS)
                found = best_splits(sums, unit, p("regLambda"), p("minChildWeight")).collect()
                if level == 0 and (told := [r for r in found if r["node"] < 0 and r["rows"]]):
                    errors.append(told[0]["loss"] / told[0]["rows"])
                    if only_loss or len(errors) - 1 - int(np.argmin(errors)) >= p("patience"):
                        only_loss = True
                        break
                splits = [r for r in found if r["node"] >= 0]
                for r in splits:
                    self._grow(tree, r)
                if not any(r["split"] for r in splits):
                    break
            if only_loss:
                break
            trees.append(tree)
            since.append(tree)
            slope += float(np.abs(tree["value"]).max()) if p("objective") == "squared" else 0.0
            if len(since) == TREES_A_TABLE and number + 1 < p("maxIter"):
                rows, slope = self._moved(rows, since, width, slope)
                since = []
        keep = int(np.argmin(errors)) if errors else len(trees)
        model = BoostingModel()
        state = {"base": base, "width": width, "objective": p("objective"), "trees": [_plain(t, cuts) for t in trees[:keep]], "errors": errors}
        return model._set(state=json.dumps(state), featuresCol=p("featuresCol"), predictionCol=p("predictionCol"))

    def _grow(self, tree: dict, r) -> None:
        """A node's value, and where it splits its feature and its children's values."""
        p, i, s = self.getOrDefault, r["node"], r["split"]
        value = lambda g, h: -p("stepSize") * g / (h + p("regLambda")) if h + p("regLambda") > 0 else 0.0
        if i == 0:
            tree["value"][0] = value(r["g"], r["h"])
        if s:
            tree["feature"][i], tree["code"][i], tree["gone_left"][i] = -s["feature"], -s["code"], s["gone_left"]
            tree["value"][2 * i + 1], tree["value"][2 * i + 2] = value(s["g_left"], s["h_left"]), value(r["g"] - s["g_left"], r["h"] - s["h_left"])
            tree["value"][i] = 0.0

    def _moved(self, rows: DataFrame, since: list[dict], width: int, slope: float) -> tuple[DataFrame, float]:
        """Rows with the margins of all trees so far, written; and their largest slope."""

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _in_parts(batches):
                codes, _, _, _, margin = _columns(b, width)
                yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(_margins(since, codes, margin)))

        rows = stored(rows.mapInArrow(move, _ROWS))
        if self.getOrDefault("objective") == "squared":
            slope = rows.where(~F.col("stop")).agg(F.max(F.abs(F.col("margin") - F.col("y")))).first()[0]
        return rows, slope


def _plain(tree: dict, cuts: Sequence[np.ndarray]) -> dict:
    """A tree by thresholds in place of codes, as lists; beyond the last cut all values go left."""
    at = [float(cuts[f][c]) if f >= 0 and c < len(cuts[f]) else math.inf for f, c in zip(tree["feature"], tree["code"], strict=True)]
    return {"feature": tree["feature"].tolist(), "threshold": at, "gone_left": tree["gone_left"].tolist(), "value": tree["value"].tolist()}


class BoostingModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees. The prediction is the margin, and the probability for the logistic loss."""

    state = Param(Params._dummy(), "state", "the trees, as JSON", TypeConverters.toString)

    def learned(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    @property
    def getNumTrees(self) -> int:  # noqa: N802  as Spark's own trees call it
        return len(self.learned()["trees"])

    @property
    def errors(self) -> list[float]:
        """The mean loss of the stopping rows after none, one, two and more trees."""
        return self.learned()["errors"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.learned()
        trees = [{k: np.array(v) for k, v in t.items()} for t in s["trees"]]
        base, width, logistic = s["base"], s["width"], s["objective"] == "logistic"

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            values = np.array(x.tolist(), dtype=np.float64).reshape(-1, width)
            margin, gone = np.full(len(values), base), np.isnan(values)
            for t in trees:
                margin += t["value"][walk(t, values, gone, "threshold")]
            return pd.Series(1 / (1 + np.exp(-np.clip(margin, -500, 500))) if logistic else margin)

        return dataset.withColumn(self.getOrDefault("predictionCol"), predict(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
