"""Feature preprocessing as a pyspark.ml stage that learns from training rows only."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean
from .selection import column_quantiles
from .linear import moments
from .redundancy import greedy_filter

#: The level of a missing category. An unknown level gets zeros in all columns.
MISSING = "__missing__"


class Preprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median filling, flags of what was missing, scaling, a correlation filter, one-hot.

    Flags are added for columns with missing values at the fit, and scaled like
    the rest; scaling is by the population deviation (constant columns stay 0).
    The filter comes last, drops the later of two numeric features whose |r| is
    above ``threshold`` and is off without one. No level is dropped from a
    category. Columns that are not named do not reach the features.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns of categories", TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "largest |r| that stays; 0: no filter", TypeConverters.toFloat)
    outputCol = Param(Params._dummy(), "outputCol", "column of feature vectors", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numeric: Sequence[str] = (), categorical: Sequence[str] = (), threshold: float = 0.0, outputCol: str = "features"):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], threshold=0.0, outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PreprocessorModel:
        numeric, categorical = self.getOrDefault("numeric"), self.getOrDefault("categorical")
        values = [clean(F.col(c).cast("double")) for c in numeric]
        stats = dataset.agg(*(F.count_if(v.isNull()).alias(f"n{i}") for i, v in enumerate(values)), *(F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))).alias(f"l{i}") for i, c in enumerate(categorical))).first()
        medians = {c: q or 0.0 for c, (q,) in column_quantiles(dataset.select(*(v.alias(c) for c, v in zip(numeric, values, strict=True))), numeric, [0.5]).items()}
        flags = [c for i, c in enumerate(numeric) if stats[f"n{i}"]]
        levels = {c: list(stats[f"l{i}"]) for i, c in enumerate(categorical)}
        names = [*numeric, *(f"missing_{c}" for c in flags)]
        filled = dataset.select(*(x.alias(n) for x, n in zip(_numbers(numeric, medians, flags), names, strict=True)))
        m = moments(filled, names)
        n = max(1, m.n)
        state = {
            "numeric": numeric,
            "medians": medians,
            "flags": flags,
            "levels": levels,
            "means": m.mean.tolist(),
            "deviations": [(m.cross[i, i] / n) ** 0.5 for i in range(len(names))],
            "stays": greedy_filter(m.correlation(), self.getOrDefault("threshold") or None),
        }
        model = PreprocessorModel()
        return model._set(state=json.dumps(state), outputCol=self.getOrDefault("outputCol"))


def _numbers(numeric: Sequence[str], medians: dict[str, float], flags: Sequence[str]) -> list[Column]:
    known = {c: clean(F.col(c).cast("double")) for c in numeric}
    return [F.coalesce(known[c], F.lit(float(medians[c]))) for c in numeric] + [known[c].isNull().cast("double") for c in flags]


class PreprocessorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """What a Preprocessor learned; all of it is column expressions."""

    state = Param(Params._dummy(), "state", "what the fit learned, as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of feature vectors", TypeConverters.toString)

    def features(self) -> list[str]:
        """Names of the features in the order of the vector."""
        s = json.loads(self.getOrDefault("state"))
        names = [*s["numeric"], *(f"missing_{c}" for c in s["flags"])]
        return [n for n, stays in zip(names, s["stays"], strict=True) if stays] + [f"{c}={v}" for c, vs in s["levels"].items() for v in vs]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = json.loads(self.getOrDefault("state"))
        if absent := [c for c in [*s["numeric"], *s["levels"]] if c not in dataset.columns]:
            raise ValueError(f"missing columns: {absent}")
        scaled = [(x - F.lit(m)) / F.lit(d) if d > 0 else F.lit(0.0) for x, m, d in zip(_numbers(s["numeric"], s["medians"], s["flags"]), s["means"], s["deviations"], strict=True)]
        parts = [x for x, stays in zip(scaled, s["stays"], strict=True) if stays]
        for c, levels in s["levels"].items():
            value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            parts += [(value == v).cast("double") for v in levels]
        names = [f"__x{i}" for i in range(len(parts))]
        wide = dataset.select("*", *(p.alias(n) for p, n in zip(parts, names, strict=True)))
        return VectorAssembler(inputCols=names, outputCol=self.getOrDefault("outputCol")).transform(wide).drop(*names)
