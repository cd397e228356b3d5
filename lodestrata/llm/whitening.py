"""Whitening of embeddings by matrix-free block Lanczos over distributed passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Components wanted, and vectors of one block.
COMPONENTS, BLOCK = 16, 16
#: A component is found when its residual is below this share of the largest eigenvalue.
RESIDUAL = 1e-13
#: A direction that a new block adds counts as none (breakdown) below this share of the
#: operator's norm; an eigenvalue below it counts as zero.
BREAKDOWN, ZERO = 1e-12, 1e-11
#: The fixed point of entries: floor(64 c) + 1,000,000.
SCALE, SHIFT = 64, 1_000_000
#: Rows that are multiplied at a time.
STEP = 8_192


def stack(column: pa.Array, kind: type) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def fixed_point(vectors: DataFrame, vector: str = "embedding", to: str = "x") -> DataFrame:
    """``vectors`` with ``to``, the entries as long fixed-point numbers, in place of ``vector``.

    Rows go whose vector is null or holds a null, NaN or infinite entry. An entry of
    2^40 or more is an error, as it has no exact fixed-point number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    c = lambda e: e.cast("double")
    number = lambda e: F.when(F.abs(c(e)) < float(2**40), F.floor(SCALE * c(e)) + F.lit(SHIFT)).otherwise(F.raise_error(F.lit("an entry of 2^40 or more")).cast("long"))
    return vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn(to, F.transform(vector, number)).drop(*([vector] if to != vector else []))


@dataclass
class Fit:
    """The distinct vectors in a table, their number, and the sums by dimension of their
    entries less ``SHIFT``, which moves no deviation and keeps products small."""

    rows: DataFrame
    n: int
    sums: np.ndarray

    def over(self, task: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``task`` (``size`` numbers) over all vectors, centred, by parts.

        The centred vector is (n x - S) / n: exact integers up to the one division. Tasks
        add up their rows; Spark adds up tasks, number by number."""
        n, sums = self.n, self.sums

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                x = stack(batch.column(0), np.int64)
                for lo in range(0, len(x), STEP):
                    total += task((n * (x[lo : lo + STEP] - SHIFT) - sums) / n).ravel()
            yield pa.RecordBatch.from_pydict({"at": np.arange(size, dtype=np.int32), "value": total})

        out = np.zeros(size)
        for r in self.rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[r["at"]] = r["value"]
        return out

    def covariance_times(self, v: np.ndarray) -> np.ndarray:
        """V v for a block of vectors, V never formed: the sum of z (z v) over centred z."""
        return self.over(lambda z: z.T @ (z @ v), v.size).reshape(v.shape) / self.n

    def trace(self) -> float:
        """The sum of all variances, from squared deviations."""
        return float(self.over(lambda z: np.array([(z * z).sum()]), 1)[0]) / self.n


def fit_list(numbers: DataFrame, x: str = "x") -> Fit:
    """Each distinct vector of ``numbers`` once, in the shared folder; all must be equally
    long. Copies meet in map tasks first, so a vector that fills a third of the table
    costs a row a task."""
    rows = table(numbers.select(F.col(x).alias("x")).distinct())
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v - SHIFT)))).alias("most")).first()
    if about["low"] != about["high"]:
        raise ValueError(f"vectors of {about['low']} to {about['high']} entries")
    if about["n"] * (about["most"] or 0) >= 1 << 55:
        raise ValueError(f"{about['n']} vectors with entries up to {about['most']}: products are not exact")
    d = about["high"] or 0

    def run(batches):
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += (stack(batch.column(0), np.int64) - SHIFT).sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(d, dtype=np.int32), "value": total})

    sums = np.zeros(d, np.int64)
    if d:
        for r in rows.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
            sums[r["at"]] = r["value"]
    return Fit(rows, about["n"], sums)


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, block: int = BLOCK, seed: int = 13, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray, dict]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors (columns) of
    a symmetric operator of ``d`` dimensions that is only multiplied with blocks.

    Each step multiplies the newest block, takes out its parts along all vectors so
    far, twice (full reorthogonalisation), and what is left becomes the next block.
    Directions in which nothing is left (breakdown: the space is invariant) start again
    from random vectors orthogonal to all. A block is as wide as ``wanted`` at least, so
    that an eigenvalue that repeats is found as often as it is wanted.
    It ends when all wanted pairs have a residual below ``residual`` of the largest
    eigenvalue, as told by the part of the last product outside the space, or when the
    space is whole. Beside one block a pass, memory is d vectors at most.
    """
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    wanted, block, stats = min(wanted, d), max(block, wanted), {"passes": 0, "restarts": 0}

    def orthogonal(v: np.ndarray, at: float) -> tuple[np.ndarray, int]:
        """An orthonormal block outside the space, as wide as there is room for, and how
        many of its columns are new starts; parts below ``at`` count as nothing."""
        room = min(block, d - basis.shape[1])
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        u, s, _ = np.linalg.svd(v, full_matrices=False)
        u = u[:, s > at][:, :room]
        restarts = room - u.shape[1]
        while u.shape[1] < room:
            fresh = rng.standard_normal((d, room - u.shape[1]))
            old = np.hstack([basis, u])
            for _ in range(2):
                fresh = fresh - old @ (old.T @ fresh)
                fresh = np.linalg.qr(fresh)[0]
            u = np.hstack([u, fresh])
        for _ in range(2):
            u = np.linalg.qr(u - basis @ (basis.T @ u))[0]
        return u, restarts

    new, _ = orthogonal(rng.standard_normal((d, min(block, d))), 0.0)
    while True:
        product = times(new)
        stats["passes"] += 1
        basis, images = np.hstack([basis, new]), np.hstack([images, product])
        small = basis.T @ images
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        top = max(abs(values[0]), abs(values[-1])) if len(values) else 0.0
        ritz = basis @ y[:, :wanted]
        left = np.linalg.norm(images @ y[:, :wanted] - ritz * values[:wanted], axis=0)
        if basis.shape[1] >= d or basis.shape[1] >= wanted and (left <= residual * top).all():
            break
        new, restarts = orthogonal(product, BREAKDOWN * top)
        stats["restarts"] += restarts
    stats["residual"] = float(left.max() / top) if top > 0 and len(left) else 0.0
    return values[:wanted], ritz, stats


@dataclass
class Whitening:
    """Unit eigenvectors (columns) with their eigenvalues, falling; the trace of the
    covariance; and the largest entry of the whitened covariance less the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    stats: dict


def learn(numbers: DataFrame, x: str = "x", wanted: int = COMPONENTS) -> Whitening:
    """The components of the distinct vectors of ``numbers``. Eigenvalues that are zero to
    rounding have no whitened form and are left out; so one vector, or none, has no component."""
    fit = fit_list(numbers, x)
    d = len(fit.sums)
    if not fit.n or not d:
        return Whitening(fit.n, fit.sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, {"passes": 0})
    trace = fit.trace()
    values, vectors, stats = block_lanczos(fit.covariance_times, d, wanted) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), {"passes": 0})
    real = values > ZERO * (values[0] if len(values) else 0.0)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    error = 0.0
    if k:
        scaled = vectors / np.sqrt(values)
        mean = fit.over(lambda z: (z @ scaled).sum(0), k) / fit.n

        def cross(z: np.ndarray) -> np.ndarray:
            w = z @ scaled - mean
            return w.T @ w

        error = float(np.abs(fit.over(cross, k * k).reshape(k, k) / fit.n - np.eye(k)).max())
    return Whitening(fit.n, fit.sums, values, vectors, trace, error, stats)


def squared_lengths(y: np.ndarray) -> list[int]:
    """The exact sums of squares of the rows of integers below 2^55 in size: products of their
    high and low 26 bits are added over 32 dimensions at a time, then put together as
    numbers without a bound."""
    high, low = y >> 26, y & (1 << 26) - 1
    total = [0] * len(y)
    for lo in range(0, y.shape[1], 32):
        a, b = high[:, lo : lo + 32], low[:, lo : lo + 32]
        parts = zip((a * a).sum(1).tolist(), (a * b).sum(1).tolist(), (b * b).sum(1).tolist(), strict=True)
        total = [t + (aa << 52) + (ab << 27) + bb for t, (aa, ab, bb) in zip(total, parts, strict=True)]
    return total


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Per row with a whole vector and component: key, component (from 1), n, deviation,
    whitened, explained, identity_error and deviation_wide.

    Entries are taken in fixed point and the components learned from distinct vectors, so
    copies, however many, move nothing. ``deviation`` is null where it passes a long
    (n times its square root grows with n); ``deviation_wide`` is exact beyond.
    Rows that repeat get equal rows each, null keys stay, an empty table gives none.
    """
    rows = table(fixed_point(vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v", "x"))
    w = learn(rows, wanted=wanted)
    n, sums, k = w.n, w.sums, len(w.values)
    scaled = w.vectors / np.sqrt(w.values)

    def run(batches):
        for batch in batches:
            m = len(batch)
            if not m or not k:
                continue
            y = n * (stack(batch.column(1), np.int64) - SHIFT) - sums
            white = (y / n) @ scaled
            exact = squared_lengths(y)
            short = [v if v < 1 << 63 else None for v in exact]
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(short, pa.int64()).take(at), pa.array(white.ravel()), pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(at)],
                ["key", "component", "deviation", "whitened", "deviation_wide"],
            )

    out = rows.select("key", "x").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, component int, deviation long, whitened double, deviation_wide decimal(38,0)")
    share = F.element_at(F.array(*(F.lit(float(v / w.trace)) for v in w.values)), F.col("component")) if k else F.lit(0.0)
    return out.select(F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(w.identity_error).alias("identity_error"), "deviation_wide")
