"""Near-duplicate embeddings found by a forest of random-projection trees with spill."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .shared import table
from .simhash import components, join_up

#: Distinct vectors of a leaf at most, and the share of a node's that go to both sides of a split.
LEAF, SPILL = 2_048, 0.1
#: Levels that one round adds to all nodes that are too large, and distinct vectors that
#: a node's splits are fitted on: a bounded sample, drawn by a hash.
LEVELS, SAMPLE = 5, 4_096
#: The chance that one split parts a pair at the threshold (measured: 0.05 on vectors of
#: 64 random entries), and that all trees may part it; the two give the number of trees.
PARTED, MISSED = 0.1, 0.002
#: A ball is sought around vectors that have this share of a node's sample so near that all
#: pairs inside are linked for certain.
DENSE = 1 / 64
#: Rows of similarities, and pairs, that are looked at a time.
STEP, PAIRS = 512, 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def unit(raw: list[bytes], size: int) -> np.ndarray:
    """Vectors from their bytes, of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * size else "<f8").reshape(len(raw), size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction(tree: int, depth: int, size: int) -> np.ndarray:
    """The random unit vector onto which a tree projects at a depth."""
    r = np.random.default_rng((7, tree, depth)).standard_normal(size)
    return r / np.linalg.norm(r)


def jitter(n: np.ndarray) -> np.ndarray:
    """A tiny number for each vector's number, which parts equal projections evenly."""
    return ((n.astype(np.uint64) * _ODD) >> np.uint64(11)).astype(np.float64) * (1e-9 / 2**53)


def levels(vectors: int) -> int:
    """Splits on the way to a leaf of that many vectors."""
    return max(0, math.ceil(math.log(max(1, vectors) / LEAF) / -math.log(0.5 + SPILL / 2)))


def trees(vectors: int) -> int:
    """Trees for a group of that many vectors, so that a pair at the threshold meets in one of
    them but for a chance of ``MISSED``: deeper trees part more pairs and take more trees."""
    together = (1 - PARTED) ** levels(vectors)
    return 1 if together == 1 else math.ceil(math.log(MISSED) / math.log(1 - together))


def balls(x: np.ndarray, inside: float) -> np.ndarray:
    """Centres around which at least a share of ``DENSE`` of the vectors lies within a
    cosine of ``inside``, the fullest first; a vector counts for one centre."""
    near = np.concatenate([x[lo : lo + STEP] @ x.T >= inside for lo in range(0, len(x), STEP)])
    least, left, found = max(32, DENSE * len(x)), np.ones(len(x), bool), []
    count = near.sum(1)
    while True:
        i = int(np.where(left, count, -1).argmax())
        if not left[i] or count[i] < least:
            return np.array(found).reshape(len(found), x.shape[1])
        own = near[i] & left
        centre = x[own].mean(axis=0)
        found.append(centre / np.linalg.norm(centre))
        left &= ~own
        count = count - near[:, own].sum(1)


def splits(x: np.ndarray, n: np.ndarray, tree: int, depth: int, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of ``deep`` levels, top down and from the left: a vector projected up to
    the second number goes left, above the first one right, so between them both ways."""
    low, high = np.zeros(2**deep - 1), np.zeros(2**deep - 1)
    parts = [np.arange(len(x))]
    for step in range(deep):
        z = x @ direction(tree, depth + step, x.shape[1]) + jitter(n)
        below = []
        for i, part in enumerate(parts):
            at = 2**step - 1 + i
            if len(part):
                low[at], high[at] = np.quantile(z[part], [0.5 - SPILL / 2, 0.5 + SPILL / 2])
            below += [part[z[part] <= high[at]], part[z[part] > low[at]]]
        parts = below
    return low, high


def classes(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, label, h (128-bit hash of the vector), size and raw (its bytes) of each row; the
    last three are null where a vector or its label links with nothing."""
    kind = vectors.schema[vector].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)):
        vectors = vectors.withColumn(vector, F.col(vector).cast("array<double>"))

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            numbers, at = column.values.to_numpy(zero_copy_only=False) + 0.0, column.offsets.to_numpy()
            there = np.asarray(column.is_valid()) & np.asarray(batch.column(1).is_valid())
            raw: list[bytes | None] = []
            for i in range(len(batch)):
                v = numbers[at[i] : at[i + 1]]
                raw.append(v.tobytes() if there[i] and len(v) and np.isfinite(v).all() and v.any() else None)
            size = [None if r is None else len(r) // numbers.itemsize for r in raw]
            h = [None if r is None else hashlib.md5(r, usedforsecurity=False).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(h, pa.binary()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["key", "label", "h", "size", "raw"])

    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    types = {c: rows.schema[c].dataType.simpleString() for c in ("key", "label")}
    return rows.mapInArrow(run, f"key {types['key']}, label {types['label']}, h binary, size int, raw binary")


def plant(nodes: DataFrame, inside: float) -> tuple[DataFrame, DataFrame | None]:
    """(n, leaf) of every vector in every tree, and (n, ball) of those in dense groups.

    ``nodes`` has n, g (the group), vectors (in the group), size and raw. A group of one leaf
    has one tree without splits. In others all nodes above ``LEAF`` get up to
    ``LEVELS`` levels a round, fitted on a sample of each; rounds go on until no node is
    larger. Only numbers are written between rounds. As vectors come in order of
    number from a table, reruns go the same way.
    """
    spark = nodes.sparkSession
    place = ["g", "tree", "node"]
    leaf = F.xxhash64(*place).alias("leaf")
    small = nodes.where(F.col("vectors") <= LEAF).select("n", F.xxhash64("g", F.lit(0), F.lit(1).cast("long")).alias("leaf"))
    large = nodes.where(F.col("vectors") > LEAF)
    most = large.agg(F.max("vectors")).first()[0]
    if most is None:
        return small, None
    leaves, dense = [small], []
    wanted = F.lit(1)
    for deep in range(1, levels(most) + 1):
        above = math.floor(LEAF / (0.5 + SPILL / 2) ** (deep - 1))  # larger groups take that many levels at least
        wanted = F.when(F.col("vectors") > above, F.lit(trees(above + 1))).otherwise(wanted)
    active = large.select("n", "g", F.explode(F.sequence(F.lit(0), wanted - 1)).alias("tree"), F.lit(1).cast("long").alias("node"), F.col("vectors").alias("m"))
    vectors = nodes.select("n", "size", "raw")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        tree, node, size = int(first["tree"]), int(first["node"]), int(first["size"])
        pdf = pdf.sort_values("n")
        x, n = unit(pdf["raw"].tolist(), size), pdf["n"].to_numpy()
        deep = min(LEVELS, max(1, levels(int(first["m"]))))
        low, high = splits(x, n, tree, node.bit_length() - 1, deep)
        centres = balls(x, inside) if tree == 0 else np.zeros((0, size))
        return pd.DataFrame({"g": [first["g"]], "tree": [tree], "node": [node], "deep": [deep], "low": [low.tolist()], "high": [high.tolist()], "centres": [centres.tobytes()]})

    def route(batches):
        for batch in batches:
            n, g, tree, node, size, deep = (batch.column(c).to_numpy() for c in ("n", "g", "tree", "node", "size", "deep"))
            raw, centres = batch.column("raw").to_pylist(), batch.column("centres")
            low, high = (batch.column(c) for c in ("low", "high"))
            out = []
            kinds = np.stack([size, tree, [int(v).bit_length() - 1 for v in node], deep], axis=1)
            for kind in np.unique(kinds, axis=0) if len(n) else []:
                width, t, depth, down = (int(v) for v in kind)
                at = np.flatnonzero((kinds == kind).all(axis=1))
                x = unit([raw[i] for i in at.tolist()], width)
                ball = np.full(len(at), -1)
                if t == 0:
                    for home in np.unique(np.stack([g[at], node[at]], axis=1), axis=0):
                        own = np.flatnonzero((g[at] == home[0]) & (node[at] == home[1]))
                        c = np.frombuffer(centres[int(at[own[0]])].as_py(), np.float64).reshape(-1, width)
                        if len(c):
                            cosine = x[own] @ c.T
                            ball[own] = np.where(cosine.max(axis=1) >= inside, cosine.argmax(axis=1), -1)
                take = pa.array(at)
                lo, hi = (b.take(take).flatten().to_numpy().reshape(len(at), -1) for b in (low, high))
                row, place_ = np.arange(len(at)), np.zeros(len(at), np.int64)
                noise = jitter(n[at])
                for step in range(down):
                    z = (x @ direction(t, depth + step, width) + noise)[row]
                    here = 2**step - 1 + place_
                    left, right = z <= hi[row, here], z > lo[row, here]
                    row, place_ = np.concatenate([row[left], row[right]]), np.concatenate([2 * place_[left], 2 * place_[right] + 1])
                home = node[at][row]
                out.append(pa.RecordBatch.from_arrays([pa.array(n[at][row]), pa.array(g[at][row]), pa.array(np.full(len(row), t, np.int32)), pa.array((home << down) + place_), pa.array(home), pa.array(ball[row].astype(np.int32))], ["n", "g", "tree", "node", "above", "ball"]))
            yield from out

    ids = "n long, g long, tree int, node long"
    while True:
        drawn = active.where(F.shiftrightunsigned(F.xxhash64("n", *place), 11) < F.lit(SAMPLE) / F.col("m") * F.lit(float(2**53)))
        fitted = drawn.join(vectors, "n").groupBy(*place).applyInPandas(fit, "g long, tree int, node long, deep int, low array<double>, high array<double>, centres binary")
        routed = active.drop("m").join(table(fitted), place).join(vectors, "n").mapInArrow(route, f"{ids}, above long, ball int")
        routed = table(routed)
        dense.append(routed.where("ball >= 0").select("n", F.lit(len(dense)).alias("round"), F.xxhash64("g", "above", "ball").alias("ball")))
        sized = table(routed.groupBy(*place).agg(F.count(F.lit(1)).alias("m")))
        leaves.append(routed.join(sized.where(F.col("m") <= LEAF).select(*place), place).select("n", leaf))
        if sized.where(F.col("m") > LEAF).isEmpty():
            break
        active = routed.select("n", *place).join(sized.where(F.col("m") > LEAF), place)
    found, at = leaves[0], dense[0]
    for more, balls_ in zip(leaves[1:], [*dense[1:], None], strict=True):
        found = found.unionByName(more)
        at = at if balls_ is None else at.unionByName(balls_)
    return found, table(at.groupBy("n").agg(F.min(F.struct("round", "ball"))["ball"].alias("ball")))


def links(nodes: DataFrame, found: DataFrame, dense: DataFrame | None, least: float) -> DataFrame:
    """(a, b, links): per leaf, what its vectors ``a`` link to, copies counted, and an edge to
    ``b`` in a spanning forest of the leaf's links.

    All pairs of a leaf are compared in double precision. A pair that meets in several
    leaves counts in the one with the least number; a pair in one ball is no pair here.
    """
    met = table(found.groupBy("n").agg(F.sort_array(F.collect_set("leaf")).alias("met")))
    rows = nodes.select("n", "copies", "size", "raw").join(met, "n")
    rows = rows.withColumn("ball", F.lit(None).cast("long")) if dense is None else rows.join(dense, "n", "left")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        here = int(pdf["leaf"].iloc[0])
        x = unit(pdf["raw"].tolist(), int(pdf["size"].iloc[0]))
        n, copies = pdf["n"].to_numpy(), pdf["copies"].to_numpy()
        # A vector in no ball gets a number of its own.
        ball = np.where(pdf["ball"].isna(), -1 - np.arange(len(n)), pd.factorize(pdf["ball"])[0])
        wide = max(map(len, pdf["met"]))
        before = np.full((len(n), wide), here)
        for i, leaves in enumerate(pdf["met"]):
            before[i, : len(leaves)] = leaves
        before = np.minimum(before, here)  # leaves from here on count as this one
        before = before[:, (before < here).any(axis=0)]
        parent, total = np.arange(len(n)), np.zeros(len(n))
        for lo in range(0, len(n), STEP):
            a, b = np.nonzero(x[lo : lo + STEP] @ x.T >= least)
            a = a + lo
            new = (a < b) & (ball[a] != ball[b])
            a, b = a[new], b[new]
            for part in range(0, len(a), PAIRS):
                i, j = a[part : part + PAIRS], b[part : part + PAIRS]
                first = np.ones(len(i), bool)
                for c in range(before.shape[1]):
                    mine = before[i, c]
                    first &= ~((before[j] == mine[:, None]).any(axis=1) & (mine < here))
                i, j = i[first], j[first]
                total += np.bincount(i, copies[j], len(n)) + np.bincount(j, copies[i], len(n))
                join_up(parent, i, j)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        out = np.flatnonzero((total > 0) | (parent != np.arange(len(n))))
        return pd.DataFrame({"a": n[out], "b": n[parent[out]], "links": total[out].astype(np.int64)})

    return rows.withColumn("leaf", F.explode("met")).groupBy("leaf").applyInPandas(compare, "a long, b long, links long")


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", least: float = 0.93) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Vectors of equal, known label and equal length are linked at a cosine of ``least`` or
    more. Equal vectors are one node with its number of copies. Each label's vectors
    are dealt to leaves by random-projection trees (``plant``), compared within
    leaves and united. In a dense group, all vectors within half of the threshold's
    angle of a centre are links of each other, by the triangle inequality: they are counted
    and united without pairs, so a group of near copies costs its size, not its square.

    Vectors that are null, empty, zero or hold null or non-finite entries, and those without
    a label, get no link and their own key. Repeated rows are copies of each other; a null key names no
    component unless it has no other, and is never kept. No rows in, no rows out.
    """
    rows = table(classes(vectors, key, label, vector))
    distinct = rows.where("raw is not null").groupBy("label", "h").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("raw").alias("raw"))
    distinct = table(distinct.withColumn("n", F.monotonically_increasing_id()))
    groups = table(distinct.groupBy("label", "size").agg(F.count(F.lit(1)).alias("vectors")).withColumn("g", F.monotonically_increasing_id()))
    nodes = distinct.join(groups, ["label", "size"])
    inside = math.cos(math.acos(least) / 2) + 1e-9
    found, dense = plant(nodes, inside)
    linked = table(links(distinct, found, dense, least))
    edges = linked.select("a", "b").where("a != b")
    each = distinct.select("n", "label", "h", "least", "copies").join(linked.groupBy(F.col("a").alias("n")).agg(F.sum("links").alias("links")), "n", "left")
    extra = F.lit(0)
    if dense is not None:
        sizes = table(dense.join(distinct.select("n", "copies"), "n").groupBy("ball").agg(F.sum("copies").alias("total"), F.min("n").alias("hub")))
        inside_ = table(dense.join(sizes, "ball").select("n", "total", "hub"))
        edges = edges.unionByName(inside_.where("n != hub").select(F.col("n").alias("a"), F.col("hub").alias("b")))
        each = each.join(inside_.select("n", "total"), "n", "left")
        extra = F.coalesce(F.col("total") - F.col("copies"), F.lit(0))
    labels = components(edges).withColumnRenamed("node", "n")
    named = table(each.join(labels, "n", "left").select("label", "h", "least", F.coalesce("root", "n").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0)) + extra).alias("n_links")))
    names = table(named.groupBy("root").agg(F.min("least").alias("component")))
    found = table(named.join(names, "root").select("label", "h", "n_links", "component"))
    component = F.coalesce("component", "key")
    return rows.select("key", "label", "h").join(found, ["label", "h"], "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept")
    )
