"""SimHash near-duplicates found through a Gray-ordered hierarchical index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .shared import enter, free_name, table

#: Fingerprints of one index block, of one packed group within it, and children of a node.
BLOCK, GROUP, FAN = 2_048, 64, 8
#: The directory of blocks goes to every worker, so their number has a bound
#: (two 64-bit patterns a block: one MB); beyond it, blocks grow.
MOST_BLOCKS = 65_536
#: Shingles whose bits are counted, and pairs that are compared, at a time.
STEP = 1 << 16
#: Packed groups of one matching task; a block that gets more is compared in several tasks.
GUESTS = 1_024
#: Drawn fingerprints of a text and shingles in each: texts with a Jaccard similarity of
#: 0.8 share one with a probability of 1 - (1 - 0.8^5)^24 = 0.99993.
DRAWS, DRAWN = 24, 5
#: Where a draw looks for a shingle if its own part of the hashes has none, and what
#: tells equal draws at different places apart.
PROBES = np.random.default_rng(5).integers(0, DRAWS * DRAWN, (64, DRAWS * DRAWN))
MARKS = np.random.default_rng(6).integers(0, 2**64, DRAWS, np.uint64)
#: Documents, and hashes of their shingles, of one task that compares documents.
DOCS, HASHES = 1_024, 1 << 19
#: Documents with one code whose sketches are compared in one task; more are dealt into parts of
#: half as many, and every two parts meet in a task.
MOST = 2_048
#: How many deviations below the wanted similarity an estimate from sketches may lie.
SLACK = 4.5
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, of all words if they are fewer."""
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return np.array([digest(join(words), seed)] if words else [], np.uint64)
    rows = zip(*(words[i:] for i in range(shingle)))  # noqa: B905
    return np.fromiter((digest(join(w), seed) for w in rows), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of hashes, signed: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[lo : lo + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: the majority, bit by bit, of its shingles' XXH64.

    A-Z are lower-cased; a text of fewer words has one shingle, one of none has
    fingerprint zero.
    """
    return majority(shingle_hashes(text.lower().split(), shingle, seed))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key and fingerprint (a signed 64-bit number) of each text; null counts as empty."""

    def run(batches):
        enter("simhash")
        for batch in batches:
            out = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], [key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint long")


def gray_rank(code: Column) -> Column:
    """The place of a code word in the reflected Gray order, as a signed number that
    sorts in that order."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(2**63)).cast("long"))


class GrayIndex:
    """A hierarchy over code words, or groups of them, in Gray order.

    Each node stands for ``FAN`` neighbours of the level below. Its pattern is
    the bits that all its words share, less those in its parent's pattern, so
    that a shared bit is compared once for all words below. ``pairs`` walks the
    levels with the differences counted so far and drops a node, with all that
    is below it, when they pass the limit.
    """

    def __init__(self, every: np.ndarray, some: np.ndarray):
        """Per group, the bits set in every one and in some of its words."""
        # Unsigned, as NumPy counts the bits of a negative number's absolute value.
        every, some = every.view(np.uint64), some.view(np.uint64)
        levels = [(every, some)]
        while len(every) > FAN:
            at = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            levels.append((every, some))
        self.levels, above = [], None
        for every, some in reversed(levels):
            shared = ~(every ^ some)
            own = shared if above is None else shared & ~np.repeat(above, FAN)[: len(shared)]
            self.levels.append((every, own))
            above = shared

    def pairs(self, bits: np.ndarray, mask: np.ndarray, limit: int):
        """(query, group) numbers, in parts, whose patterns differ in ``limit`` bits at most.

        ``bits`` under ``mask`` is what all words of a query share."""
        bits, mask = bits.view(np.uint64), mask.view(np.uint64)
        top, last = len(self.levels[0][0]), len(self.levels) - 1
        for lo in range(0, len(bits), STEP // FAN):
            n = min(STEP // FAN, len(bits) - lo)
            # Parts that still go down, deepest last: few are held, whatever the codes.
            parts = [(0, np.repeat(np.arange(lo, lo + n), top), np.tile(np.arange(top), n), np.zeros(n * top, np.uint8))]
            while parts:
                depth, query, node, off = parts.pop()
                if len(query) > STEP:
                    half = len(query) // 2
                    parts += [(depth, query[half:], node[half:], off[half:]), (depth, query[:half], node[:half], off[:half])]
                    continue
                every, own = self.levels[depth]
                off = off + np.bitwise_count((bits[query] ^ every[node]) & own[node] & mask[query])
                near = off <= limit
                query, node, off = query[near], node[near], off[near]
                if depth == last:
                    yield query, node
                elif len(query):
                    query, off = np.repeat(query, FAN), np.repeat(off, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = node < len(self.levels[depth + 1][0])
                    parts.append((depth + 1, query[there], node[there], off[there]))


def join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of a[i] and b[i] for all i, in place; each root is its tree's smallest."""
    while len(a):
        while True:
            a, b = parent[a], parent[b]
            if (parent[a] == a).all() and (parent[b] == b).all():
                break
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def links(codes: DataFrame, limit: int = 2, code: str = "fingerprint") -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``codes`` that
    differ in ``limit`` bits at most.

    Codes are dealt by Gray rank into blocks, each a hierarchy. Groups of
    neighbours travel, packed, to every block whose pattern they could match
    (of two blocks, to one of them), where pairs are found by the hierarchy and
    reduced to a spanning forest; so no task emits more edges than it has codes.
    """
    codes = codes.select(F.col(code).alias("code"))
    n = codes.count()
    blocks = int(min(MOST_BLOCKS, max(1, -(-n // BLOCK))))

    def lay(batches):
        from pyspark import TaskContext

        got = [b.column(0).to_numpy() for b in batches]
        words = np.concatenate(got) if got else np.zeros(0, np.int64)
        if not len(words):
            return
        rank = words.view(np.uint64).copy()
        for step in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(step)
        words = words[np.argsort(rank, kind="stable")]
        at = np.arange(0, len(words), GROUP)
        every, some = np.bitwise_and.reduceat(words, at), np.bitwise_or.reduceat(words, at)
        packed = [words[i : i + GROUP].astype("<i8").tobytes() for i in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)), pa.array(every), pa.array(some), pa.array(packed, pa.binary())], ["block", "every", "some", "codes"])

    groups = table(codes.repartitionByRange(blocks, gray_rank(F.col("code"))).mapInArrow(lay, "block int, every long, some long, codes binary"))
    # At most MOST_BLOCKS rows, whatever the number of codes.
    directory = groups.groupBy("block").agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some")).orderBy("block").toPandas()
    number, upper_every, upper_some = (directory[c].to_numpy() for c in ("block", "every", "some"))

    def route(batches):
        index = GrayIndex(upper_every, upper_some) if len(number) else None
        for batch in batches:
            block, every, some = (batch.column(c).to_numpy() for c in ("block", "every", "some"))
            for query, node in index.pairs(every, ~(every ^ some), limit):
                own, to = block[query], number[node]
                # One direction for each pair of blocks, evenly over blocks.
                once = (own == to) | ((own < to) == ((own + to) % 2 == 0))
                query, to, own = query[once], to[once], own[once]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(own == to), batch.column("codes").take(pa.array(query))], ["to", "own", "codes"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = np.frombuffer(b"".join(pdf.loc[pdf["own"], "codes"]), "<i8")
        guests = np.frombuffer(b"".join(pdf.loc[~pdf["own"], "codes"]), "<i8")
        rank = mine.view(np.uint64).copy()
        for step in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(step)
        mine = mine[np.argsort(rank, kind="stable")]
        every = np.concatenate([mine, guests])
        parent = np.arange(len(every))
        index = GrayIndex(mine, mine)
        for query, node in index.pairs(every, np.full(len(every), -1, np.int64), limit):
            apart = query != node
            join_up(parent, query[apart], node[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        linked = np.flatnonzero(parent != np.arange(len(every)))
        return pd.DataFrame({"a": every[linked], "b": every[parent[linked]]})

    routed = table(groups.mapInArrow(route, "to int, own boolean, codes binary"))
    # A block with many guests is compared in several tasks, each with all of its own codes.
    tasks = routed.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("tasks"))
    dealt = routed.join(tasks, "to").withColumn("task", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("codes"), F.col("tasks")).cast("int")))))
    return dealt.select("to", "task", "own", "codes").groupBy("to", "task").applyInPandas(match, "a long, b long").where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b); a root is its component's smallest.

    Each round hooks every node to its smallest neighbour, shortens the paths
    and keeps only edges between different roots, so the edge list shrinks by a
    factor each time. Nothing but counts reaches the driver. A round's tables
    lie in the shared folder: joins can split the hubs, and a lost executor
    costs one round at most.
    """
    edges = table(edges.select("a", "b").where("a != b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:  # until every root points to itself
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up = table(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            if up.where("moved").isEmpty():
                up = up.select("node", "root")
                break
            up = up.select("node", "root")
        if labels is None:
            labels = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = table(labels.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        pairs = left.join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra != rb")
        edges = table(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in ``limit`` bits at
    most; ``component_id`` is the smallest key in the connected component. Equal
    fingerprints are one node, so copies, however many, cost one row each and no
    pairs. Null texts count as empty; rows that repeat get a row each; a null key
    never names a component unless it has no other. No rows in, no rows out.
    """
    each = table(fingerprints(docs, key, text, shingle))
    nodes = table(each.groupBy("fingerprint").agg(F.min(key).alias("least")))
    labels = components(links(nodes, limit)).withColumnRenamed("node", "fingerprint")
    named = table(nodes.join(labels, "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    names = table(named.groupBy("root").agg(F.min("least").alias("component_id")))
    found = table(named.join(names, "root").select("fingerprint", "component_id"))
    return each.join(found, "fingerprint").select(key, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def row_id(key: str, text: str) -> Column:
    """A row's key and text as one hash: the same for repeated rows only."""
    ident = F.concat_ws(":", F.col(key).isNull().cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.unhex(F.md5(ident.cast("binary")))


def widened(hashes: np.ndarray, words: list[bytes], shingle: int, wide: int) -> np.ndarray:
    """Hashes of runs of ``wide`` words from those of ``shingle`` words, of which a run's
    first and last cover it; of fewer words, one hash of all."""
    if len(words) < wide:
        return shingle_hashes(words, wide, 7)
    more = wide - shingle
    if not 0 <= more <= shingle:
        raise ValueError(f"two runs of {shingle} words cover no run of {wide}")
    out = hashes[: len(words) - wide + 1] * _ODD[0] ^ (hashes[more:] + _ODD[1])
    out = (out ^ out >> np.uint64(31)) * _ODD[1]
    return out ^ out >> np.uint64(29)


def draws(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The SimHash of each of DRAWS times DRAWN of a text's shingles, and a sketch: a byte of
    each drawn shingle.

    The hashes fall into parts, of which each gives its least shingle; an empty part
    takes that of another. So two texts draw the same shingle with the
    probability of their Jaccard similarity, in short texts as in long ones, and the
    share of equal bytes estimates it. A text of no words draws nothing.
    """
    if not len(hashes):
        return np.zeros(0, np.int64), bytes(DRAWS * DRAWN)
    none = np.uint64(2**64 - 1)
    least = np.full(DRAWS * DRAWN, none, np.uint64)
    np.minimum.at(least, (hashes >> np.uint64(32)) % np.uint64(len(least)), hashes * _ODD[0])
    filled = least != none
    if not filled.all():
        empty = np.flatnonzero(~filled)
        hit = filled[PROBES[:, empty]]
        source = PROBES[hit.argmax(axis=0), empty]
        lost = ~hit.any(axis=0)
        full = np.flatnonzero(filled)
        source[lost] = full[np.searchsorted(full, empty[lost]) % len(full)]
        least[empty] = least[source]
    bits = np.unpackbits(least.astype(">u8").view(np.uint8).reshape(DRAWS, DRAWN, 8), axis=2).sum(axis=1, dtype=np.uint8)
    codes = np.packbits(2 * bits > DRAWN, axis=1).view(">u8").ravel().astype(np.uint64)
    return (codes ^ MARKS).view(np.int64), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def may_be(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Whether texts with these sketches (bytes in the last axis) and this smaller number of
    shingles may have a similarity of ``least``, but for ``SLACK`` deviations."""
    equal = (left == right).mean(axis=-1, dtype=np.float32)
    return equal >= least - SLACK * np.sqrt(least * (1 - least) / np.clip(sizes, 1, DRAWS * DRAWN))



def similar(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar sets of hashes, ``left[i]`` and ``right[j]`` (None: ``left``
    itself), enough of them to join all that similar pairs join.

    Two sets are similar at a Jaccard measure of ``least`` or more. Common hashes are
    counted for one set with all others at a time, by lists of the sets that have each hash.
    """
    other = left if right is None else right
    own = np.repeat(np.arange(len(other)), [len(x) for x in other])
    hashes = np.concatenate(other)
    order = np.argsort(hashes, kind="stable")
    hashes, own = hashes[order], own[order]
    sizes = np.array([len(x) for x in other])
    n = len(left)
    # Components so far: of the left sets, then of the right ones unless they are the same.
    label = np.arange(n if right is None else n + len(other))
    shift = 0 if right is None else n
    found = []
    for i, x in enumerate(left):
        if (label == label[0]).all():
            break
        a, b = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
        a, b = a[b > a], b[b > a]
        ends = np.cumsum(b - a)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b - ends, b - a)
        common = np.bincount(own[at], minlength=len(other))
        near = np.flatnonzero(common / (sizes + len(x) - common) >= least)
        near = near[label[near + shift] != label[i]]
        labels, first = np.unique(label[near + shift], return_index=True)
        for other_label, j in zip(labels.tolist(), near[first].tolist(), strict=True):
            found.append((i, j))
            label[label == other_label] = label[i]
    return found


def text_set(text: pa.Scalar, words: int, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's runs of ``words`` words, each once."""
    found = text.as_buffer().to_pybytes().lower().split() if text.is_valid else []
    return np.unique(widened(shingle_hashes(found, shingle, 42), found, shingle, words))


def star_links(pairs: DataFrame, texts: DataFrame, least: float, words: int, shingle: int) -> DataFrame:
    """The (n, hub) of ``pairs`` whose texts are similar: each hub's text goes to the tasks of
    its documents, so that a hub of a third of all documents is many tasks."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / DOCS).cast("int").alias("tasks"))
    many = table(many)
    rays = pairs.join(many, "hub").select("hub", F.pmod(F.xxhash64("n"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("ray"), "n")
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("ray"), F.col("hub").alias("n"))
    meet = rays.unionByName(hubs).join(texts, "n").select("hub", "task", "ray", "n", "text")

    def compare(batches):
        hub, own = None, None
        for batch in batches:
            which, ray, n = (batch.column(c).to_pylist() for c in ("hub", "ray", "n"))
            column, out = batch.column("text").cast(pa.binary()), []
            for i in range(len(batch)):
                found = text_set(column[i], words, shingle)
                if not ray[i]:
                    hub, own = which[i], found
                elif hub == which[i]:
                    common = len(np.intersect1d(own, found, assume_unique=True))
                    total = len(own) + len(found) - common
                    if not total or common / total >= least:
                        out.append((n[i], hub))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return meet.repartition("hub", "task").sortWithinPartitions("hub", "task", "ray").mapInArrow(compare, "a long, b long")


def open_buckets(member: DataFrame) -> DataFrame:
    """(bucket, p, q, part, n, comp): the documents of buckets that hold several components, for each
    task (bucket, p, q) that they meet in.

    ``member`` has bucket, n and comp. A bucket of ``MOST`` documents at most is one task; a larger one is dealt
    into parts, every two of which meet, so every pair of its documents does, in tasks of bounded size. The number
    of tasks grows with the square of a large bucket."""
    sized = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    parts = F.when(F.col("size") <= MOST, 1).otherwise(F.ceil(F.col("size") / (MOST // 2))).cast("int")
    sized = table(sized.where("low != high").select("bucket", parts.alias("parts")))
    dealt = member.join(sized, "bucket").withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("bucket", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "n", "comp")


def similar_texts(rows: DataFrame, texts: DataFrame, least: float = 0.8, words: int = 5, shingle: int = 3) -> DataFrame:
    """Edges (a, b) between the ``n`` of ``rows`` whose components are those of all pairs of
    texts with runs of ``words`` words of a Jaccard similarity of ``least`` or more.

    ``rows`` has n, rid, size (distinct runs of words), drawn and sketch (see ``draws``), ``texts`` rid and
    text. Texts with a drawn code in common are a bucket. First each is compared with the first of its
    buckets, by sketches, then by whole texts where these may be similar; a group of
    near copies is one component after that, at a cost of its size. Of buckets that still hold
    several components, all pairs are compared by their sketches, however large the bucket (see ``open_buckets``);
    only documents with a pair that may be similar, across components, are then compared by their whole texts. So
    texts that share boilerplate and no more meet by sketches of 120 bytes, in tasks of bounded size, and
    unverified pairs never join clusters. A set of documents with too much text for one task is dealt into parts,
    and every two parts meet in a task; tasks emit a spanning forest.
    """
    each = rows.select("n", F.posexplode("drawn").alias("last", "bucket"))
    many = table(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("hub")).where("times > 1").select("bucket", "hub"))
    member = table(each.join(many, "bucket"))
    ids = member.select("n").distinct().join(rows.select("n", "rid"), "n")
    texts = table(texts.join(ids, "rid").select("n", "text"))
    sketches = rows.select("n", "size", "sketch")

    def pass_on(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sketch", "hub_sketch"))
            sizes = np.minimum(batch.column("size").to_numpy(), batch.column("hub_size").to_numpy())
            yield batch.select(["n", "hub"]).filter(pa.array(may_be(left, right, sizes, least)))

    pairs = member.where("n != hub").select("n", "hub").distinct().join(sketches, "n")
    pairs = pairs.join(sketches.select(F.col("n").alias("hub"), F.col("size").alias("hub_size"), F.col("sketch").alias("hub_sketch")), "hub")
    stars = table(star_links(table(pairs.mapInArrow(pass_on, "n long, hub long")), texts, least, words, shingle))
    joint = components(stars).withColumnRenamed("node", "n")
    member = member.drop("hub").join(joint, "n", "left").select("bucket", "n", F.coalesce("root", "n").alias("comp"))
    met = open_buckets(table(member))

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        n, comp, size, part = (pdf[c].to_numpy() for c in ("n", "comp", "size", "part"))
        left, right = (np.flatnonzero(part == pdf[c].iloc[0]) for c in ("p", "q"))
        parent, hit = np.arange(len(n)), np.zeros(len(n), bool)
        others, other_comp, other_size = sketch[right][None], comp[right], size[right]
        for lo in range(0, len(left), 64):
            some = left[lo : lo + 64]
            near = may_be(sketch[some][:, None], others, np.minimum(size[some][:, None], other_size), least)
            a, b = np.nonzero(near & (comp[some][:, None] != other_comp))
            a, b = some[a], right[b]
            hit[a] = hit[b] = True
            join_up(parent, a, b)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        return pd.DataFrame({"bucket": pdf["bucket"].to_numpy()[hit], "root": n[parent[hit]], "n": n[hit]})

    # Tasks of one bucket may find the same root: what they found is one set then.
    found = met.join(sketches, "n").groupBy("bucket", "p", "q").applyInPandas(candidates, "bucket long, root long, n long").distinct()
    found = table(found.join(rows.select("n", "size"), "n"))
    # The same documents meet in several buckets: they are compared in one.
    sets = found.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("hashes"), F.bit_xor(F.xxhash64("n")).alias("who"))
    sets = sets.dropDuplicates(["docs", "hashes", "who"]).select("bucket", "root", F.ceil(F.greatest(F.col("docs") / DOCS, F.col("hashes") / HASHES)).cast("int").alias("parts"))
    dealt = table(found.join(table(sets), ["bucket", "root"]).select("bucket", "root", "n", "parts", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int").alias("part")))
    meet = (
        texts.join(dealt, "n")
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", "root", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "n", "text")
    )

    def compare(batches):
        task, held = None, []

        def settle():
            left = [(n, x) for part, n, x in held if part == task[2]]
            right = [(n, x) for part, n, x in held if part == task[3]] if task[2] != task[3] else None
            if len(held) > 1 and left and (right is None or right):
                got = similar([x for _, x in left], right and [x for _, x in right], least)
                other = right or left
                return pa.RecordBatch.from_arrays([pa.array([left[i][0] for i, _ in got], pa.int64()), pa.array([other[j][0] for _, j in got], pa.int64())], ["a", "b"])
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])

        for batch in batches:
            bucket, root, p, q, part, n = (batch.column(c).to_pylist() for c in range(6))
            column = batch.column(6).cast(pa.binary())
            for k in range(len(batch)):
                if (bucket[k], root[k], p[k], q[k]) != task:
                    if task:
                        yield settle()
                    task, held = (bucket[k], root[k], p[k], q[k]), []
                held.append((part[k], n[k], text_set(column[k], words, shingle)))
        if task:
            yield settle()

    key = ["bucket", "root", "p", "q"]
    return stars.unionByName(meet.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2, shingle: int = 3, least: float = 0.8, words: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: the one with the smallest key
    (nulls last).

    Two documents are linked when the SimHashes of their ``shingle``-word runs differ in
    ``limit`` bits at most, which the Gray-ordered index finds, or when their sets of
    ``words``-word runs have a Jaccard similarity of ``least`` or more. At 0.8, a
    64-bit SimHash moves by some ten bits, beyond any index; so candidates for the
    second kind of link share one of several fingerprints of a few shingles drawn from
    the text, and are compared by their whole texts.

    Rows are told apart by key and text, so that null keys and keys that repeat
    with other texts cost no document; rows that repeat both stay once. Texts of no
    words are linked with each other. An empty table stays empty.
    """
    rid = free_name(docs, "__rid")
    texts = docs.select(row_id(key, text).alias("rid"), F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        enter("simhash")
        for batch in batches:
            column, out = batch.column(2).cast(pa.binary()), []
            for x in column:
                found = x.as_buffer().to_pybytes().lower().split() if x.is_valid else []
                hashes = shingle_hashes(found, shingle, 42)
                wide = widened(hashes, found, shingle, words)
                out.append((majority(hashes), len(np.unique(wide)), *draws(wide)))
            code, size, drawn, sketch = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.int64()), pa.array(size, pa.int64()), pa.array(drawn, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["rid", "key", "fingerprint", "size", "drawn", "sketch"])

    schema = texts.select("rid", "key").schema.add("fingerprint", "long").add("size", "long").add("drawn", ArrayType(LongType())).add("sketch", "binary")
    rows = table(texts.mapInArrow(run, schema).withColumn("n", F.monotonically_increasing_id()))
    repeated = not rows.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if repeated:
        rows, texts = table(rows.dropDuplicates(["rid"])), texts.dropDuplicates(["rid"])
    labels = components(links(rows.select("fingerprint").distinct(), limit)).withColumnRenamed("node", "fingerprint")
    coded = table(rows.join(labels, "fingerprint", "left").select("n", F.coalesce("root", "fingerprint").alias("root")))
    first = coded.groupBy("root").agg(F.min("n").alias("b"), F.count(F.lit(1)).alias("times")).where("times > 1")
    close = coded.join(table(first.select("root", "b")), "root").select(F.col("n").alias("a"), "b")
    joint = components(close.unionByName(similar_texts(rows, texts.select("rid", "text"), least, words, shingle))).withColumnRenamed("node", "n")
    # Only rows of groups are looked at; all others stay.
    groups = table(rows.select("n", "rid", "key").join(joint, "n").select("root", "rid", "key", F.col("key").isNull().alias("nameless")))
    best = groups.groupBy("root").agg(F.min(F.struct("nameless", "key", "rid"))["rid"].alias("best"))
    gone = table(groups.join(best, "root").where("rid != best").select(F.col("rid").alias(rid)))
    kept = docs.withColumn(rid, row_id(key, text)).join(gone, rid, "left_anti")
    return (kept.dropDuplicates([rid]) if repeated else kept).select(docs.columns)
