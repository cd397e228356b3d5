"""Interpolated modified Kneser-Ney language model, counted in Spark and scored from
sorted arrays that workers map into memory."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, table

#: Tokens that a task counts or scores at a time.
COUNT_STEP, SCORE_STEP = 1 << 21, 1 << 19
#: Bytes of input for each bucket of n-grams, and the bounds of their number. The
#: driver and each worker hold a file name for each bucket.
BUCKET_BYTES, FEWEST, MOST = 16 << 20, 64, 65_536
#: Files that a worker holds open, and their bytes where they cannot be mapped.
OPEN, HELD = 256, 256 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: White space never occurs in a word, so its hash names the end of a text.
END = b"\n"


def _tokens(batches, step):
    """For groups of texts of about ``step`` tokens: row numbers within the batch, token
    hashes with an end behind each text, and each text's number of tokens."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    end = np.array([digest(END)], np.uint64)
    for batch in batches:
        column, rows, parts, sizes, n = batch.column(batch.num_columns - 1).cast(pa.binary()), [], [], [], 0
        for i in range(len(batch)):
            x = column[i]
            words = x.as_buffer().to_pybytes().lower().split() if x.is_valid else []
            parts += [np.fromiter(map(digest, words), np.uint64, len(words)), end]
            rows.append(i)
            sizes.append(len(words) + 1)
            n += len(words) + 1
            if n >= step or i == len(batch) - 1:
                yield batch, rows, np.concatenate(parts), np.array(sizes)
                rows, parts, sizes, n = [], [], [], 0


def _put(folder: str, name: str, data: np.ndarray) -> str:
    """A file written under a name of its own and renamed when complete."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{base}/.{name}") as out:
        out.write(memoryview(np.ascontiguousarray(data)).cast("B"))
    store.move(f"{base}/.{name}", f"{base}/{name}")
    return f"{folder}/{name}"


def _map(path: str, kind: str) -> np.ndarray:
    """A file as an array: in memory that the system pages in, or, from a store that has
    no files to map, read as a whole."""
    from pyarrow import fs

    store, local = fs.FileSystem.from_uri(path)
    if store.type_name != "local":
        with store.open_input_file(local) as f:
            return np.frombuffer(f.read(), kind)
    return np.memmap(local, kind, "r") if os.path.getsize(local) else np.zeros(0, kind)


def _merge(keys: pd.Series, counts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and summed counts of packed pieces."""
    k = np.frombuffer(b"".join(keys), "<u8")
    n = np.frombuffer(b"".join(counts), "<u4").astype(np.uint64)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(n, at) if len(at) else n


def _pieces(bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """One packed row for each bucket that has keys."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order].astype("<u8"), counts[order].astype("<u4")
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(at[1:], len(bucket))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at].astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())],
        ["bucket", "keys", "counts"],
    )


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many n-grams occur 1 to 4
    times; a half where those say nothing."""
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1]:
                out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k - 1e-3 if k > 1 else 0.999)
    return out


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that all scores share.

    ``words``: by bucket of a word's hash, the sorted hashes (a word's id is its
    place) and counts. ``pairs``: by bucket of a context, the sorted keys
    (context id, word id) and counts. ``follows``: by range of ids, how many
    contexts a word follows and how many of the words that follow it do so once,
    twice, more often. The id after the last word's is the start of a text.
    """

    bits: int
    words: list[tuple[str, str]] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    follows: list[str] = field(default_factory=list)
    width: int = 1
    tokens: int = 0
    types: int = 0
    texts: int = 0
    bigrams: int = 0
    spare: float = 1.0
    upper: np.ndarray = None
    lower: np.ndarray = None


class Arrays:
    """A worker's view of a model's files, of which it keeps the last used ones, bounded
    in number and in the bytes of those that are not mapped."""

    def __init__(self, model: Model):
        self.model = model
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()
        self.held = 0

    def file(self, path: str, kind: str) -> np.ndarray:
        if path not in self.open:
            got = self.open[path] = _map(path, kind) if path else np.zeros(0, kind)
            self.held += 0 if isinstance(got, np.memmap) else got.nbytes
            while len(self.open) > 1 and (len(self.open) > OPEN or self.held > HELD):
                _, old = self.open.popitem(last=False)
                self.held -= 0 if isinstance(old, np.memmap) else old.nbytes
        self.open.move_to_end(path)
        return self.open[path]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (unknown: -1) and count of each hash."""
        m = self.model
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(distinct >> np.uint64(64 - m.bits), np.arange(len(m.words) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            words, part = self.file(m.words[b][0], "<u8"), slice(cuts[b], cuts[b + 1])
            if len(words):
                at = np.minimum(np.searchsorted(words, distinct[part]), len(words) - 1)
                known = words[at] == distinct[part]
                ids[part] = np.where(known, at + m.first[b], -1)
                counts[part] = np.where(known, self.file(m.words[b][1], "<u8")[at], 0)
        return ids[back], counts[back]

    def bucket(self, context: np.ndarray, count: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where a pair lies: by its context, or, if that is frequent, by itself."""
        m = self.model
        hot = count > max(1, m.tokens >> (m.bits + 2))
        return (np.where(hot, keys * _ODD, context.astype(np.uint64) * _ODD) >> np.uint64(64 - m.bits)).astype(np.int64)

    def pair_counts(self, context: np.ndarray, count: np.ndarray, keys: np.ndarray) -> np.ndarray:
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        bucket = self.bucket(context[at], count[at], distinct)
        order = np.argsort(bucket, kind="stable")
        out = np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(bucket[order], np.arange(1 << self.model.bits, dtype=np.int64))
        cuts = np.append(cuts, len(order))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            if not self.model.pairs[b][0]:
                continue
            keys, times = self.model.pairs[b]
            k, n = self.file(keys, "<u8"), self.file(times, "<u8" if "/times8-" in times else "<u4")
            mine = order[cuts[b] : cuts[b + 1]]
            i = np.minimum(np.searchsorted(k, distinct[mine]), len(k) - 1)
            out[mine] = np.where(k[i] == distinct[mine], n[i], 0)
        return out[back]

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ``follows`` (contexts, once, twice, more), zero for unknown words."""
        distinct, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(distinct), 4), np.int64)
        part = distinct // self.model.width
        for r in np.unique(part[distinct >= 0]).tolist() if self.model.texts else ():
            mine = np.flatnonzero(part == r)
            out[mine] = self.file(self.model.follows[r], "<u4").reshape(-1, 4)[distinct[mine] - r * self.model.width]
        return out[back]

    def score(self, hashes: np.ndarray, sizes: np.ndarray):
        """Per text: known tokens, base score, model score."""
        m = self.model
        first = np.cumsum(sizes) - sizes
        ids, counts = self.ids(hashes)
        context, seen = np.append(m.types, ids[:-1]), np.append(m.texts, counts[:-1])
        context[first], seen[first] = m.types, m.texts
        known = (context >= 0) & (ids >= 0)
        pairs = np.zeros(len(ids), np.int64)
        if known.any():
            keys = context[known].astype(np.uint64) << np.uint64(32) | ids[known].astype(np.uint64)
            pairs[known] = self.pair_counts(context[known], seen[known], keys)
        word, back = self.after(ids)[:, 0], self.after(context)[:, 1:]
        if m.bigrams:
            low = np.maximum(word - m.lower[np.minimum(word, 3)], 0) / m.bigrams + m.spare / (m.types + 1)
        else:
            low = np.full(len(ids), 1 / (m.types + 1))
        total = np.maximum(seen, 1)
        left = np.where(seen > 0, (back @ m.upper[1:]) / total, 1.0)
        p = (pairs - m.upper[np.minimum(pairs, 3)]) / total + left * low
        base = np.log10((counts + 1) / (m.tokens + m.types + 1))
        sums = lambda x: np.add.reduceat(x, first)
        return sums((counts > 0).astype(np.int64)), sums(base), sums(np.log10(p))


def train(docs: DataFrame, text: str = "text") -> Model:
    """The bigram model of whole texts, lower-cased A-Z, cut at white space, each with an
    end; a null text is only an end.

    Words, then pairs, are counted in all texts: sorted and summed within each
    task, packed by bucket, exchanged, merged and written as sorted arrays to the
    shared folder. Words go by hash; pairs go by context, those of a frequent
    context by themselves, so no bucket depends on one word. The driver sees one
    row for each bucket.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark) + "/lm"
    docs = docs.select(F.col(text).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark's word for a plan of unknown size
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(MOST, max(FEWEST, size // BUCKET_BYTES))).bit_length() - 1
    buckets = 1 << bits

    def words(batches):
        for _, _, hashes, _ in _tokens(batches, COUNT_STEP):
            keys, counts = np.unique(hashes, return_counts=True)
            yield _pieces((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)

    def put_words(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n = _merge(pdf["keys"], pdf["counts"])
        b = int(pdf["bucket"].iloc[0])
        return pd.DataFrame({"bucket": [b], "keys": [_put(folder, f"words-{b}", k)], "counts": [_put(folder, f"counts-{b}", n)], "types": [len(k)], "tokens": [int(n.sum())]})

    packed = "bucket int, keys binary, counts binary"
    found = table(docs.mapInArrow(words, packed).groupBy("bucket").applyInPandas(put_words, "bucket int, keys string, counts string, types long, tokens long")).toPandas()
    m = Model(bits=bits, words=[("", "")] * buckets, pairs=[("", "")] * buckets, upper=_discounts(np.zeros(4)), lower=_discounts(np.zeros(4)))
    sizes = np.zeros(buckets, np.int64)
    for r in found.itertuples():
        m.words[r.bucket], sizes[r.bucket] = (r.keys, r.counts), r.types
    m.first, m.types, m.tokens = (np.cumsum(sizes) - sizes).tolist(), int(sizes.sum()), int(found["tokens"].sum())
    m.texts = docs.count()
    m.width = max(1, -(-(m.types + 1) // buckets))
    if m.types >= 1 << 32:
        raise ValueError("ids of words have 32 bits")
    if not m.texts:
        return m

    def pairs(batches):
        arrays = Arrays(m)
        for _, _, hashes, n in _tokens(batches, COUNT_STEP):
            ids, counts = arrays.ids(hashes)
            first = np.cumsum(n) - n
            context, seen = np.append(m.types, ids[:-1]), np.append(m.texts, counts[:-1])
            context[first], seen[first] = m.types, m.texts
            keys, at, times = np.unique(context.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_index=True, return_counts=True)
            yield _pieces(arrays.bucket(context[at], seen[at], keys), keys, times)

    wide = "kind string, bucket int, keys string, counts string, n array<long>, ids binary, sums binary"

    def put_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n = _merge(pdf["keys"], pdf["counts"])
        b = int(pdf["bucket"].iloc[0])
        many = np.minimum(n, 5).astype(np.int64)
        width = 8 if n.max(initial=0) >= 1 << 32 else 4
        out = [{"kind": "pairs", "bucket": b, "keys": _put(folder, f"pairs-{b}", k), "counts": _put(folder, f"times{width}-{b}", n.astype(f"<u{width}")), "n": [*np.bincount(many, minlength=6)[1:5].tolist(), len(k)]}]
        # What this bucket adds to its words' rows of ``follows``, by range of ids.
        word, contexts = np.unique(k & np.uint64(0xFFFFFFFF), return_counts=True)
        context, back = np.unique(k >> np.uint64(32), return_inverse=True)
        after = np.zeros((len(context), 4), "<u4")
        np.add.at(after, (back, np.minimum(many, 3)), 1)
        rows = np.zeros((len(word), 4), "<u4")
        rows[:, 0] = contexts
        ids, sums = np.concatenate([word, context]).astype(np.int64), np.concatenate([rows, after])
        part = ids // m.width
        order = np.argsort(part, kind="stable")
        ids, sums, part = ids[order].astype("<u4"), sums[order], part[order]
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, e in zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
            out.append({"kind": "follows", "bucket": int(part[a]), "ids": ids[a:e].tobytes(), "sums": sums[a:e].tobytes()})
        return pd.DataFrame(out, columns=["kind", "bucket", "keys", "counts", "n", "ids", "sums"]).astype(object).where(lambda x: x.notna(), None)

    made = table(docs.mapInArrow(pairs, packed).groupBy("bucket").applyInPandas(put_pairs, wide))
    times = np.zeros(5, np.int64)
    for r in made.where("kind = 'pairs'").select("bucket", "keys", "counts", "n").toPandas().itertuples():
        m.pairs[r.bucket] = (r.keys, r.counts)
        times += np.array(r.n)
    m.bigrams, m.upper = int(times[4]), _discounts(times[:4])

    def put_follows(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["bucket"].iloc[0])
        out = np.zeros((min(m.width, m.types + 1 - r * m.width), 4), np.int64)
        for ids, sums in zip(pdf["ids"], pdf["sums"], strict=True):
            np.add.at(out, np.frombuffer(ids, "<u4").astype(np.int64) - r * m.width, np.frombuffer(sums, "<u4").reshape(-1, 4))
        contexts = out[:, 0]
        n = np.bincount(np.minimum(contexts, 5), minlength=6)
        return pd.DataFrame({"bucket": [r], "path": [_put(folder, f"follows-{r}", out.astype("<u4"))], "n": [n[1:5].tolist()], "more": [int((contexts >= 3).sum())]})

    ends = table(made.where("kind = 'follows'").select("bucket", "ids", "sums").groupBy("bucket").applyInPandas(put_follows, "bucket int, path string, n array<long>, more long")).toPandas()
    m.follows = [""] * (int(ends["bucket"].max()) + 1)
    times = np.zeros(4, np.int64)
    for r in ends.itertuples():
        m.follows[r.bucket] = r.path
        times += np.array(r.n)
    m.lower = _discounts(times)
    m.spare = float(m.lower[1:] @ np.array([times[0], times[1], ends["more"].sum()])) / m.bigrams
    return m


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text and its end: the base is
    add-one smoothed counts, the model interpolated modified Kneser-Ney. A null
    text counts as empty. Workers map the model's files and touch only the pages
    that their words need; rows are independent.
    """
    # As bytes that hold the class too, which workers may not have.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        arrays = Arrays(cloudpickle.loads(shared.value))
        for batch, rows, hashes, sizes in _tokens(batches, SCORE_STEP):
            known, base, full = arrays.score(hashes, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, (sizes.astype(np.int64), known, np.full(len(rows), arrays.model.tokens, np.int64), base, full, 10 ** (-full / sizes)))],
                [key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(key, text).mapInArrow(run, schema)
