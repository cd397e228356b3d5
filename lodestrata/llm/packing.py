"""Best-fit packing of documents into sequences, improved by local search over swaps."""

from __future__ import annotations

import gc
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import enter, table

#: Pieces of one packing task. A block wastes less than one sequence on average,
#: so some thousand sequences a block keep the waste below a thousandth.
BLOCK = 16_384
#: A bin filled by less is packed anew with those of other blocks.
FULL = 0.95
#: Bytes of a worker's cache from a word to its ids, and of an entry besides both.
CACHE, ENTRY = 160 << 20, 160
#: Bytes of a word that stays in a full cache.
SHORT = 9
#: Marks that always make a token of their own behind an ASCII letter or digit.
TAIL = b".,;:!?"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Tokens:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and never joins tokens across it, so a
    text's ids are the ids of its words, one after the other. New words of some
    texts are encoded together, with a mark between them whose id no word has.
    As the tokenizer lower-cases and cuts between letters and marks, A-Z are
    lower-cased first (but not near its special tokens) and a word with marks
    behind it takes the ids of both parts. When the cache is full, only short
    words, the frequent ones, stay in it (or none), which bounds memory.
    """

    MARK = b"\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.cache, self.held = Tokenizer.from_file(path), {}, 0
        (self.mark,) = self._ids(self.MARK.decode())

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: set[bytes]) -> None:
        cache, parts = self.cache, []
        for w in new:
            core = w.rstrip(TAIL)
            if len(core) < len(w) and core[-1:].isalnum():
                parts.append((w, core, w[len(core) :]))
        new = new.difference([w for w, _, _ in parts]).union([c for _, c, _ in parts], [t for _, _, t in parts]).difference(cache)
        plain = [w for w in new if self.MARK not in w]
        if len(plain) < len(new):
            cache.update((w, np.array(self._ids(w.decode("utf-8", "replace")), "<u4").tobytes()) for w in new if self.MARK in w)
        if plain:
            ids = np.array(self._ids((b" " + self.MARK + b" ").join(plain).decode("utf-8", "replace")), "<u4")
            marks = 4 * np.flatnonzero(ids == self.mark)
            raw = ids.tobytes()
            starts, ends = [0, *(marks + 4).tolist()], [*marks.tolist(), len(raw)]
            cache.update((w, raw[a:b]) for w, a, b in zip(plain, starts, ends, strict=True))
        cache.update((w, cache[core] + cache[tail]) for w, core, tail in parts)

    def _weigh(self) -> None:
        self.held = sum(len(w) + len(x) + ENTRY for w, x in self.cache.items())

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The little-endian unsigned 32-bit ids of each text."""
        lo = 0
        while lo < len(texts):
            group, size = [], 0
            while lo < len(texts) and size < 1 << 20:
                group.append((texts[lo] if b"<|" in texts[lo] else texts[lo].lower()).split())
                size += len(texts[lo])
                lo += 1
            if self.held > CACHE:
                self.cache = {w: x for w, x in self.cache.items() if len(w) <= SHORT}
                self._weigh()
                if self.held > CACHE // 2:
                    self.cache, self.held = {}, 0
            if new := set().union(*group).difference(self.cache):
                before = len(self.cache)
                self._learn(new)
                # Ids take about as many bytes as their word.
                self.held += ENTRY * (len(self.cache) - before) + 2 * sum(map(len, new))
            for words in group:
                yield b"".join(map(self.cache.__getitem__, words))


def _tokens(path: str) -> _Tokens:
    state = enter("packing")
    if getattr(state, "tokens_path", None) != path:
        state.tokens, state.tokens_path = _Tokens(path), path
    return state.tokens


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its text (null: none) and then ``end_id``. Only one
    of more than ``capacity`` ids is cut, into pieces of ``capacity``; the last
    may be shorter. Texts are read whole, one at a time.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType

    def run(batches):
        tokens = _tokens(path)
        end = np.array([end_id], "<u4").tobytes()
        # Splitting makes millions of small objects but no cycles; a collection
        # after each few thousand of them would double the time.
        gc.disable()
        for batch in batches:
            gc.collect(0)
            keys, texts = batch.column(0), batch.column(1)
            at, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.binary())]
            for i, ids in enumerate(tokens.encode(texts)):
                ids += end
                for n, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    at.append(i)
                    out["piece"].append(n)
                    out["start"].append(lo // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(part if with_ids else None)
            cols = [keys.take(pa.array(at, pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype("<i8") for x in out["ids"]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        gc.enable()

    schema = f"`{key}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest item first, each into the fullest bin that holds it."""
    free: list[tuple[int, int]] = []  # (room, bin), ascending
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(free, (n, -1))
        if at == len(free):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room, b = free.pop(at)
        bins[b].append(i)
        if room > n:
            insort(free, (room - n, b))
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins: items above ``capacity - k`` share with none of at least
    ``k``, those above the half have a bin each, and the rest of at least ``k`` fill what
    room these leave before they need more; the bound is the largest over all ``k``."""
    number = np.bincount(lengths, minlength=capacity + 1)
    total = number * np.arange(capacity + 1)
    half = capacity // 2
    k = np.arange(half + 1)
    n_to, sum_to = np.append(0, np.cumsum(number)), np.append(0, np.cumsum(total))  # of lengths below i
    alone = n_to[-1] - n_to[capacity - k + 1]
    large, large_sum = n_to[capacity - k + 1] - n_to[half + 1], sum_to[capacity - k + 1] - sum_to[half + 1]
    over = sum_to[half + 1] - sum_to[k] - (large * capacity - large_sum)
    return int((alone + large + np.maximum(0, -(-over // capacity))).max())


class _Offers:
    """What underfull bins can give back: nothing, an item, two items.

    Equal lengths count once (twice in a pair), so that a bin has some thousand
    choices at most. They lie in flat arrays; a bin that changes gets new places
    at the end, and its old ones go when half of all are old."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, fill: np.ndarray, capacity: int):
        self.bins, self.lengths, self.fill, self.capacity = bins, lengths, fill, capacity
        self.items: dict[int, list[tuple[int, ...]]] = {}
        self.start: dict[int, int] = {}
        self._lay([b for b in range(len(bins)) if 0 < fill[b] < capacity])

    def _rows(self, b: int) -> np.ndarray:
        """Size given back, largest size that may come, bin, whether fewer than two items."""
        by: dict[int, list[int]] = {}
        for i in sorted(self.bins[b]):
            by.setdefault(int(self.lengths[i]), []).append(i)
        found = sorted(by.items())
        some = [(0, ()), *((n, (at[0],)) for n, at in found)]
        few = len(some)
        some += [(n + m, (at[0], other[0])) for x, (n, at) in enumerate(found) for m, other in found[x + 1 :]]
        some += [(2 * n, (at[0], at[1])) for n, at in found if len(at) > 1]
        self.items[b] = [i for _, i in some]
        back = np.array([n for n, _ in some], np.int64)
        return np.stack([back, back + self.capacity - self.fill[b], np.full(len(some), b), np.arange(len(some)) < few])

    def _lay(self, open_: list[int]) -> None:
        rows = [self._rows(b) for b in open_]
        self.start = dict(zip(open_, np.cumsum([0, *(r.shape[1] for r in rows)]).tolist(), strict=False))
        self.used = sum(r.shape[1] for r in rows)
        self.flat = np.full((4, 2 * self.used + 64), -1, np.int64)
        if rows:
            self.flat[:, : self.used] = np.concatenate(rows, axis=1)

    def renew(self, b: int) -> None:
        lo = self.start.pop(b)
        self.flat[1, lo : lo + len(self.items.pop(b))] = -1
        if 0 < self.fill[b] < self.capacity:
            rows = self._rows(b)
            if self.used + rows.shape[1] > self.flat.shape[1]:
                self._lay([*self.start, b])
                return
            self.start[b] = self.used
            self.flat[:, self.used : self.used + rows.shape[1]] = rows
            self.used += rows.shape[1]

    def best(self, a: int) -> tuple[tuple[int, ...], int, tuple[int, ...]] | None:
        """The items that ``a`` should give, the receiver, and what it gives back."""
        back, top, owner, few = self.flat[:, : self.used]
        # The squared fill rises if something goes over and the receiver ends fuller than the giver was.
        low = back + np.maximum(1, self.fill[a] + 1 - self.fill[owner])
        at = np.flatnonzero((low <= top) & (owner != a))
        mine = self.items[a]
        sizes = [int(self.lengths[list(i)].sum()) for i in mine]
        for given in (1, 2):
            if given == 2:  # two go for one only
                at = at[(few[at] > 0) & (back[at] > 0)]
            change = np.bincount(low[at], minlength=2 * self.capacity + 2) - np.bincount(top[at] + 1, minlength=2 * self.capacity + 2)
            reached = np.cumsum(change) > 0
            if gives := [(n, i) for n, i in zip(sizes, mine, strict=True) if len(i) == given and reached[n]]:
                n, items = max(gives)
                at = at[(low[at] <= n) & (n <= top[at])]
                d = n - back[at]
                x = int(at[np.argmax(d * (self.fill[owner[at]] - self.fill[a] + d))])
                b = int(owner[x])
                return items, b, self.items[b][x - self.start[b]]
        return None


def swap_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Fewer bins, by exchanges between underfull bins that raise the squared fill.

    The emptiest bin gives its longest item that can move to a fuller bin or be
    exchanged there for a shorter one or two shorter ones, else its longest two that
    can be exchanged for one; of the receivers, the one that gains most takes part. Each
    step raises the sum of squared fills, an integer below bins * capacity^2, so the search
    ends: as soon as the bins are as few as ``least_bins`` allows, or when no underfull
    bin has an exchange left. A bin that runs empty goes; one without an exchange waits
    until all others have had theirs and is tried again if any bin has changed since.
    """
    fill = np.array([int(sum(lengths[i] for i in b)) for b in bins], np.int64)
    least = least_bins(lengths, capacity) if bins else 0
    offers = _Offers(bins, lengths, fill, capacity)
    alive, may_give, changed = len(bins), (fill > 0) & (fill < capacity), False
    while alive > least:
        if not may_give.any():
            if not changed:
                break
            may_give, changed = (fill > 0) & (fill < capacity), False
            continue
        a = int(np.argmin(np.where(may_give, fill, capacity)))
        if (found := offers.best(a)) is None:
            may_give[a] = False
            continue
        given, b, taken = found
        bins[a] = [i for i in bins[a] if i not in given] + list(taken)
        bins[b] = [i for i in bins[b] if i not in taken] + list(given)
        moved = int(sum(lengths[i] for i in given) - sum(lengths[i] for i in taken))
        fill[a] -= moved
        fill[b] += moved
        for c in (a, b):
            offers.renew(c)
            may_give[c] = 0 < fill[c] < capacity
        changed = True
        if not bins[a]:
            alive -= 1
    return [b for b in bins if b]


def pack(parts: DataFrame, capacity: int = 4096, block: int = BLOCK) -> DataFrame:
    """``parts`` (a number ``row``, unique, and a ``length`` of at most ``capacity``) with
    sequence_id and offset.

    Full pieces are sequences of their own. The others are dealt by a hash of
    their row into blocks of about ``block`` pieces; each block is packed by best
    fit and then by swaps. Bins that no block could fill are packed anew,
    together, in half as many blocks or fewer, as long as that is what they need. ``offset`` is
    gapless from 0 within a sequence. Rows that repeat have numbers of their own and are
    packed as often as they occur. The number of blocks follows the number of
    pieces, so a task's memory does not grow with the corpus. ``parts`` is read
    twice and should be a table.
    """
    count = parts.where(F.col("length") < capacity).count()
    # Ids, if they are there, stay behind and meet their places afterwards.
    narrow = [c for c, kind in parts.dtypes if not kind.startswith("array")]
    schema = parts.select(*narrow).schema.add("sequence_id", "long").add("offset", "long").add("fill", "long")

    def packed(rows: DataFrame, blocks: int, turn: int) -> DataFrame:
        def run(got: pa.Table) -> pa.Table:
            number = got["block"][0].as_py()
            got = got.drop_columns("block").sort_by("row")
            lengths = got["length"].to_numpy()
            bins = swap_search(best_fit(lengths, capacity), lengths, capacity)
            sequence, offset, fill = (np.zeros(len(got), np.int64) for _ in range(3))
            for s, b in enumerate(bins):
                sequence[b] = (turn << 56) + (number << 24) + s
                ends = np.cumsum(lengths[b])
                offset[b], fill[b] = ends - lengths[b], ends[-1]
            return got.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

        deal = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
        return rows.select(*narrow, deal).groupBy("block").applyInArrow(run, schema)

    blocks, turn, done = max(1, -(-count // block)), 0, []
    rest = packed(parts.where(F.col("length") < capacity), blocks, turn)
    while blocks > 1:
        rest, underfull = table(rest), F.col("fill") < capacity * FULL
        fewer = -(-rest.where(underfull).count() // block)
        if 2 * fewer > blocks:
            break
        done.append(rest.where(~underfull))
        blocks, turn = max(1, fewer), turn + 1
        rest = packed(rest.where(underfull), blocks, turn)
    out = parts.where(F.col("length") == capacity).select(*narrow, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for some in [*done, rest]:
        out = out.unionByName(some.drop("fill"))
    if len(narrow) < len(parts.columns):
        out = parts.join(table(out.select("row", "sequence_id", "offset")), "row")
    return out.drop("row")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    The pieces (a few numbers each, without the ids unless asked for) are
    written to the shared folder, so each text is tokenized once. An empty table
    gives no rows, a null or empty text one piece that holds only the end id.
    """
    parts = pieces(docs, key, text, capacity, tokenizer, with_ids=with_ids)
    return pack(table(parts.withColumn("row", F.monotonically_increasing_id())), capacity)
