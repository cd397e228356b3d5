"""Language identification with bit-sliced Bloom filters over byte n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import enter, table

UNKNOWN = "und"
#: Filter rows for each n-gram (one word of languages a row: 8 bytes; at most 8 languages: 1 byte).
ROWS_PER_GRAM = 16
#: A language has an n-gram if it uses it at least this often, at this rate among its
#: n-grams, and by this share of the rate in the language that uses it most. The rate
#: bounds a language's n-grams, whatever the corpus: there are 2^18 at most.
LEAST_COUNT, LEAST_RATE, LEAST_SHARE = 3, 2.0**-18, 0.25
#: Bits of one word of languages; bytes of text that are counted at a time.
WORD, STEP = 63, 1 << 22
#: Bytes of a filter at most: it goes to every worker. Some 60 languages fill 2^27 bytes at
#: the most n-grams that the rate lets them have.
MOST_BYTES = 1 << 29

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def has_letter(text: str) -> bool:
    return bool(re.search("[a-zA-Z]", text)) or any(map(str.isalpha, text))


def fold(text: str) -> bytes:
    """Lower-case UTF-8 with a space for every ASCII character that is no letter."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" "


def grams(folded: bytes) -> np.ndarray:
    """All windows of four bytes within a word, or reaching one byte out of it."""
    parts = [np.frombuffer(folded, "<u4", (len(folded) - i) // 4, i) for i in range(min(4, max(0, len(folded) - 3)))]
    if not parts:
        return np.zeros(0, np.uint32)
    g = np.concatenate(parts)
    return g[((g & 0xFF00) != 0x2000) & ((g & 0xFF0000) != 0x200000)]


def positions(g: np.ndarray, rows: int) -> list[np.ndarray]:
    """Each gram's rows in a filter of a power of two rows."""
    shift = np.uint64(64 - rows.bit_length() + 1)
    wide = g.astype(np.uint64)
    return [(wide * odd) >> shift for odd in _ODD]


@dataclass
class Filters:
    """Row r, word w holds a bit for each language; ``false`` is each language's rate of
    false positives. Languages are sorted, ``usual`` is the most frequent one."""

    languages: list[str]
    bits: np.ndarray
    false: np.ndarray
    usual: int

    def hits(self, g: np.ndarray) -> np.ndarray:
        """For each language, the grams that its filter has: all filters in one look-up."""
        at = positions(g, len(self.bits))
        n = len(self.languages)
        if self.bits.dtype == np.uint8:
            seen = np.bincount(np.bitwise_and(*(self.bits[p, 0] for p in at)), minlength=256)
            return np.array([seen[np.arange(256) >> b & 1 == 1].sum() for b in range(n)])
        masks = np.bitwise_and(*(self.bits[p] for p in at))
        return np.array([int((masks[:, b // WORD] >> np.uint64(b % WORD) & np.uint64(1)).sum()) for b in range(n)])

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the most grams, less the false ones to be expected, and
        their share of all grams. Equal counts: the more usual or first language."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        folded, n = fold(text), 0
        hits = np.zeros(len(self.languages))
        for lo in range(0, len(folded), STEP):
            g = grams(folded[lo : lo + STEP + 3])
            n += len(g)
            hits += self.hits(g)
        true = np.maximum(hits - n * self.false, 0) / (1 - self.false)
        best = int(true.argmax())
        if true[self.usual] == true[best]:
            best = self.usual
        return self.languages[best], float(min(1.0, true[best] / n)) if n else 0.0


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from labelled texts; null texts and labels teach nothing.

    Grams are counted in all rows, whole texts, and combined before and in the
    exchange; a language's filter gets those that pass the three limits, at most
    1 / LEAST_RATE. What reaches the driver is a row for each filled filter row: at
    most two for each n-gram of a filter. A filter above ``MOST_BYTES`` (thousands of
    labels, which are no languages) is an error before anything is sent.
    """

    def count(batches):
        enter("langid")
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            size = 0

            def flush():
                for name, texts in by.items():
                    g, n = np.unique(grams(b"".join(texts)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folded = fold(x.as_py())
                by.setdefault(name, []).append(folded)
                size += len(folded)
                if size >= STEP:
                    yield from flush()
                    by, size = {}, 0
            yield from flush()

    labelled = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = table(labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    per_language = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    many = per_language.count()
    if -(-many // WORD) * 8 * (1 << 10) > MOST_BYTES:
        raise ValueError(f"{many} languages: their smallest filter passes {MOST_BYTES} bytes")
    totals = per_language.toPandas().sort_values("lang")
    languages = totals["lang"].tolist()
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0), 0)
    spark = rows.sparkSession
    number = spark.createDataFrame([(x, i // WORD, i % WORD, int(t)) for i, (x, t) in enumerate(zip(languages, totals["total"], strict=True))], "lang string, word int, bit int, total long")
    rate = F.col("n") / F.col("total")
    masks = table(
        counts.join(number, "lang")
        .withColumn("top", F.max(rate).over(Window.partitionBy("gram")))
        .where((F.col("n") >= LEAST_COUNT) & (rate >= LEAST_RATE) & (rate >= F.col("top") * LEAST_SHARE))
        .groupBy("gram", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    )
    found = masks.select("gram").distinct().count()
    size = max(1 << 10, 1 << (ROWS_PER_GRAM * max(1, found) - 1).bit_length())
    if size * (1 if many <= 8 else -(-many // WORD) * 8) > MOST_BYTES:
        raise ValueError(f"{many} languages with {found} n-grams: their filter passes {MOST_BYTES} bytes")

    def place(batches):
        for batch in batches:
            g, word, mask = (batch.column(c).to_numpy() for c in ("gram", "word", "mask"))
            for p in positions(g, size):
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(word), pa.array(mask)], ["row", "word", "mask"])

    filled = masks.mapInArrow(place, "row long, word int, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros((size, -(-len(languages) // WORD)), np.uint64)
    bits[filled["row"], filled["word"]] = filled["mask"].to_numpy(np.uint64)
    fill = np.array([int((bits[:, b // WORD] >> np.uint64(b % WORD) & np.uint64(1)).sum()) for b in range(len(languages))]) / size
    if len(languages) <= 8:
        bits = bits.astype(np.uint8)
    return Filters(languages, bits, fill ** len(_ODD), int(totals["total"].to_numpy().argmax()))


def identify(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1) of each row; only the text is looked at.

    A text that is null or has no letter is ``und`` with score 0. A text too
    short for a gram, or with none that any language has, gets the most usual
    language with score 0. Rows are independent.
    """
    # Parts, not the object, whose class workers may not have.
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.bits, filters.false, filters.usual))

    def run(batches):
        enter("langid")
        f = Filters(*shared.value)
        for batch in batches:
            found = [f.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def keep_identified(docs: DataFrame, filters: Filters, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score above ``least``: a text of
    which no language has a gram goes.

    Filters that hold no gram, as no row has a label or all labelled texts are too
    few, can tell no languages apart; then every text with a letter stays."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.bits, filters.false, filters.usual))
    blank = not filters.bits.any()

    def keeps(f: Filters, x: str | None) -> bool:
        if blank:
            return x is not None and has_letter(x)
        lang, score = f.predict(x)
        return lang != UNKNOWN and score > least

    # Only the text goes to Python; the other columns wait on Spark's side.
    @F.arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        enter("langid")
        f = Filters(*shared.value)
        return pa.array([keeps(f, x.as_py()) for x in texts], pa.bool_())

    return docs.where(stays(F.col(text)))
