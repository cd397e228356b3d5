"""Fill-in-the-middle documents, cut at unit boundaries found in run-length encoded texts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens the prefix, the suffix and the middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are transformed, and of 100 of these, how many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


@dataclass
class Runs:
    """A text as maximal runs of code points of one class: letters, or anything else.

    ``first`` is the code point at which a run starts, ``units`` the number of units
    before it: a run of letters is one unit, any other code point is a unit by itself.
    Both have the totals at their end."""

    first: np.ndarray
    units: np.ndarray
    letters: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def offset(self, unit: int) -> int:
        """The code point at which a unit starts; for the number of units, where the text ends."""
        run = int(np.searchsorted(self.units, unit, "right")) - 1
        if run == len(self.letters):
            return int(self.first[-1])
        return int(self.first[run]) + (0 if self.letters[run] else unit - int(self.units[run]))


def encode(text: str) -> Runs:
    """The runs of a text: some 17 bytes a run, whatever its length."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return Runs(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, bool))
    lower = points | np.uint32(32)
    letter = (lower >= 97) & (lower <= 122)
    first = np.concatenate([[0], np.flatnonzero(letter[1:] != letter[:-1]) + 1, [len(points)]])
    letters = letter[first[:-1]]
    units = np.concatenate([[0], np.cumsum(np.where(letters, 1, np.diff(first)))])
    return Runs(first, units, letters)


def numbers(key: object, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document: the start of the SHA-256 of seed and key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(text: str, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None: plain), and output of a text."""
    runs = encode(text)
    n = runs.n
    if not n or h[2] % 100 >= TRANSFORMED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (runs.offset(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """Per row: key, n (units), form, prefix_chars, middle_chars and the whole output text.

    Texts are cut at two unit boundaries that depend on the key and ``seed`` alone. A text
    that is null or empty, holds a mark, or is not drawn stays plain (null counts as empty;
    ``prefix_chars`` and ``middle_chars`` are null). Rows are independent: a null key
    counts as an empty one, rows that repeat give equal rows, an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            n, form, prefix, middle, output = zip(*(transform(x.as_py() or "", numbers(k, seed)) for k, x in zip(keys, batch.column(1), strict=True)), strict=True) if keys else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                [key, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = docs.select(key).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return docs.select(key, text).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A mark that follows a part starts with ``<``, so
    no mark can begin in a part and end in the mark behind it: the first of each is the one."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    three = F.lit(3)
    last = F.substr(output, m + three)
    psm = F.concat(F.substr(output, F.lit(4), s - F.lit(4)), last, F.substr(output, s + three, m - s - three))
    spm = F.concat(F.substr(output, p + three, m - p - three), last, F.substr(output, F.lit(4), p - F.lit(4)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
