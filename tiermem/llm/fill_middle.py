"""Fill-in-middle transformation of whole texts, cut at unit boundaries.

Every character of a text has one of six classes (3 bits), and a wavelet matrix over the
classes answers how many characters of a class come before a place. A kind of unit (line,
sentence, word, character) ends after the characters of some classes, so a sum of ranks is
the number of its boundaries, the last rank gives the number of units, and bisection on the
ranks finds the place of any boundary. The two cuts are drawn from a hash of the row's id,
so a row gets the same cuts wherever and however often it is computed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tiermem.llm.common import text_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INSIDE, SPACE, STOP_SPACE, WORD_START, NEWLINE, STOP_NEWLINE = range(6)
BITS = 3
SLICE = 1 << 20

#: The classes after (for words: before) whose characters a unit of the kind ends, as (leading bits, number of bits).
KINDS = {
    "line": [(0b10, 2)],
    "sentence": [(0b010, 3), (0b101, 3)],
    "word": [(0b011, 3)],
    "character": [(0, 0)],
}


def classes(text: str) -> np.ndarray:
    """The class of every code point, computed in slices."""
    out = np.empty(len(text), np.uint8)
    spaced, stopped = True, False  # whether the character before is white space, and a full stop
    for start in range(0, len(text), SLICE):
        points = np.frombuffer(text[start:start + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        space = (points == 32) | ((points >= 9) & (points <= 13))
        stop = (points == 46) | (points == 33) | (points == 63)
        after_space, after_stop = np.roll(space, 1), np.roll(stop, 1)
        after_space[0], after_stop[0] = spaced, stopped
        line = points == 10
        out[start:start + len(points)] = np.where(
            space, np.where(line, NEWLINE, SPACE) + (after_stop & space), np.where(after_space, WORD_START, INSIDE))
        spaced, stopped = bool(space[-1]), bool(stop[-1])
    return out


class WaveletMatrix:
    """Bit planes of a sequence of small numbers, highest bit first, each with ranks by 64-bit words."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.size, self.bits = len(values), bits
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            plane = (values >> level) & 1
            packed = np.packbits(plane, bitorder="little")
            words = np.zeros(self.size // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(self.size - int(plane.sum()))
            if level:
                values = np.concatenate([values[plane == 0], values[plane == 1]])

    def _ones(self, level: int, at: int) -> int:
        return int(self.before[level][at >> 6]) + (int(self.words[level][at >> 6]) & ((1 << (at & 63)) - 1)).bit_count()

    def rank(self, leading: int, bits: int, at: int) -> int:
        """How many of the first ``at`` values begin with these leading bits."""
        low, high = 0, at
        for level in range(bits):
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            if leading >> (bits - 1 - level) & 1:
                low, high = self.zeros[level] + low_ones, self.zeros[level] + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low


class Units:
    """Number and places of the units of one kind in a text; the units joined give the text."""

    def __init__(self, text: str, kind: str = "line"):
        self.size, self.kind, self.sets = len(text), kind, KINDS[kind]
        codes = classes(text)
        self.matrix = WaveletMatrix(codes)
        self.ends = self._ended(self.size)
        if kind == "word":  # what stands before the first word belongs to it
            self.count = max(self.ends, 1 if text else 0)
        else:
            tail = bool(text) and self._ended(self.size) == self._ended(self.size - 1)
            self.count = self.ends + tail

    def _ended(self, at: int) -> int:
        return sum(self.matrix.rank(leading, bits, at) for leading, bits in self.sets)

    def place(self, k: int) -> int:
        """The place after the first ``k`` units, by bisection on the ranks."""
        if k <= 0:
            return 0
        if k >= self.count:
            return self.size
        wanted = k + 1 if self.kind == "word" else k
        low, high = 0, self.size
        while low < high:
            half = (low + high) // 2
            if self._ended(half) >= wanted:
                high = half
            else:
                low = half + 1
        return low - 1 if self.kind == "word" else low


MARKS = re.compile("<[PSM]>")


def transform(text: str, key: object, seed: int = 7, kind: str = "line", rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle, and the text written in that form."""
    units = Units(text, kind)
    drawn = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rate or MARKS.search(text):
        return units.count, "plain", None, None, text
    first, second = sorted((h1 % (units.count + 1), h2 % (units.count + 1)))
    a = units.place(first)
    b = a if second == first else units.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return units.count, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.count, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, kind: str = "line", rate: int = 100, spm: int = 50,
) -> DataFrame:
    """Id, ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``rate`` of 100 rows are cut, ``spm`` of 100 of these put the suffix first. Texts that are
    null, empty or contain a mark stay plain (null: an empty output), and so their lengths are
    null. A null id draws like an empty one; repeated rows each give the same row; other columns
    are not read, so their names cannot clash. Rows never meet, so there is no shuffle.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    key_type = docs.schema[id_col].dataType
    arrow = to_arrow_type(key_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches):
            rows = list(zip(*(transform(t or "", k, seed, kind, rate, spm) for k, t in zip(keys, texts))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, arrow), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                 pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.string())],
                names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"key {key_type.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", id_col)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from what was written and its form: only marks that the form put in stand in it."""
    parts = F.split(output, MARKS.pattern, -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
             .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
