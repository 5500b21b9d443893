"""Best-fit packing of documents into token sequences after Martello-Toth dominance reduction.

Only the lengths of the pieces decide, and there are at most ``capacity`` lengths, so
the driver plans over a histogram of bounded size: counts, never rows. First sets of
one or two pieces that provably dominate every alternative are fixed (a piece nothing
fits beside, a pair that fills a sequence, a pair that no other choice can beat); the
shrunk rest is placed by best fit, longest first, many equal pieces in one action. The
plan says for ranges of ranks within a length where the pieces go; each piece finds
its place by its rank, which is counted in salted blocks, so no length is one task.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tiermem.llm.common import cut_lineage, text_rows

LONGEST_CACHED = 64
CACHED_WORDS = 400_000
BLOCK_ROWS = 200_000
#: Characters from U+0300 on, and separators that ``re`` alone counts as white space.
FAR = re.compile("[^\x00-\x1b\x20-˿]")


class WordEncoder(dict):
    """Packed ids by word of a lower-casing BPE tokenizer; words are encoded once and kept in a bounded cache."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.tokenize = self.tokenizer.model.tokenize
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        self.shown = {b: 256 + i for i, b in enumerate(rest)}  # bytes as visible characters, as byte-level vocabularies write them
        def members(kind: str) -> str:
            return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)
        letters, numbers = members("L"), members("N")
        heads = "'s|'t|'re|'ve|'m|'ll|'d|"
        self.split = regex.compile(heads + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.near_split = re.compile(heads + rf"[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for _, t in added.values()):
            raise ValueError("added tokens must be plain strings of the text as it is")
        self.added = {content: struct.pack("<I", i) for content, (i, _) in added.items()}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __missing__(self, word: str) -> bytes:
        shown = word.encode("utf-8").decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.tokenize(shown)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of added tokens get their ids, as in the library."""
        if not any(content in text for content in self.added):
            return self._encode_plain(text)
        return b"".join(self.added.get(part) or self._encode_plain(part) for part in self.added_split.split(text))

    def _encode_plain(self, text: str) -> bytes:
        split, lowered = self.near_split, text.lower()
        if FAR.search(text) or FAR.search(lowered):
            split, lowered = self.split, self.normalize(text)
        found = split.findall(lowered) if len(lowered) < 1 << 20 else (m.group() for m in split.finditer(lowered))
        return b"".join(map(self.__getitem__, found))


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``piece``, ``start``, ``length`` and ``ids`` (packed) of every document, ended by ``end_id``.

    Only documents longer than ``capacity`` are cut. A null or empty text is one piece
    that holds ``end_id`` alone; repeated rows each give their pieces; other columns are
    not read.
    """
    key = docs.schema[id_col].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key]
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for ids, texts in text_rows(batches):
            rows = []
            for i, text in zip(ids, texts):
                raw = encoder.encode(text or "") + end
                rows += [(i, n, at // 4, raw[at:at + 4 * capacity]) for n, at in enumerate(range(0, len(raw), 4 * capacity))]
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array([r[0] for r in rows], kind), "piece": pa.array([r[1] for r in rows], pa.int32()),
                "start": pa.array([r[2] for r in rows], pa.int64()), "length": pa.array([len(r[3]) // 4 for r in rows], pa.int64()),
                "ids": pa.array([r[3] for r in rows], pa.binary()),
            })

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {key}, piece int, start bigint, length bigint, ids binary")


@dataclass
class Plan:
    """Actions (length, first rank, pieces per sequence, first sequence, offset, pieces) and the number of sequences."""

    capacity: int
    actions: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Where the pieces of every length go; the work is bounded by the number of lengths, whatever the counts."""
    plan, left, done = Plan(capacity), dict(counts), dict.fromkeys(counts, 0)

    def put(size: int, pieces: int, per: int, base: int, offset: int) -> None:
        plan.actions.append((size, done[size], per, base, offset, pieces))
        done[size] += pieces
        left[size] -= pieces

    def fix(sizes: tuple[int, ...], times: int) -> None:
        offset = 0
        for size in sizes:
            if len(sizes) == 2 and sizes[0] == sizes[1]:
                put(size, 2 * times, 2, plan.sequences, 0)
                break
            put(size, times, 1, plan.sequences, offset)
            offset += size
        plan.sequences += times
        plan.fixed += times

    def smallest(skip: int, wanted: int) -> list[int]:
        """The ``wanted`` smallest pieces, without one piece of length ``skip``."""
        out: list[int] = []
        for size in order:
            out += [size] * min(wanted - len(out), left[size] - (size == skip))
            if len(out) >= wanted:
                break
        return out

    order = sorted(s for s, n in counts.items() if n > 0)
    for size in sorted(order, reverse=True):
        while left[size] > 0:
            room = capacity - size
            few = smallest(size, 3)
            if not few or few[0] > room:
                fix((size,), left[size] if not few or few[0] != size else 1)
                continue
            partner = next(s for s in reversed(order) if s <= room and left[s] - (s == size) > 0)
            two = sum(few[:2]) if len(few) > 1 else capacity + 1
            three = sum(few) if len(few) > 2 else capacity + 1
            dominates = partner == room or two > room
            if not dominates and three > room:
                dominates = partner >= _best_pair([s for s in order if left[s] - (s == size) > 0], {s: left[s] - (s == size) for s in order}, room)
            if not dominates:
                break
            times = left[size] // 2 if partner == size else min(left[size], left[partner])
            if partner != room:
                # what is small may change as pieces go, so a pair that rests on the smallest pieces is fixed while those stay
                held = min(few[0], few[1] if len(few) > 1 else few[0])
                times = times if partner > held else 1
            fix((size, partner), max(1, times))
    _best_fit(plan, left, put)
    return plan


def _best_pair(sizes: list[int], left: dict[int, int], room: int) -> int:
    """The largest sum of two pieces that is at most ``room``; 0 if none."""
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total <= room and (low < high or left[sizes[low]] > 1):
            best = max(best, total)
            low += 1
        elif total > room:
            high -= 1
        else:
            low += 1
    return best


def _best_fit(plan: Plan, left: dict[int, int], put) -> None:
    """Place the rest, longest first, each where it leaves least room; equal pieces and equal sequences go together."""
    capacity = plan.capacity
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: runs of sequences
    for size in sorted((s for s, n in left.items() if n > 0), reverse=True):
        room = size
        while left[size] > 0:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                each = capacity // size
                number = -(-left[size] // each)
                rooms[capacity].append((plan.sequences, number))
                plan.sequences += number
                room = capacity
            base, number = rooms[room].pop()
            each = min(room // size, left[size])
            used = min(number, left[size] // each)
            put(size, each * used, each, base, capacity - room)
            if used < number:
                rooms[room].append((base + used, number - used))
            rooms[room - each * size].append((base, used))
            room = size


def place(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` is read several times, so it should be a stored table. Lengths must lie
    between 1 and ``capacity``. Ties between pieces of one length are broken by the key;
    equal rows take places side by side. An empty table gives none. Columns that are
    already named like the results are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    plan = plan_packing(counts, capacity)
    salts = max(8, -(-sum(counts.values()) // BLOCK_ROWS))
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64(*key_cols), F.lit(salts)).cast("int"))
    blocks = salted.groupBy(F.col(length_col).alias("length_"), F.col("salt_").alias("block_")).count()
    before = Window.partitionBy("length_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length_", "block_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy(length_col, "salt_").orderBy(*key_cols)
    ranked = salted.withColumn("row_", F.row_number().over(inside) - 1).join(
        blocks, (F.col(length_col) == F.col("length_")) & (F.col("salt_") == F.col("block_")))
    ranked = ranked.select(*pieces.columns, (F.col("row_") + F.col("before_")).alias("rank_"))

    table = np.array(sorted(plan.actions) or [(0, 0, 1, 0, 0, 1)], dtype=np.int64)
    stride = int(max(counts.values(), default=0)) + 1
    starts = table[:, 0] * stride + table[:, 1]
    shared = spark.sparkContext.broadcast((table, starts))  # bounded by the number of lengths times the rooms they went to
    schema, names = ranked.drop("rank_").schema, [c for c in ranked.columns if c != "rank_"]
    at_length, at_rank = ranked.columns.index(length_col), ranked.columns.index("rank_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actions, first = shared.value
        for batch in batches:
            length = np.asarray(batch.column(at_length)).astype(np.int64)
            rank = np.asarray(batch.column(at_rank)).astype(np.int64)
            row = actions[np.searchsorted(first, length * stride + rank, side="right") - 1]
            inner = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at_rank), pa.array(row[:, 3] + inner // row[:, 2]),
                 pa.array(row[:, 4] + inner % row[:, 2] * length)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with the checksum of their ids and their place; the tokens are read once and stored as checksums."""
    pieces = pieces_of(docs, path, capacity, id_col=id_col, text_col=text_col)
    stored = cut_lineage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return place(stored, capacity, key_cols=(id_col, "piece"))
