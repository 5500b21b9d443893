"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton over the
vocabulary gives the longest token at every place of a piece in one pass. The encoder
takes the longest token that may follow the one before it; where none may, it steps
back and marks the place as a dead end, so every place is left at most once per token
length: linear time. Whether two tokens may stand side by side (the merges of both
together give just these two) is memoised. The result equals merging by rank.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermem.llm.common import text_rows

LONGEST_CACHED = 64
CACHED_PIECES = 450_000
CACHED_PAIRS = 300_000
LONG_TEXT = 1 << 20


#: Characters from U+0300 on, and separators that ``re`` alone counts as white space.
FAR = re.compile("[^\x00-\x1b\x20-\u02ff]")


def _near_pattern(pattern: str) -> str:
    """The same pattern for the standard ``re``, its letter and number classes spelled out below U+0300."""
    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)

    return pattern.replace(r"\p{L}]", members("L") + "]").replace(r"\p{N}]", members("N") + "]").replace(
        r"[^\s\p{L}", r"[^\s" + members("L")).replace(r"\p{L}", f"[{members('L')}]").replace(r"\p{N}", f"[{members('N')}]")


class ByteEncoder:
    """Encoder over a rank file (a base64 token and its rank per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {rank: raw for raw, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.near_split = re.compile(_near_pattern(pattern))
        self.size = {rank: len(raw) for raw, rank in self.ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        self.automaton = ahocorasick.Automaton()
        self.prefix: dict[int, int] = {}
        whole = {}
        for raw, rank in self.ranks.items():
            if self._merged(raw) == [rank]:  # a token that merges cannot build only stands for a whole piece
                whole[raw] = rank
                self.automaton.add_word(raw.decode("latin-1"), rank)
        self.automaton.make_automaton()
        for raw, rank in whole.items():
            self.prefix[rank] = next((whole[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in whole), -1)

    def _merged(self, raw: bytes) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals; used on one or two tokens at a time."""
        ranks, none = self.ranks, 1 << 60
        parts = [raw[i:i + 1] for i in range(len(raw))]
        joins = [ranks.get(raw[i:i + 2], none) for i in range(len(raw) - 1)]
        while joins:
            best = min(joins)
            if best == none:
                break
            at = joins.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(joins):
                joins[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self._merged(self.token[left] + self.token[right]) == [left, right]
            self.pairs[left << 32 | right] = known
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        rank = self.ranks.get(raw)
        if rank is not None:
            return [rank]
        size_of, prefix, pairs, size = self.size, self.prefix, self.pairs, len(raw)
        longest: list[int] = [-1] * (size + 1)
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            # matches come by end, so a later one at the same start is longer
            longest[end + 1 - size_of[rank]] = rank
        dead: set[int] = set()
        out: list[int] = []
        at, candidate, last = 0, longest[0], -1
        while at < size:
            while candidate >= 0:
                end = at + size_of[candidate]
                if end not in dead:
                    fits = last < 0 or pairs.get(last << 32 | candidate)
                    if fits or fits is None and self.may_follow(last, candidate):
                        break
                candidate = prefix[candidate]
            if candidate >= 0:
                out.append(candidate)
                last, at, candidate = candidate, end, longest[end]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes of the text")
                dead.add(at)
                candidate = prefix[out[-1]]
                at -= size_of[out.pop()]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        split = self.split if FAR.search(text) else self.near_split
        found = split.findall(text) if len(text) < LONG_TEXT else (m.group() for m in split.finditer(text))
        return b"".join(map(self.pieces.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        step = 4 * LONG_TEXT
        return b"".join(
            b"".join(map(self.token.__getitem__, np.frombuffer(ids[i:i + step], dtype="<u4").tolist()))
            for i in range(0, len(ids), step)
        )


class _Pieces(dict):
    """Packed ids by piece; bounded, as only short pieces stay and a full cache is emptied."""

    def __init__(self, encoder: ByteEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.encode_piece(piece.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


_ENCODERS: dict[tuple[str, str], ByteEncoder] = {}


def encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder per Python worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` bytes of every row.

    A null or empty text has no ids; repeated rows each give a row; other columns are
    not read, so their names cannot clash. Rows never meet, so there is no shuffle.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for ids, texts in text_rows(batches):
            packed = [bpe.encode(t or "") for t in texts]
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array(ids, _arrow(key)), "ids": pa.array(packed, pa.binary()),
                "decoded": pa.array([bpe.decode(p) for p in packed], pa.binary()),
            })

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {key}, ids binary, decoded binary")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
