"""Suffix-array dedup: remove what a document repeats of documents with smaller ids.

A byte goes if a string of ``length`` bytes covers it that also starts in a document
with a smaller id. Equal strings are found in three steps, each exact:

1. Every string names one place in itself, its anchor: the k-gram with the least hash.
   Equal strings have equal anchors, so only strings whose anchor occurs in two documents
   can repeat. Neighbouring strings with one anchor form a segment.
2. Segments with a shared anchor meet by anchor. Equal segments are one entry with the
   smallest document that holds it. Where an anchor has several different segments, their
   suffixes are sorted: prefix polynomial hashes and a binary search give the common
   extension of two suffixes, so a comparison takes a logarithmic number of steps, and a
   mergesort orders all suffixes of a task at once. Runs that agree in ``length`` bytes are
   verified byte by byte and share their smallest document.
3. Every block of documents gets, for its segments, the smallest document per string.

Documents are stored once in blocks (bucketed by block, so no later step moves texts). A
block names each anchor and each different segment once, however often it holds it, so a
passage that a third of all rows share costs one entry per block. An anchor with very many
different segments (a frequent line in changing context) is routed by whole strings
instead. Copies of a whole text are settled by their digest and not searched at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermem.llm.common import bucketed, cut_lineage

BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 2 << 20  # of text, whose anchors take about half of that
SMALL_BYTES = 64 << 10  # no use in more parts than that for a small table
CHUNK = 1 << 18
CROWDED = 5000
BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(2024)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS, INVERSES = _powers(BASE, CHUNK + 4096), _powers(INVERSE, CHUNK + 4096)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if width > size else values


def gram_size(length: int) -> int:
    return max(1, length // 2 - 1)


class Block:
    """Segments of a block of documents, and the entries they make."""

    def __init__(self, ids: list[int], texts: list[bytes], copied: list[bool], length: int):
        self.length, self.ids, self.texts, self.copied = length, ids, texts, copied
        self.searched = [i for i, (d, t) in enumerate(zip(ids, texts)) if d is not None and not copied[i] and len(t) >= length]
        sizes = np.array([len(texts[i]) for i in self.searched], np.int64)
        self.ends = np.cumsum(sizes)
        self.buffer = np.frombuffer(b"".join(texts[i] for i in self.searched), np.uint8)
        self.docs = np.array([ids[i] for i in self.searched], np.int64)
        parts = [self._chunk(at) for at in range(0, len(self.buffer), CHUNK)]
        parts = [p for p in parts if p is not None] or [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))]
        self.low, self.count, self.offset, self.gram, self.content = (np.concatenate(c) for c in zip(*parts))
        self.doc = self.docs[np.searchsorted(self.ends, self.low, side="right")] if len(self.low) else np.empty(0, np.int64)

    def _chunk(self, at: int):
        """Segments whose strings start in one chunk: first start, number of starts, anchor's place, anchor, content."""
        length, gram = self.length, gram_size(self.length)
        part = self.buffer[at:at + CHUNK + length - 1]
        size = len(part)
        if size < length:
            return None
        prefix = np.zeros(size + 1, np.uint64)
        np.cumsum(TABLE[part] * POWERS[:size], dtype=np.uint64, out=prefix[1:])
        hashed = _mixed((prefix[gram:] - prefix[:-gram]) * INVERSES[:size - gram + 1])
        places = np.uint64((1 << 20) - 1)
        keys = (hashed & ~places) | np.arange(len(hashed), dtype=np.uint64)
        anchor = (_sliding_least(keys, length - gram + 1) & places).astype(np.int64)
        valid = np.ones(len(anchor), bool)
        first = int(np.searchsorted(self.ends, at, side="right"))
        for end in self.ends[first:].tolist():
            if end - length + 1 - at >= len(anchor):
                break
            valid[max(0, end - length + 1 - at):max(0, end - at)] = False
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])) + 1
        low = np.concatenate([[0], change])
        high = np.concatenate([change, [len(anchor)]])
        low, high = low[valid[low]], high[valid[low]]
        count, offset = high - low, anchor[low] - low
        content = (prefix[high - 1 + length] - prefix[low]) * INVERSES[low]
        content = _mixed(content ^ _mixed((count * 64 + offset).astype(np.uint64) + np.uint64(1)))
        return low + at, count, offset, hashed[anchor[low]], content

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Different anchors in order, and a byte each: how many different segments (at most 127), 128 if in several documents."""
        order = np.lexsort((self.content, self.gram))
        gram, content, doc = self.gram[order], self.content[order], self.doc[order]
        if not len(gram):
            return gram, np.empty(0, np.uint8)
        new = np.append(True, gram[1:] != gram[:-1])
        start = np.flatnonzero(new)
        kinds = np.add.reduceat((new | np.append(True, content[1:] != content[:-1])).astype(np.int64), start)
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        return gram[start], (np.minimum(kinds, 127) + 128 * several).astype(np.uint8)

    def entries(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        """Entries for anchors of code 1 (whole segments) and 2 (single strings), ordered by key; and where they occur.

        ``at`` is a place of the entry's bytes; ``of`` gives the entry of every occurrence
        (first start ``low``, document ``doc``).
        """
        grams, _ = self.anchors()
        code = codes[np.searchsorted(grams, self.gram)] if len(grams) else np.empty(0, np.uint8)
        one, two = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        repeat = np.repeat(two, self.count[two])
        step = np.arange(len(repeat)) - np.repeat(np.cumsum(self.count[two]) - self.count[two], self.count[two])
        starts = self.low[repeat] + step
        key = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), 1 << 13):
            rows = self.buffer[starts[a:a + (1 << 13), None] + np.arange(self.length)]
            key[a:a + (1 << 13)] = _mixed((TABLE[rows] * POWERS[:self.length]).sum(1, dtype=np.uint64) ^ MIX)
        low = np.concatenate([self.low[one], starts])
        gram, content = np.concatenate([self.gram[one], key]), np.concatenate([self.content[one], key])
        count = np.concatenate([self.count[one], np.ones(len(starts), np.int64)])
        offset = np.concatenate([self.offset[one], np.zeros(len(starts), np.int64)])
        doc = np.concatenate([self.doc[one], self.doc[repeat]])
        order = np.lexsort((content, gram))
        low, gram, content, count, offset, doc = (x[order] for x in (low, gram, content, count, offset, doc))
        # equal hashes of content are one entry only if their bytes agree
        same = np.zeros(len(low), bool)
        near = np.flatnonzero((gram[1:] == gram[:-1]) & (content[1:] == content[:-1]) & (count[1:] == count[:-1]) & (offset[1:] == offset[:-1])) + 1
        for a in range(0, len(near), 1 << 13):
            some = near[a:a + (1 << 13)]
            reach = np.arange(2 * self.length)
            inside = reach < (count[some] + self.length - 1)[:, None]
            last = len(self.buffer) - 1
            left = self.buffer[np.minimum(low[some][:, None] + reach, last)]
            right = self.buffer[np.minimum(low[some - 1][:, None] + reach, last)]
            same[some] = ((left == right) | ~inside).all(1)
        start = np.flatnonzero(~same)
        return {"gram": gram[start], "count": count[start], "offset": offset[start], "at": low[start],
                "least": np.minimum.reduceat(doc, start) if len(start) else doc, "of": np.cumsum(~same) - 1, "low": low, "doc": doc}


def _bucket_cuts(grams: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The buckets of ascending keys, each with its part of them."""
    bucket = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    return [(int(bucket[i]), slice(int(i), int(j))) for i, j in zip(start, np.append(start[1:], len(bucket)))]


def _least_of_runs(prefix: np.ndarray, text: np.ndarray, entry: np.ndarray, start: np.ndarray, group: np.ndarray, least: np.ndarray,
                   length: int) -> np.ndarray:
    """For suffixes (entry, start) in comparable groups: the least document of the suffixes that agree in ``length`` bytes.

    Groups come in order. A mergesort by common extensions orders every group at once.
    """
    base, step = POWERS[start], np.int64(1)
    rows, n = entry, len(entry)

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.full(len(i), length)
        ri, si, rj, sj = rows[i], start[i], rows[j], start[j]
        hi, hj, pi, pj = prefix[ri, si], prefix[rj, sj], base[i], base[j]
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = (prefix[ri, si + middle] - hi) * pj == (prefix[rj, sj + middle] - hj) * pi
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> np.ndarray:
        common = extension(i, j)
        at = np.minimum(common, length - 1)
        a, b = text[rows[i], start[i] + at], text[rows[j], start[j] + at]
        return np.where(common == length, equal, a < b)

    order = np.arange(n)
    new = np.append(True, group[1:] != group[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))[np.cumsum(new) - 1]
    while step < size.max(initial=0):
        place = np.arange(n)
        inner = place - first
        left = (inner // step) % 2 == 0
        other = first + (inner // step + np.where(left, 1, -1)) * step          # where the other run begins
        end = np.minimum(other + step, first + size)
        live = np.flatnonzero((size > step) & (other < first + size))
        low, high = other[live].copy(), end[live].copy()
        while (low < high).any():                                              # how many of the other run come first
            go = np.flatnonzero(low < high)
            middle = (low[go] + high[go]) // 2
            # an element of the left run goes before equal ones of the right run
            ahead = before(order[middle], order[live[go]], ~left[live[go]])
            low[go], high[go] = np.where(ahead, middle + 1, low[go]), np.where(ahead, high[go], middle)
        target = place.copy()
        begin = np.where(left, place - inner % step, other)[live]
        target[live] = begin + (inner % step)[live] + (low - other[live])
        moved = np.empty_like(order)
        moved[target] = order
        order, step = moved, step * 2
    joined = np.zeros(n, bool)
    if n > 1:
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(~new[1:] & (extension(a, b) == length))
        for at in range(0, len(near), 1 << 13):                                # equal hashes are believed only if the bytes agree
            some = near[at:at + (1 << 13)]
            reach = np.arange(length)
            joined[some + 1] = (text[rows[a[some]][:, None], start[a[some]][:, None] + reach]
                                == text[rows[b[some]][:, None], start[b[some]][:, None] + reach]).all(1)
    heads = np.flatnonzero(~joined)
    out = np.empty(n, np.int64)
    if n:
        out[order] = np.minimum.reduceat(least[order], heads)[np.cumsum(~joined) - 1]
    return out


def settle(gram: np.ndarray, count: np.ndarray, offset: np.ndarray, least: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries of one bucket (``text``: bytes padded to equal width) the least document of each of their strings.

    Returns per entry the row of a table, and the table (a value per start, the first repeated where all agree).
    """
    n, width = text.shape
    hashed = np.empty(n, np.uint64)
    for a in range(0, n, 1 << 13):
        hashed[a:a + (1 << 13)] = (TABLE[text[a:a + (1 << 13)]] * POWERS[:width]).sum(1, dtype=np.uint64)
    order = np.lexsort((hashed, offset, count, gram))
    a, b = order[:-1], order[1:]
    same = np.append(False, (gram[a] == gram[b]) & (count[a] == count[b]) & (offset[a] == offset[b]) & (hashed[a] == hashed[b]))[:n]
    near = np.flatnonzero(same)
    for at in range(0, len(near), 1 << 13):
        some = near[at:at + (1 << 13)]
        same[some] = (text[order[some]] == text[order[some - 1]]).all(1)
    start = np.flatnonzero(~same)
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(~same) - 1
    pick = order[start]
    small = np.minimum.reduceat(least[order], start)
    table = np.repeat(small[:, None], int(count.max()), axis=1)
    grams, counts, offsets = gram[pick], count[pick], offset[pick]
    new = np.append(True, grams[1:] != grams[:-1])
    group = np.cumsum(new) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    at = 0
    while at < len(many):                                                      # whole groups, about 12,000 entries at a time
        stop = min(len(many), at + 12_000)
        while stop < len(many) and group[many[stop]] == group[many[stop - 1]]:
            stop += 1
        some = many[at:stop]
        at = stop
        rows = text[pick[some]]
        prefix = np.zeros((len(some), width + 1), np.uint64)
        np.cumsum(TABLE[rows] * POWERS[:width], axis=1, dtype=np.uint64, out=prefix[:, 1:])
        entry = np.repeat(np.arange(len(some)), counts[some])
        begin = np.arange(len(entry)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
        cls = group[some][entry] * 256 + (offsets[some][entry] - begin)
        by = np.argsort(cls, kind="stable")
        entry, begin, cls = entry[by], begin[by], cls[by]
        table[some[entry], begin] = _least_of_runs(prefix, rows, entry, begin, cls, small[some][entry], length)
    return kind, table


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All bytes of a binary column as numbers, read where Arrow holds them (one copy, if in several chunks)."""
    chunks = []
    for c in column.chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1]
            chunks.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]])
    whole = chunks[0] if len(chunks) == 1 else np.concatenate(chunks) if chunks else np.empty(0, np.uint8)
    whole = whole if whole.ctypes.data % np.dtype(kind).itemsize == 0 else whole.copy()
    return whole.view(kind)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _read_block(left: pa.Table, right: pa.Table, length: int) -> tuple[Block, dict[int, list]]:
    """The block of the documents in ``left`` and the mail in ``right`` by kind, ordered by bucket."""
    mail: dict[int, list] = {0: [], 1: [], 2: []}
    for row in zip(*(right.column(c).to_pylist() for c in ("kind", "number", "first", "second"))):
        mail[row[0]].append(row[1:])
    for kind in (1, 2):
        mail[kind].sort(key=lambda r: r[0])
    ids, texts = left.column("id").to_pylist(), [t or b"" for t in left.column("text").to_pylist()]
    copies: dict[int, set[bytes]] = {}
    for i, digest, _ in mail[0]:
        copies.setdefault(i, set()).add(digest)
    # rows may share an id, so a copy is told by its text too
    copied = [i in copies and len(t) >= length and hashlib.sha256(t).hexdigest().encode() in copies[i] for i, t in zip(ids, texts)]
    return Block(ids, texts, copied, length), mail


def _whole(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` widened to whole UTF-8 characters."""
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    start = start if len(start) and start[0] == 0 else np.append(0, start)
    return np.repeat(np.logical_or.reduceat(gone, start), np.diff(np.append(start, len(raw))))


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
          whole: bool = False) -> DataFrame:
    """Id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left) and the columns of ``keep`` of every row.

    If ``whole``, ``kept`` is also without the pieces of characters that a cut splits.

    A null or empty text has no bytes. A text shorter than ``length`` keeps all. Rows
    that share an id never remove each other's bytes; a row without an id keeps its text and
    removes nothing. Only the id, the text and ``keep`` are read. An empty table gives no rows.
    """
    if not 4 <= length <= 254:
        raise ValueError("length must lie between 4 and 254 bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
                       *(F.col(k).alias(f"keep{i}_") for i, k in enumerate(keep)))
    kept_columns = [rows.schema[f"keep{i}_"] for i in range(len(keep))]
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(parts, total // SMALL_BYTES), -(-total // BLOCK_BYTES))
    buckets = max(1, min(parts, total // SMALL_BYTES), -(-total // BUCKET_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    stored = bucketed(rows, "block", min(parts, blocks))

    digests = cut_lineage(stored.filter(F.octet_length("text") >= length).select("id", "block", F.sha2("text", 256).alias("digest")))
    least = digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("digest", "least")
    copies = digests.join(least, "digest").filter("id > least").select("block", "id", "digest")
    empty = F.lit(None).cast("binary")
    letters = "block bigint, kind int, number bigint, first binary, second binary"
    mail = cut_lineage(copies.select("block", F.lit(0).alias("kind"), F.col("id").alias("number"),
                                     F.col("digest").cast("binary").alias("first"), empty.alias("second")).distinct())

    def ask_anchors(key, left, right):
        block, _ = _read_block(left, right, length)
        grams, flags = block.anchors()
        cuts = _bucket_cuts(grams, buckets)
        return pa.table({"bucket": pa.array([i for i, _ in cuts], pa.int32()), "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
                         "grams": pa.array([_blob(grams[c]) for _, c in cuts], pa.binary()),
                         "flags": pa.array([_blob(flags[c]) for _, c in cuts], pa.binary())})

    def answer_anchors(key, asked):
        sizes = pc.binary_length(asked.column("flags")).to_pylist()
        grams, flags = _flat(asked.column("grams"), np.uint64), _flat(asked.column("flags"), np.uint8)
        order = np.argsort(grams, kind="stable")
        start = np.flatnonzero(np.append(True, grams[order][1:] != grams[order][:-1]))
        holders = np.diff(np.append(start, len(grams)))
        kinds = np.add.reduceat((flags[order] & 127).astype(np.int64), start)
        shared = (holders > 1) | (np.maximum.reduceat(flags[order], start) >= 128)
        code = np.where(shared, np.where((kinds >= CROWDED) & (kinds >= 4 * holders), 2, 1), 0).astype(np.uint8)
        codes = np.empty(len(grams), np.uint8)
        codes[order] = np.repeat(code, holders)
        ends = np.cumsum(sizes)
        return pa.table({"block": asked.column("block"), "kind": pa.array([1] * len(sizes), pa.int32()),
                         "number": pa.array([key[0].as_py()] * len(sizes), pa.int64()),
                         "first": pa.array([_blob(codes[e - s:e]) for s, e in zip(sizes, ends)], pa.binary()),
                         "second": pa.array([None] * len(sizes), pa.binary())})

    def codes_of(mail_: dict[int, list]) -> np.ndarray:
        return np.frombuffer(b"".join(r[1] for r in mail_[1]), np.uint8)

    def ask_segments(key, left, right):
        block, had = _read_block(left, right, length)
        found = block.entries(codes_of(had))
        cuts = _bucket_cuts(found["gram"], buckets)

        def cell(name: str, kind) -> pa.Array:
            return pa.array([_blob(found[name][c].astype(kind)) for _, c in cuts], pa.binary())

        def text(part: slice) -> bytes:
            size = found["count"][part] + length - 1
            begin = np.cumsum(size) - size
            return _blob(block.buffer[np.repeat(found["at"][part] - begin, size) + np.arange(int(size.sum()))])

        return pa.table({"bucket": pa.array([i for i, _ in cuts], pa.int32()), "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
                         "gram": cell("gram", np.uint64), "count": cell("count", np.uint8), "offset": cell("offset", np.uint8),
                         "least": cell("least", np.int64), "text": pa.array([text(c) for _, c in cuts], pa.binary())})

    def answer_segments(key, asked):
        def whole(name: str, kind) -> np.ndarray:
            return _flat(asked.column(name), kind)
        sizes = pc.binary_length(asked.column("count")).to_pylist()
        count = whole("count", np.uint8).astype(np.int64)
        flat, size = whole("text", np.uint8), count + length - 1
        begin = np.cumsum(size) - size
        width = int(size.max())
        text = np.zeros((len(count), width), np.uint8)
        for a in range(0, len(count), 1 << 13):
            reach = np.arange(width)
            inside = reach < size[a:a + (1 << 13), None]
            text[a:a + (1 << 13)][inside] = flat[(begin[a:a + (1 << 13), None] + reach)[inside]]
        gram, offset, least = whole("gram", np.uint64), whole("offset", np.uint8).astype(np.int64), whole("least", np.int64)
        blocks_asked = asked.column("block").combine_chunks()
        del asked, flat, begin, size  # Arrow's copy of the texts is not needed beside the padded one
        kind, table = settle(gram, count, offset, least, text, length)
        del text, gram, offset, least
        used = np.arange(table.shape[1])
        counts = np.empty(len(table), np.int64)
        counts[kind] = count
        given = np.where(((table == table[:, :1]) | (used >= counts[:, None])).all(1), 1, counts)[kind]
        ends, firsts, seconds = np.cumsum(sizes), [], []
        for s, e in zip(sizes, ends):
            some = slice(e - s, e)
            values = table[kind[some]]
            firsts.append(_blob(given[some].astype(np.uint8)))
            seconds.append(_blob(values[used < given[some][:, None]]))
        pa.default_memory_pool().release_unused()
        return pa.table({"block": blocks_asked, "kind": pa.array([2] * len(sizes), pa.int32()),
                         "number": pa.array([key[0].as_py()] * len(sizes), pa.int64()),
                         "first": pa.array(firsts, pa.binary()), "second": pa.array(seconds, pa.binary())})

    def remove(key, left, right):
        block, had = _read_block(left, right, length)
        found = block.entries(codes_of(had))
        given = np.frombuffer(b"".join(r[1] for r in had[2]), np.uint8).astype(np.int64)
        values = np.frombuffer(b"".join(r[2] for r in had[2]), np.int64)
        first = np.cumsum(given) - given
        edge = np.zeros(len(block.buffer) + 1, np.int32)
        if len(given):
            of, low, doc = found["of"], found["low"], found["doc"]
            plain = (given[of] == 1) & (values[first[of]] < doc)
            np.add.at(edge, low[plain], 1)
            np.add.at(edge, low[plain] + found["count"][of[plain]] + length - 1, -1)
            mixed = np.flatnonzero(given[of] > 1)
            count = given[of[mixed]]
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            gone = values[np.repeat(first[of[mixed]], count) + step] < np.repeat(doc[mixed], count)
            at = (np.repeat(low[mixed], count) + step)[gone]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        covered = np.cumsum(edge[:-1]) > 0
        rises = covered & ~np.append(False, covered[:-1])
        out: dict[int, tuple[int, int, bytes]] = {}
        for i, end in zip(block.searched, block.ends.tolist()):
            begin = end - len(block.texts[i])
            gone = covered[begin:end]
            removed = int(gone.sum())
            spans = int(rises[begin:end].sum()) + int(begin > 0 and gone[0] and covered[begin - 1])
            gone = _whole(block.buffer[begin:end], gone) if whole and removed else gone
            out[i] = (removed, spans, _blob(block.buffer[begin:end][~gone]) if removed else block.texts[i])
        result = []
        for i, t in enumerate(block.texts):
            result.append(out.get(i) or ((len(t), 1, b"") if block.copied[i] else (0, 0, t)))
        return pa.table({"id": pa.array(block.ids, pa.int64()), "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()),
                         "n_removed": pa.array([r[0] for r in result], pa.int64()), "n_spans": pa.array([r[1] for r in result], pa.int64()),
                         "kept": pa.array([r[2] for r in result], pa.binary()), **{f.name: left.column(f.name) for f in kept_columns}})

    def with_mail(letter: DataFrame, step, schema: str) -> DataFrame:
        return stored.groupBy("block").cogroup(letter.groupBy("block")).applyInArrow(step, schema)

    asked = with_mail(mail, ask_anchors, "bucket int, block bigint, grams binary, flags binary")
    mail = mail.unionByName(cut_lineage(asked.groupBy("bucket").applyInArrow(answer_anchors, letters)))
    asked = with_mail(mail, ask_segments, "bucket int, block bigint, gram binary, count binary, offset binary, least binary, text binary")
    mail = mail.unionByName(cut_lineage(asked.groupBy("bucket").applyInArrow(answer_segments, letters)))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept_columns)
    out = with_mail(mail, remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary" + extra)
    return out.withColumnsRenamed({"id": id_col, **{f.name: k for f, k in zip(kept_columns, keep)}})
