"""Repair of conversation structure with Four-Russians block tables.

A conversation is a string of symbols, one per distinct row: what its role begins with, and
whether it is truncated or must go. The cheapest edits give role initials ``(s?(ua)+)?``; with
four states of that pattern, the cost of all that follows a place is a vector of four numbers.
Normalised (least entry 0) there are few such vectors, so a table holds, for every vector and
every block of ``BLOCK`` symbols, the vector before the block and what it adds to the cost.
A conversation is processed backward, one lookup a block; the edits are then read forward,
expanding one block at a time into the vectors of its rows and taking the least letter among
the cheapest edits, so ties break exactly.

On Spark: rows of a conversation are range-sorted over all tasks and cut into segments of at
most ``SEGMENT`` rows. A segment states for every possible vector after it the vector before
it, and later for every state it may begin in the state it ends in; only these small rows meet
per conversation. So a conversation of any size is encoded, solved and traced in parts. Texts
are shuffled once, to stand beside their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tiermem.llm.common import cut_lineage

BLOCK = 4
SEGMENT = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state an inserted or changed role leads to, and the roles themselves.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Where a kept role leads, by state: initials s, u, a, other.
KEEP = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: Symbols: twice the class of the initial, plus one if truncated; rows that must go share the last.
GONE = 8
SYMBOLS = 9
LEGAL = {"su", "ua", "au"}
BLANK = " \t\n\v\f\r"
STOPS = (".", "!", "?")


class Costs(NamedTuple):
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Tables:
    """All normalised cost vectors, the steps over one symbol and one block, and the edits of one row."""

    def __init__(self, costs: Costs):
        self.costs = costs
        end = [0] * 4
        end[USER], end[SYSTEM] = costs.insert, 2 * costs.insert
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        first, self.end_cost = self._named(end)
        assert first == 0
        self.step: list[list[tuple[int, int]]] = []
        self.trace: list[list[list[tuple[str, int]]]] = []
        while len(self.step) < len(self.vectors):  # every vector that a step reaches gets its own steps
            self.step.append([])
            self.trace.append([])
            here = len(self.step) - 1
            for symbol in range(SYMBOLS):
                before = self._before(self.vectors[here], symbol)
                self.step[here].append(self._named(before))
                self.trace[here].append([self._edits(self.vectors[here], before, symbol, s) for s in range(4)])
        count = len(self.vectors)
        step_to = np.array([[t for t, _ in row] for row in self.step], np.int32)
        step_add = np.array([[c for _, c in row] for row in self.step], np.int64)
        self.block_to = np.arange(count, dtype=np.int32)[:, None]
        self.block_add = np.zeros((count, 1), np.int64)
        for _ in range(BLOCK):  # put one symbol in front of every shorter block
            to = np.stack([step_to[self.block_to, s] for s in range(SYMBOLS)], 1)
            add = np.stack([self.block_add + step_add[self.block_to, s] for s in range(SYMBOLS)], 1)
            self.block_to, self.block_add = to.reshape(count, -1), add.reshape(count, -1)
        self.step_to, self.step_add = step_to, step_add

    def _named(self, vector: list[int]) -> tuple[int, int]:
        least = min(vector)
        key = tuple(x - least for x in vector)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
        return self.known[key], least

    def _options(self, after: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, int]]:
        """Letter, total cost and next state of every edit that uses up the row."""
        found = [("D", self.costs.delete + after[state], state)]
        if symbol != GONE:
            extra = self.costs.truncated * (symbol & 1)
            kept = KEEP[state][symbol >> 1]
            if kept is not None:
                found.append(("K", extra + after[kept], kept))
            found.append(("R", self.costs.rerole + extra + after[NEXT[state]], NEXT[state]))
        return found

    def _before(self, after: tuple[int, ...], symbol: int) -> list[int]:
        used = [min(cost for _, cost, _ in self._options(after, symbol, s)) for s in range(4)]
        least = list(used)
        for s in range(4):
            to, paid = s, 0
            for _ in range(3):
                to, paid = NEXT[to], paid + self.costs.insert
                least[s] = min(least[s], paid + used[to])
        return least

    def _edits(self, after: tuple[int, ...], before: list[int], symbol: int, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest letters up to the row's own, and the state after it."""
        letters = ""
        while True:
            ways = [(letter, to) for letter, cost, to in self._options(after, symbol, state) if cost == before[state]]
            if self.costs.insert + before[NEXT[state]] == before[state]:
                ways.append(("I", None))
            letter, to = min(ways, key=lambda w: w[0])
            letters += letter
            if letter != "I":
                return letters, to
            state = NEXT[state]

    def blocks(self, symbols: bytes) -> tuple[int, list[int]]:
        """How many leading symbols fill no block, and the number of every whole block after them."""
        lead = len(symbols) % BLOCK
        if len(symbols) == lead:
            return lead, []
        rows = np.frombuffer(symbols, np.uint8)[lead:].reshape(-1, BLOCK)
        return lead, (rows @ SYMBOLS ** np.arange(BLOCK)[::-1]).tolist()

    def across(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector after these symbols: the vector before them, and what they add to the cost."""
        lead, numbers = self.blocks(symbols)
        to, add = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for number in reversed(numbers):
            add += self.block_add[to, number]
            to = self.block_to[to, number]
        for symbol in reversed(symbols[:lead]):
            add += self.step_add[to, symbol]
            to = self.step_to[to, symbol]
        return to, add

    def cost(self, symbols: bytes) -> int:
        """The least cost of a whole conversation without edits for further copies of a row."""
        to, add = self.across(symbols)
        return self.vectors[to[0]][START] + self.end_cost + int(add[0])

    def edits(self, symbols: bytes, after: int, states: range | tuple) -> list[tuple[list[str], int]]:
        """For every state to begin in: the letters of each row, and the state after the last."""
        lead, numbers = self.blocks(symbols)
        ends = [after]
        for number in reversed(numbers):
            ends.append(int(self.block_to[ends[-1], number]))
        letters: list[list[str]] = [[] for _ in states]
        state = list(states)
        start, width = 0, lead
        for end in reversed(ends):  # the vector after each run of rows, front to back
            part = symbols[start:start + width]
            vectors = [end]
            for symbol in reversed(part[1:]):
                vectors.append(self.step[vectors[-1]][symbol][0])
            for symbol, vector in zip(part, reversed(vectors)):
                row = self.trace[vector][symbol]
                for at, here in enumerate(state):
                    made, state[at] = row[here]
                    letters[at].append(made)
            start, width = start + width, BLOCK
        return list(zip(letters, state))


@cache
def tables(costs: Costs) -> Tables:
    """One set of tables per Python worker and costs."""
    return Tables(costs)


def damage(turns: DataFrame) -> DataFrame:
    """The rows with faults put in by a hash of conversation and turn; nulls in the hash, role and text are one space.

    Of 20 rows, one each is dropped, emptied, stripped of its full stops, repeated, or given to the user.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("harm"))
    rows = rows.filter(F.col("harm") != 0).select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _content() -> Column:
    """A digest of role and text."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _head() -> Column:
    return F.substring("text", 1, 64)


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text: its ``copies``, and the symbol of the first of them.

    The first row of a content is found by a partial aggregate, so a content that fills a conversation
    costs one row a task; rows with the content anywhere earlier get the symbol of rows that must go.
    """
    last = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    initial = F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring("role", 1, 1)).cast("int")
    kind = F.when(last == "", GONE).otherwise(2 * ((initial + 3) % 4) + F.when(last.isin(*STOPS), 0).otherwise(1))
    light = rows.select("conv_id", "turn", "role", _head().alias("head"), _content().alias("content"), kind.cast("int").alias("symbol"),
                        (last == "").alias("blank"))
    groups = light.groupBy("conv_id", "turn", "content").agg(
        F.first("role").alias("role"), F.first("head").alias("head"), F.first("symbol").alias("symbol"), F.first("blank").alias("blank"),
        F.count(F.lit(1)).alias("copies"))
    firsts = light.filter(~F.col("blank")).groupBy("conv_id", "content").agg(F.min(F.struct("turn")).alias("first"))
    both = groups.withColumn("is_first", F.lit(0)).unionByName(
        firsts.select("conv_id", F.col("first.turn").alias("turn"), "content", F.lit(1).alias("is_first")), allowMissingColumns=True)
    return both.groupBy("conv_id", "turn", "content").agg(
        F.max("role").alias("role"), F.max("head").alias("head"), F.max("blank").alias("blank"), F.max("copies").alias("copies"),
        F.when(F.max("is_first") == 1, F.max("symbol")).otherwise(GONE).alias("symbol"))


ORDER = ("turn", "role", "head", "content")


def _segments(rows: DataFrame, costs: Costs) -> DataFrame:
    """Consecutive rows of a conversation in parts of at most SEGMENT, numbered in the order of all rows."""
    fields = ("turn", "role", "head", "content", "copies", "blank", "symbol")
    kinds = {f: rows.schema[f].dataType.simpleString() for f in ("conv_id", *fields)}
    out = StructType.fromDDL(f"conv_id {kinds['conv_id']}, segment long, symbols binary, before array<int>, "
                             + ", ".join(f"{f} array<{kinds[f]}>" for f in fields))
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = tables(costs)
        number = TaskContext.get().partitionId() << 32
        held: list[list] = []
        done: list[dict] = []

        def close() -> None:
            nonlocal number
            columns = list(zip(*held))
            symbols = bytes(columns[-1])
            done.append({"conv_id": columns[0][0], "segment": number, "symbols": symbols, "before": solver.across(symbols)[0].tolist(),
                         **{f: list(c) for f, c in zip(fields, columns[1:])}})
            number += 1
            held.clear()

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= SEGMENT or held[0][0] != values[0]):
                    close()
                    if len(done) >= 1024 or len(done[-1]["symbols"]) >= 256:
                        yield pa.RecordBatch.from_pylist(done, shape)
                        done.clear()
                held.append(values)
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, shape)

    ordered = rows.select("conv_id", *fields).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    return ordered.mapInArrow(run, out)


def _ends(segments: DataFrame) -> DataFrame:
    """The vector after every segment: a fold over the small rows of each conversation, last segment first."""
    out = StructType.fromDDL("segment long, after int")
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, vector, begun = None, 0, False
        for batch in batches:
            rows = []
            for this, segment, before in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or this != conv:
                    conv, vector, begun = this, 0, True
                rows.append((segment, vector))
                vector = before[vector]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    rows = segments.select("conv_id", "segment", "before")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("segment").desc()).mapInArrow(run, out)


def _traced(segments: DataFrame, ends: DataFrame, costs: Costs) -> DataFrame:
    """Every segment with its letters, for each of the states it may begin in, and the states these end in."""
    source = segments.drop("before").join(ends, "segment")
    rest = [f for f in source.schema.fields if f.name not in ("symbols", "after")]
    out = StructType([*rest, *StructType.fromDDL("letters array<array<string>>, ends array<int>")])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = tables(costs)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                letters, ends_ = [], []
                for symbols, after in zip(part.column("symbols").to_pylist(), part.column("after").to_pylist()):
                    runs = solver.edits(symbols, after, range(4))
                    letters.append([r[0] for r in runs])
                    ends_.append([r[1] for r in runs])
                columns = [part.column(f.name) for f in rest]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(letters, shape.field("letters").type), pa.array(ends_, shape.field("ends").type)], schema=shape)

    return source.mapInArrow(run, out)


def _starts(traced: DataFrame) -> DataFrame:
    """The state every segment begins in: a fold over the small rows of each conversation, first segment first."""
    out = StructType.fromDDL("segment long, state int")
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, START, False
        for batch in batches:
            rows = []
            for this, segment, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or this != conv:
                    conv, state, begun = this, START, True
                rows.append((segment, state))
                state = ends[state]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    rows = traced.select("conv_id", "segment", "ends")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(run, out)


def edited(turns: DataFrame, conversations: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """The cheapest edits of every conversation, as rows in order (columns ``conv_id turn role text`` are read).

    A row has its ``edit`` (K keep, R change role, D delete, I insert), its own ``role``, the
    ``new_role`` it gets, its ``text``, ``fault`` (blank, duplicate, truncated or null), ``cost`` and
    ``times`` (equal rows that go alike). Every conversation, those of ``conversations`` too, begins
    with one row without an edit. Rows stand by turn (nulls first), then by role, then by the text's
    first 64 characters and its digest. All rows of a conversation are in one partition, in order.
    Null role and text: one space. A null ``conv_id`` is a conversation of its own. No rows: no rows.
    """
    every = turns if conversations is None else turns.select("conv_id").unionByName(conversations.select("conv_id"))
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    segments = cut_lineage(_segments(_distinct(turns), costs))
    traced = cut_lineage(_traced(segments, _ends(segments), costs))
    columns = ("turn", "role", "head", "content", "copies", "blank", "symbol")
    chosen = traced.join(_starts(traced), "segment").select("conv_id", *columns, F.col("letters")[F.col("state")].alias("letters"))
    actions = chosen.select("conv_id", F.explode(F.arrays_zip(*columns, "letters")).alias("row")).select("conv_id", "row.*")
    texts = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _head().alias("head"), _content().alias("content"),
                         F.lit(1).alias("flag"), "text")
    heads = every.groupBy("conv_id").agg(F.lit(0).alias("kind"))
    parts = (actions.withColumns({"kind": F.lit(1), "flag": F.lit(0)}).unionByName(texts, allowMissingColumns=True)
             .unionByName(heads, allowMissingColumns=True))
    names = ("conv_id", "kind", *ORDER, "flag", "copies", "blank", "symbol", "letters", "text")
    ordered = parts.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER, "flag")
    out = StructType([turns.schema["conv_id"], *StructType.fromDDL(
        "turn long, edit string, role string, new_role string, text string, fault string, cost long, times long")])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(costs)
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                writer.take(values)
                if len(writer.rows) >= 1024:
                    yield writer.batch(shape)
        writer.finish()
        if writer.rows:
            yield writer.batch(shape)

    return ordered.mapInArrow(run, out)


class _Writer:
    """Rows of edits from sorted letters and texts; holds one row's letters at a time."""

    def __init__(self, costs: Costs):
        self.costs, self.rows, self.state, self.conv, self.waiting = costs, [], START, None, None

    def batch(self, shape: pa.Schema) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), shape)], schema=shape)
        self.rows.clear()
        return made

    def insert(self) -> None:
        self.rows.append((self.conv, None, "I", None, ROLE[self.state], "", None, self.costs.insert, 1))
        self.state = NEXT[self.state]

    def finish(self) -> None:
        """What a conversation still lacks at its end."""
        while self.state in (SYSTEM, USER):
            self.insert()

    def take(self, values: tuple) -> None:
        conv, kind, turn, role, _, _, flag, copies, blank, symbol, letters, text = values
        if kind == 0:
            self.finish()
            self.conv, self.state, self.waiting = conv, START, None
            self.rows.append((conv, None, None, None, None, None, None, 0, 0))
        elif flag == 0:
            self.waiting = (copies, blank, symbol, letters)
        elif self.waiting is not None:  # the first text after its letters; the others are copies of it
            copies, blank, symbol, letters = self.waiting
            self.waiting = None
            for _ in letters[:-1]:
                self.insert()
            if symbol == GONE:
                fault = "blank" if blank else "duplicate"
                self.rows.append((conv, turn, "D", role, None, text, fault, self.costs.delete, copies))
                return
            edit, fault = letters[-1], "truncated" if symbol & 1 else None
            new, cost = role, self.costs.truncated * (symbol & 1)
            if edit == "K":
                self.state = KEEP[self.state][symbol >> 1]
            elif edit == "R":
                new, cost, self.state = ROLE[self.state], cost + self.costs.rerole, NEXT[self.state]
            else:
                new, cost = None, self.costs.delete
            self.rows.append((conv, turn, edit, role, new, text, fault, cost, 1))
            if copies > 1:
                self.rows.append((conv, turn, "D", role, None, text, "duplicate", self.costs.delete, copies - 1))


class _Report:
    """Sums over the rows of one conversation in order."""

    def __init__(self, conv: object):
        self.conv, self.counts, self.illegal, self.cost = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.low = self.high = self.initial = None
        self.distinct, self.letters, self.digest, self.written = 0, [], hashlib.sha256(), False

    def add(self, turn, edit, role, new_role, text, fault, cost, times) -> None:
        self.letters.append(edit * times)
        self.cost += cost * times
        if new_role is not None:
            self.digest.update(("\n" * self.written + f"{new_role}:{text}").encode())
            self.written = True
        if edit == "I":
            return
        if fault:
            self.counts[fault] += times
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.illegal += times - 1
        self.initial = role[:1]
        if turn is not None and turn != self.high:  # rows come by turn
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``edited``: faults, cost, letters of all edits, digest of the repaired text.

    Reads the rows as a stream in the order they have, in memory that does not grow but for the letters.
    """
    out = StructType([rows.schema["conv_id"], *StructType.fromDDL(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Report | None = None
        done: list[tuple] = []
        for batch in batches:
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if rest[1] is None:
                    done += [state.row()] if state else []
                    state = _Report(conv)
                else:
                    state.add(*rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), shape)], schema=shape)
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(state.row(), shape)], schema=shape)

    return rows.select("conv_id", "turn", "edit", "role", "new_role", "text", "fault", "cost", "times").mapInArrow(run, out)
