"""SentencePiece encoding and decoding by backtracking over longest matches.

A merge-type model merges the neighbours whose union has the best score, leftmost among
equals. Two pieces may stand side by side if merging their joined text gives just these
two, and a sequence is the model's own exactly if all its neighbours may. So the encoder
takes the longest piece that starts at a place (Aho-Corasick over all pieces that merging
can build), checks it against the piece before by merging both again, tries shorter ones
where it may not follow, and steps back where none may; a bitfield keeps the places that
failed, so none is tried twice. A character that no piece covers becomes its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tiermem.functions.worker import kept
from tiermem.llm.common import text_rows

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
LONGEST_CACHED = 64
CACHED_PARTS = 700_000
CACHED_PAIRS = 300_000


class PieceEncoder:
    """Encoder over a merge-type model file with byte pieces and no text normalisation of its own."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ A  ") != f"{SPACE}ﬁ{SPACE}A{SPACE * 2}":
            raise ValueError("a model that normalises its texts is not supported")
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for at in range(model.vocab_size()):
            if model.is_byte(at):
                self.bytes[int(model.id_to_piece(at)[1:-1], 16)] = at
            elif not (model.is_control(at) or model.is_unknown(at) or model.is_unused(at)):
                self.ids[model.id_to_piece(at)] = at
        if len(self.bytes) != 256:
            raise ValueError("the model lacks byte pieces")
        self.score = {piece: model.get_score(at) for piece, at in self.ids.items()}
        self.end = model.eos_id()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts = _Parts(self)
        self.automaton = ahocorasick.Automaton()
        built = {piece for piece in self.ids if self.merged(piece) == [piece]}
        for piece in built:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in built), None) for p in built}
        # No piece spans a place between two characters that no piece holds side by side, so texts may be cut there.
        self.joined = {pair for piece in built for pair in zip(piece, piece[1:])}
        self.cut = re.compile(self._pattern())

    def _pattern(self) -> str:
        """Parts of a text: words up to a mark or to punctuation that no piece has after a letter, and what stands between."""
        if any(b == SPACE != a for a, b in self.joined):
            return r"(?s).+"
        plain = [c for c in map(chr, range(128)) if not c.isalnum()]
        after_letters = {b for a, b in self.joined if LETTER.fullmatch(a)}
        ends = re.escape("".join(c for c in plain if c not in after_letters))
        alone = re.escape("".join(c for c in plain if not any(c in pair for pair in self.joined)))
        return f"{SPACE}*{LETTER.pattern}+(?=[{ends}{SPACE}]|\\Z)|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]"

    def merged(self, text: str) -> list[str]:
        """Merge by score, best first and leftmost among equals; used on one or two pieces at a time."""
        parts, score, none = list(text), self.score, float("-inf")
        joins = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while joins:
            best = max(joins)
            if best == none:
                break
            at = joins.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = score.get(parts[at - 1] + parts[at], none)
            if at < len(joins):
                joins[at] = score.get(parts[at] + parts[at + 1], none)
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces (or uncovered characters) of a text whose spaces are marks."""
        shorter, pairs, size = self.shorter, self.pairs, len(text)
        longest: list[str | None] = [None] * size
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - len(piece)] = piece  # matches come by end, so a later one at the same start is longer
        failed = bytearray((size >> 3) + 1)
        out: list[str] = []
        at, candidate, last = 0, longest[0] or text[0], None
        while at < size:
            while candidate is not None:
                end = at + len(candidate)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = last is None or pairs.get((last, candidate))
                    if fits or fits is None and self.may_follow(last, candidate):
                        break
                candidate = shorter.get(candidate)
            if candidate is not None:
                out.append(candidate)
                at, last = end, candidate
                if at < size:
                    candidate = longest[at] or text[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                dropped = out.pop()
                at -= len(dropped)
                candidate, last = shorter.get(dropped), out[-1] if out else None
        return out

    def ids_of(self, part: str) -> list[int]:
        found: list[int] = []
        for piece in self.pieces(part):
            known = self.ids.get(piece)
            if known is None:
                found.extend(self.bytes[b] for b in piece.encode("utf-8"))
            else:
                found.append(known)
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text and the end id; an empty text has the end id alone."""
        parts = self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []
        ids = list(chain.from_iterable(map(self.parts.__getitem__, parts)))
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


class _Parts(dict):
    """Ids by part, in tuples (which the garbage collector leaves alone); bounded, as only short parts stay and a full cache is emptied."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> tuple[int, ...]:
        joined = self.encoder.joined
        cuts = [at for at, pair in enumerate(zip(part, part[1:]), 1) if pair not in joined]
        if cuts:
            ids = tuple(x for a, b in zip([0, *cuts], [*cuts, len(part)]) for x in self[part[a:b]])
        else:
            ids = tuple(self.encoder.ids_of(part))
        if len(part) <= LONGEST_CACHED:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[part] = ids
        return ids


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and model; its caches serve all tasks of the worker."""
    return kept(("pieces", path), lambda: PieceEncoder(path))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids`` (array of int, the end id last) and ``decoded`` text of every row.

    A null or empty text has the end id alone and decodes to an empty text; repeated rows
    each give a row; a null id stays null; other columns are not read, so their names
    cannot clash. Rows never meet, so there is no shuffle.
    """
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for keys, texts in text_rows(batches):
            ids = [bpe.encode(t or "") for t in texts]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, arrow), "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array([bpe.decode(x) for x in ids], pa.string()),
            })

    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"key {kind.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", id_col)
