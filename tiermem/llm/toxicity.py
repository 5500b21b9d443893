"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of the embeddings of three hashed keys: the word and its
first four and five bytes, so inflected forms share what was learned. Filters of
widths one to three slide over the words, each keeps its maximum over the whole text,
and a logistic unit reads the maxima. Thresholds are calibrated for each language that
the text itself suggests: the score is shifted so that 0.3 is the threshold.

Every labelled row counts, with its whole text. Document frequencies of the keys are summed over
all tasks. In each round every task trains on the rows of its partition from the same start, and
Spark averages what the tasks changed. The thresholds come from counts of all calibration rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermem.llm.common import text_rows
from tiermem.session import shared_folder

BUCKETS = 1 << 15
SIZE = 12
FILTERS = 8
PRIOR = 4.0
WIDTHS = (1, 2, 3)
CUT = 0.3
SLICE = 50_000
CACHED_WORDS = 200_000
ROUNDS, BATCH, RATE = 3, 32, 0.02
#: Fewer rows are not worth a task of their own in training.
TASK_ROWS = 4096
#: Logits are counted on this grid, between -``FAR`` and ``FAR``.
GRID, FAR = 1000, 40
WORD = re.compile(r"\w+")


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    spoken: np.ndarray | None = None          # buckets x languages: log shares of the keys
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.0


def word_keys(word: str, crc=zlib.crc32) -> tuple[int, int, int]:
    raw = word.encode("utf-8", "replace")
    return crc(raw) % BUCKETS, crc(raw[:4], 4) % BUCKETS, crc(raw[:5], 5) % BUCKETS


class Words:
    """The keys of a text's words, in order; a word's keys are computed once per task."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.keys = np.zeros((1 << 12, 3), np.int32)

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        new = [w for w in set(words) if w not in self.index]
        if len(self.index) + len(new) > CACHED_WORDS:
            self.index, new = {}, list(set(words))
        first = len(self.index)
        while len(self.keys) < first + len(new):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        if new:
            self.keys[first:first + len(new)] = [word_keys(w) for w in new]
            self.index.update((w, first + i) for i, w in enumerate(new))
        return self.keys[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


class Net:
    """All parameters as rows of one matrix, with as many sums of squared gradients; filters, shifts and outputs are views."""

    DENSE = (sum(WIDTHS) * FILTERS * SIZE + 2 * len(WIDTHS) * FILTERS) // SIZE + 1
    ROWS = BUCKETS + DENSE

    def __init__(self, values: np.ndarray, squares: np.ndarray):
        self.values, self.squares = values, squares
        self.steps = np.zeros(self.ROWS, np.int64)   # updates of every row since this net was made
        self.embedding = values[:BUCKETS]
        self.filters, self.shift, self.out, self.bias = self._views(values[BUCKETS:])

    @staticmethod
    def _views(dense: np.ndarray) -> tuple:
        flat, at, filters = dense.reshape(-1), 0, []
        for w in WIDTHS:
            filters.append(flat[at:at + w * SIZE * FILTERS].reshape(w * SIZE, FILTERS))
            at += w * SIZE * FILTERS
        n = len(WIDTHS) * FILTERS
        return filters, flat[at:at + n].reshape(len(WIDTHS), FILTERS), flat[at + n:at + 2 * n], flat[at + 2 * n:at + 2 * n + 1]

    @classmethod
    def start(cls, toxic: np.ndarray, clean: np.ndarray, share: float, seed: int = 11) -> Net:
        """``toxic``, ``clean``: documents of the class that hold a key; ``share``: of toxic documents.

        The first component of an embedding starts as the smoothed log-odds of its key among
        toxic documents, and one filter of every width starts by reading it: with few
        labelled rows the maxima are then not drawn to chance words.
        """
        rng = np.random.default_rng(seed)
        net = cls(np.zeros((cls.ROWS, SIZE), np.float32), np.full((cls.ROWS, SIZE), 1e-2, np.float32))
        net.embedding[:] = rng.normal(0, 0.05, (BUCKETS, SIZE))
        net.embedding[:, 0] = np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share)) * (1 - share) / share) / 2
        for w, f in zip(WIDTHS, net.filters):
            f[:] = rng.normal(0, 0.2, f.shape)
            f[:, 0] = 0
            f[::SIZE, 0] = 1.5 / w
        net.out[:] = rng.normal(0, 0.1, len(net.out))
        net.out[::FILTERS] = 1.0
        net.bias[:] = -1.0
        return net

    def _windows(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over every padded document, and where their windows begin; long documents go in slices that overlap."""
        reach, n = max(WIDTHS) - 1, len(WIDTHS) * FILTERS
        best, place = np.full((len(docs), n), -np.inf), np.zeros((len(docs), n), np.int64)
        pieces, held = [], 0

        def flush() -> None:
            cells = np.concatenate([docs[d][a:b] for d, a, b in pieces])
            x = (self.embedding[cells[:, 0]] + self.embedding[cells[:, 1]] + self.embedding[cells[:, 2]]) / 3
            x[cells[:, 0] < 0] = 0
            for k, (w, f, shift) in enumerate(zip(WIDTHS, self.filters, self.shift)):
                z = x[:len(x) - w + 1] @ f[:SIZE]
                for j in range(1, w):
                    z += x[j:len(x) - w + 1 + j] @ f[j * SIZE:(j + 1) * SIZE]
                own, first = slice(k * FILTERS, (k + 1) * FILTERS), 0
                for d, a, b in pieces:
                    part = z[first:first + b - a - w + 1]
                    at = part.argmax(0)
                    top = part[at, np.arange(FILTERS)] + shift
                    more = top > best[d, own]
                    best[d, own] = np.where(more, top, best[d, own])
                    place[d, own] = np.where(more, at + a, place[d, own])
                    first += b - a

        for d, cells in enumerate(docs):
            for a in range(0, max(1, len(cells) - reach), SLICE):
                b = min(len(cells), a + SLICE + reach)
                pieces.append((d, a, b))
                held += b - a
                if held >= SLICE:
                    flush()
                    pieces, held = [], 0
        if pieces:
            flush()
        return best, place

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """One Adagrad step on the mean weighted logistic loss of some documents, given as keys of their words."""
        pad = np.full((max(WIDTHS) - 1, 3), -1, np.int32)
        docs = [np.concatenate([pad, keys, pad]) for keys in texts]
        h, place = self._windows(docs)
        r = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(r @ self.out + self.bias, -30, 30)))
        slope = (p - labels) * weights / len(docs)
        change = np.zeros((self.DENSE, SIZE))
        d_filters, d_shift, d_out, d_bias = self._views(change)
        dh = slope[:, None] * self.out * (h > 0)
        d_out[:] = slope @ r
        d_bias[:] = slope.sum()
        rows, values = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = dh[:, k * FILTERS:(k + 1) * FILTERS]
            at = place[:, k * FILTERS:(k + 1) * FILTERS, None] + np.arange(w)
            cells = np.stack([doc[some] for doc, some in zip(docs, at)])          # documents x filters x words x keys
            known = cells[..., 0] >= 0
            x = self.embedding[cells].sum(3) / 3 * known[..., None]
            d_filters[k][:] = np.einsum("dq,dqjs->jsq", g, x).reshape(w * SIZE, FILTERS)
            d_shift[k] = g.sum(0)
            used = known & (g != 0)[..., None]
            back = g[:, :, None, None] * f.reshape(w, SIZE, FILTERS).transpose(2, 0, 1)[None] / 3
            rows.append(cells[used].reshape(-1))
            values.append(np.repeat(back[used], 3, axis=0))
        self._update(slice(BUCKETS, None), change, change * change)
        rows, values = np.concatenate(rows), np.concatenate(values)
        if len(rows):
            order = np.argsort(rows, kind="stable")
            rows, begins = np.unique(rows[order], return_index=True)
            total = np.add.reduceat(values[order], begins, axis=0)
            self._update(rows, total, (total * total).mean(1)[:, None])

    def _update(self, rows, change: np.ndarray, squares: np.ndarray) -> None:
        self.squares[rows] += squares
        self.values[rows] -= RATE * change / np.sqrt(self.squares[rows])
        self.steps[rows] += 1

    def model(self) -> Model:
        return Model(self.embedding.astype(np.float32), [f.astype(np.float32) for f in self.filters], [b.astype(np.float32) for b in self.shift],
                     self.out.copy(), float(self.bias[0]))


def class_weights(toxic: int, clean: int) -> tuple[float, float, float]:
    """Weights of a clean and of a toxic row, by which the classes count the same, and the share of toxic rows."""
    share = toxic / (toxic + clean) if toxic + clean else 0.5
    return 0.5 / max(1e-9, 1 - share), 0.5 / max(1e-9, share), min(max(share, 0.01), 0.99)


def learn(net: Net, slices: Iterable[tuple[list[int], list[np.ndarray]]], weights: tuple[float, float], seed: int = 11) -> None:
    """One pass over slices of labels and of the keys of texts, in small steps."""
    rng = np.random.default_rng(seed)
    for labels, docs in slices:
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            some = order[start:start + BATCH]
            y = np.array([labels[i] for i in some])
            net.step([docs[i] for i in some], y, np.where(y == 1, weights[1], weights[0]))


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 11) -> Model:
    """The network fitted on texts at hand, as one task would."""
    docs = list(map(Words().of, texts))
    found = {(kind, int(key)): int(n) for kind, key, n in zip(*key_counts([([(y, None) for y in labels], docs)]))}
    toxic, clean = (np.array([found.get((kind, key), 0) for key in range(BUCKETS)], float) for kind in ("1", "0"))
    *weights, share = class_weights(sum(labels), len(labels) - sum(labels))
    net = Net.start(toxic, clean, share, seed)
    for number in range(rounds):
        learn(net, [(labels, docs)], weights, seed + number)
    return net.model()


def key_counts(slices: Iterable[tuple[list[tuple[int, str | None]], list[np.ndarray]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Columns kind, key and number, from slices of (label, language) and of the keys of texts: for kinds ``0`` and ``1`` the documents of
    the label that hold a key (under key -1: all its documents), for kinds like ``=en`` how often the language's texts hold it."""
    sums: dict[str, np.ndarray] = {}
    for names, docs in slices:
        for (label, lang), doc in zip(names, docs):
            held = np.bincount(doc.reshape(-1), minlength=BUCKETS + 1)
            own = sums.setdefault(str(label), np.zeros(BUCKETS + 1, np.int64))
            own += held > 0
            own[-1] += 1
            if lang is not None:
                sums.setdefault(f"={lang}", np.zeros(BUCKETS + 1, np.int64))[:] += held
    kinds, keys, numbers = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind, own in sums.items():
        at = np.flatnonzero(own)
        kinds.extend([kind] * len(at))
        keys.append(np.where(at == BUCKETS, -1, at))
        numbers.append(own[at])
    return kinds, np.concatenate(keys), np.concatenate(numbers)


def set_languages(model: Model, counts: dict[str, np.ndarray]) -> None:
    """Naive Bayes over the same hashed keys; it only tells which threshold a text gets."""
    model.languages = sorted(counts)
    table = np.stack([counts[lang] for lang in model.languages], 1) + 0.5 if counts else np.full((BUCKETS, 1), 0.5)
    model.spoken = np.log(table / table.sum(0)).astype(np.float32)
    model.spoken -= model.spoken.mean(1, keepdims=True)


def learn_languages(model: Model, texts: list[str], langs: list[str]) -> None:
    words, counts = Words(), {}
    for text, lang in zip(texts, langs):
        counts[lang] = counts.get(lang, 0) + np.bincount(words.of(text).reshape(-1), minlength=BUCKETS)
    set_languages(model, counts)


class Scorer:
    """Logits and languages of whole texts; what a word adds to each filter is computed once per worker and word."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.filters = sum(WIDTHS) * FILTERS
        self.parts = np.zeros((1 << 12, self.filters + len(model.languages)), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > CACHED_WORDS:
            self.index = {}
            new = list(words)
        m, first = self.model, len(self.index) + 1
        while len(self.parts) < first + len(new):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            keys = np.array([word_keys(w) for w in some])
            x = (m.embedding[keys[:, 0]] + m.embedding[keys[:, 1]] + m.embedding[keys[:, 2]]) / np.float32(3)
            columns = [x @ f[j * SIZE:(j + 1) * SIZE] for w, f in zip(WIDTHS, m.filters) for j in range(w)]
            if m.languages:
                columns.append(m.spoken[keys].sum(1))
            self.parts[first + at:first + at + len(some)] = np.concatenate(columns, 1)
        self.index.update((w, first + i) for i, w in enumerate(new))

    def maxima(self, words: list[str], overlap: int, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the filters over a slice of a text, which is padded at the text's ends only, and its language sums."""
        pad = max(WIDTHS) - 1
        before = pad if first else 0
        ids = np.zeros(before + len(words) + (pad if last else 0), np.int64)
        ids[before:before + len(words)] = list(map(self.index.__getitem__, words))
        rows, out, column = self.parts[ids], [], 0
        for w, b in zip(WIDTHS, self.model.shift):
            n = len(ids) - w + 1
            z = rows[:n, column:column + FILTERS]
            for j in range(1, w):
                z = z + rows[j:j + n, column + j * FILTERS:column + (j + 1) * FILTERS]
            column += w * FILTERS
            out.append(z.max(0) + b)
        return np.concatenate(out), rows[before + overlap:, self.filters:].sum(0)

    def logits(self, texts: list[str | None]) -> list[tuple[float, str | None]]:
        """Logit and suggested language of every text."""
        split = [WORD.findall((t or "").lower()) for t in texts]
        out = []
        fits = sum(map(len, split)) <= 2 * SLICE
        if fits:
            self._learn({w for words in split for w in words})
        for words in split:
            best, spoken, reach = None, 0.0, max(WIDTHS) - 1
            for at in range(0, max(1, len(words)), SLICE):
                some = words[max(0, at - reach):at + SLICE]
                if not fits:
                    self._learn(set(some))
                found, tongue = self.maxima(some, min(at, reach), at == 0, at + SLICE >= len(words))
                best = found if best is None else np.maximum(best, found)
                spoken = spoken + tongue
            lang = self.model.languages[int(np.argmax(spoken))] if self.model.languages and words else None
            out.append((float(np.maximum(best, 0) @ self.model.out + self.model.bias), lang))
        return out


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the best weighted F1; the middle of the gap where the best is reached between two rows."""
    if not len(logits) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], labels[order], weights[order]
    hits = np.cumsum(y * w)
    f1 = 2 * hits / (np.cumsum(w) + (y * w).sum())
    ends = np.append(z[:-1] != z[1:], True)
    at = int(np.argmax(np.where(ends, f1, -1)))
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at]) - 1e-6


def scored(logit: float, threshold: float) -> float:
    """A probability that is ``CUT`` at the threshold."""
    return float(1 / (1 + np.exp(-np.clip(logit - threshold + np.log(CUT / (1 - CUT)), -40, 40))))


def _encoded(rows: DataFrame) -> DataFrame:
    """(label, lang, text, part) -> the same with the keys of the words of part 0 (16 bits each) in place of its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for names, texts in text_rows(batches, rows=512, size=1 << 20):
            keys = [None if n["part"] else words.of(t).astype(np.uint16).tobytes() for n, t in zip(names, texts)]
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([n["label"] for n in names], pa.int64()), "lang": pa.array([n["lang"] for n in names], pa.string()),
                "text": pa.array([t if n["part"] else None for n, t in zip(names, texts)], pa.string()), "keys": pa.array(keys, pa.binary()),
                "part": pa.array([n["part"] for n in names], pa.int32())})

    return rows.select(F.struct("label", "lang", "part").alias("names"), "text").mapInArrow(run, "label long, lang string, text string, keys binary, part int")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Slices of the first column (a struct gives a tuple) and of the keys in the second."""
    for names, docs in text_rows(batches, rows=512, size=1 << 20):
        yield ([tuple(n.values()) if isinstance(n, dict) else n for n in names],
               [np.frombuffer(d, np.uint16).reshape(-1, 3).astype(np.int32) for d in docs])


def _counted(rows: DataFrame) -> dict[str, np.ndarray]:
    """Sums of ``key_counts`` over all rows (label, lang, keys): a number per kind and key goes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, keys, numbers = key_counts(_slices(batches))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int64())], ["kind", "key", "n"])

    found = rows.select(F.struct("label", "lang").alias("names"), "keys").mapInArrow(run, "kind string, key long, n long")
    table = found.groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    sums: dict[str, np.ndarray] = {}
    kinds, keys, numbers = np.array(table["kind"].to_pylist(), object), table["key"].to_numpy(), table["n"].to_numpy()
    for kind in set(kinds):
        at = kinds == kind
        own = sums[kind] = np.zeros(BUCKETS + 1)
        own[keys[at]] = numbers[at]
    return sums


def _trained(rows: DataFrame, net: Net, weights: tuple[float, float], seed: int) -> Net:
    """One round: every task learns from its rows (label, keys); each parameter row becomes the mean over the tasks that changed
    it, weighted by their steps. At most ``Net.ROWS`` rows go to the driver, whatever the number of tasks."""
    first, sums = (net.values, net.squares), [f"{c}{i}" for c in "vs" for i in range(SIZE)]
    names = ["row", "n", *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net(first[0].copy(), first[1].copy())
        learn(own, _slices(batches), weights, seed)
        at = np.flatnonzero(own.steps)
        n = own.steps[at]
        both = np.concatenate([own.values[at], own.squares[at]], 1).astype(np.float64) * n[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), *(pa.array(c) for c in both.T)], names)

    changed = rows.select("label", "keys").mapInArrow(run, ", ".join(["row long", "n long", *(f"{c} double" for c in sums)]))
    table = changed.groupBy("row").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    at, n = table["row"].to_numpy(), table["n"].to_numpy()
    both = np.stack([table[c].to_numpy() for c in sums], 1) / n[:, None] if len(at) else np.zeros((0, 2 * SIZE))
    values, squares = net.values.copy(), net.squares.copy()
    values[at], squares[at] = both[:, :SIZE], both[:, SIZE:]
    return Net(values, squares)


def _set_thresholds(rows: DataFrame, model: Model) -> None:
    """Thresholds from the logits of all rows (label, text), counted on a grid by language and label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for labels, texts in text_rows(batches, rows=512, size=1 << 20):
            found = scorer.logits(texts)
            cells = [int(np.floor(np.clip(z, -FAR, FAR) * GRID)) for z, _ in found]
            yield pa.RecordBatch.from_pydict({"spoken": pa.array([str(lang) for _, lang in found]), "label": pa.array(labels, pa.int64()),
                                              "cell": pa.array(cells, pa.int64())})

    counts = rows.select("label", "text").mapInArrow(run, "spoken string, label long, cell long").groupBy("spoken", "label", "cell").count().toArrow()
    spoken, y, w = np.array(counts["spoken"].to_pylist(), object), counts["label"].to_numpy().astype(float), counts["count"].to_numpy().astype(float)
    z = (counts["cell"].to_numpy() + 0.5) / GRID
    model.common = calibrate(z, y, w)
    for lang in sorted(set(spoken)):
        at = spoken == lang
        if (y[at] * w[at]).sum() >= 20 and ((1 - y[at]) * w[at]).sum() >= 20:
            model.thresholds[lang] = calibrate(z[at], y[at], w[at])


def labelled(docs: DataFrame, labels: DataFrame, known: Column) -> DataFrame:
    """Documents with their labels, of the ids that ``known`` lets in. Texts are shuffled, whatever the size of the labels, so the cost grows evenly."""
    return docs.filter(known).join(labels.filter(known).hint("merge"), "doc_id")


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang",
        rounds: int = ROUNDS) -> Model:
    """Fit on every labelled row, whole texts; rows without text or label are left out.

    A quarter of the rows, by a hash of the id, only calibrates the thresholds. A language with
    under 20 rows of either class in that part uses the threshold of all languages together.
    """
    spark = rows.sparkSession
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    known = rows.select(F.col(label_col).cast("long").alias("label"), F.col(text_col).alias("text"), lang.alias("lang"),
                        (F.crc32(F.concat(F.lit("c"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))) % 4 == 0).cast("int").alias("part")).where("text IS NOT NULL AND label IN (0, 1)")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _encoded(known).write.partitionBy("part").option("compression", "zstd").parquet(path)  # read once a round
    stored = spark.read.schema("label long, lang string, text string, keys binary, part int").parquet(path)
    learned = stored.where("part = 0").drop("part")
    counts = _counted(learned)
    none = np.zeros(BUCKETS + 1)
    toxic, clean = counts.get("1", none), counts.get("0", none)
    *weights, share = class_weights(toxic[-1], clean[-1])
    net = Net.start(toxic[:-1], clean[:-1], share)
    if toxic[-1] + clean[-1]:
        shared = learned.coalesce(max(1, int(toxic[-1] + clean[-1]) // TASK_ROWS))
        for number in range(rounds):
            net = _trained(shared, net, weights, number)
    model = net.model()
    set_languages(model, {kind[1:]: own[:-1] for kind, own in counts.items() if kind.startswith("=")})
    _set_thresholds(stored.where("part = 1"), model)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on) of every row.

    Only the id and the text are read. A null or empty text is scored as a text without
    words; repeated rows each give a row; an empty table gives none.
    """
    key = docs.schema[id_col].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for ids, texts in text_rows(batches, rows=512, size=1 << 20):
            out = []
            for logit, lang in scorer.logits(texts):
                out.append(scored(logit, model.thresholds.get(lang, model.common)))
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array(ids, kind), "score": pa.array(out, pa.float64()),
                "predicted": pa.array([int(s >= CUT) for s in out], pa.int32()),
            })

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {key}, score double, predicted int")
