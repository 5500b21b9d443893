"""Language identification with error-correcting output codes.

Every language has a codeword of signs. One binary classifier per bit, logistic
regression over hashed byte 2- and 3-grams of the lower-cased text, predicts that
bit; a text gets the language whose codeword loses least over all bits (logistic
loss, so a sure bit weighs more than an unsure one). A small gap between the two
best languages is flagged as ambiguous.

The classifiers are fitted on a bounded, documented sample (``per_language``
documents, cut into segments of several lengths); prediction reads whole texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermem.llm.common import row_sample, text_rows

FEATURES = 1 << 12
SEGMENTS = (40, 120, 400, 2000)
PIECE = 1 << 20
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray      # languages x bits, signs
    weights: np.ndarray    # features x bits
    bias: np.ndarray


def codewords(count: int, bits: int = 15, seed: int = 7) -> np.ndarray:
    """A codeword of signs per language: all splits in two for few languages, else random rows far apart."""
    if count <= 1:
        return np.ones((count, 1))
    if count <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=count) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=float).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = max(bits, int(np.ceil(10 * np.log2(count))) // 2)
    for _ in range(200):
        codes = rng.choice((-1.0, 1.0), (count, bits))
        if (np.abs(codes.sum(0)) == count).any():
            continue
        distance = min(int((a != b).sum()) for a, b in itertools.combinations(codes, 2))
        if distance > apart:
            best, apart = codes, distance
    return best


def profile(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte 2- and 3-grams of a text, read in pieces of bounded size."""
    counts = np.zeros(FEATURES)
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw, dtype=np.uint8, count=min(PIECE + 2, len(raw) - at), offset=at).astype(np.uint32)
        for codes in ((b[:-1] << 8) + b[1:] + 1, (b[:-2] << 16) + (b[1:-1] << 8) + b[2:] + (1 << 25)):
            counts += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    return np.sqrt(counts / max(1.0, counts.sum()))


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def train(texts: list[str], langs: list[str], rounds: int = 120, rate: float = 0.05) -> Model:
    """Fit the bit classifiers; languages in sorted order, a repeated row counts again."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    rows, signs = [], []
    for text, lang in zip(texts, langs):
        raw = _bytes(text)
        for i, size in enumerate(SEGMENTS):
            at = (len(raw) * i // len(SEGMENTS)) if len(raw) > size else 0
            rows.append(profile(raw[at:at + size]).astype(np.float32))
            signs.append(codes[languages.index(lang)])
    if not rows:
        return Model([], codes, np.zeros((FEATURES, 1)), np.zeros(1))
    x, y = np.stack(rows), np.stack(signs).astype(np.float32)
    w, b = np.zeros((FEATURES, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        grad = x.T @ slope + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * 10 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        b -= 0.5 * slope.sum(0)
    return Model(languages, codes, w.astype(np.float64), b.astype(np.float64))


def fit(docs: DataFrame, per_language: int = 300, longest: int = 200_000,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``per_language`` rows of each language with at most ``longest`` characters.

    Rows with a null text or language are left out. The sample is what bounds the driver.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col)).filter(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sample = row_sample(rows, lang_col, per_language, id_col).filter(F.length(text_col) <= longest)
    data = sorted(((r[2], r[0], r[1]) for r in sample.collect()), key=lambda r: (r[0], str(r[1]), r[2]))
    return train([r[2] for r in data], [r[0] for r in data])


def decide(model: Model, text: str | None) -> tuple[str, float, float]:
    """Language, its probability and the lead over the second; ``und``, 0 and 0 without text, letters or languages."""
    if not text or not model.languages or not LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    margins = profile(_bytes(text)) @ model.weights + model.bias
    loss = np.log1p(np.exp(-np.clip(model.codes * margins, -30, 30))).sum(1)
    weight = np.exp(loss.min() - loss)
    share = weight / weight.sum()
    best = int(np.argmin(loss))
    rest = np.delete(share, best)
    return model.languages[best], float(share[best]), float(share[best] - (rest.max() if len(rest) else 0.0))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", unsure: float = 0.2) -> DataFrame:
    """Id, ``lang_pred``, ``score`` and ``ambiguous`` (lead below ``unsure``) of every row.

    Only the id and the text are read. Texts that are null, empty or without a letter
    are ``und`` with score 0; equal losses go to the first language in sorted order;
    repeated rows each give a row; an empty table gives none.
    """
    key = docs.schema[id_col].dataType
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_rows(batches):
            found = [decide(model, t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                id_col: pa.array(ids, kind), "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64()),
                "ambiguous": pa.array([f[0] != UNKNOWN and f[2] < unsure for f in found], pa.bool_()),
            })

    schema = f"{id_col} {key.simpleString()}, lang_pred string, score double, ambiguous boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
