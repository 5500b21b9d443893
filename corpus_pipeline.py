"""The corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Every
stage but the last returns the columns of ``documents``; between stages the rows are a stored
table. Rows with a null id cannot be told apart and go in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermem.llm import jaccard_join, language_id, packing, suffix_dedup, toxicity
from tiermem.llm.common import cut_lineage, held_out, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in ``ids`` (column ``doc_id``), by equi-join; rows keep their columns."""
    return docs.select(*COLUMNS).join(ids.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def _only_rows(docs: DataFrame, verdicts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows whose own verdict lets them stay: ``verdicts`` names them by ``row``, which tells rows of one id apart by their text."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(*COLUMNS, F.concat_ws(":", "doc_id", F.xxhash64("text")).alias("row"))
    return rows.join(verdicts(rows).select("row").distinct(), "row", "left_semi").select(*COLUMNS)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without text or a letter go."""
    model = language_id.fit(read(spark, sf_dir, "documents").filter(~held_out(3, 1)))
    return _only_rows(docs, lambda rows: language_id.predict(rows, model, "row").filter(F.col("lang_pred") != language_id.UNKNOWN))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), labels, ~held_out(4, 2)))
    return _only_rows(docs, lambda rows: toxicity.score(rows, model, "row").filter(F.col("predicted") == 0))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the smallest id stays, with all rows of that id."""
    return _only(docs, jaccard_join.classes(docs, words=5, percent=80).filter(F.col("component_id") == F.col("doc_id")))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document repeats of smaller ids are cut out; documents left without text go.

    A character that a cut splits goes as a whole; ``n_chars`` is counted anew. Each of repeated rows gives one row.
    """
    out = suffix_dedup.dedup(docs.filter(F.col("doc_id").isNotNull()), length=50, keep=("lang", "source"), whole=True)
    out = out.withColumn("text", F.col("kept").cast("string")).filter(F.trim("text") != "")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text", "lang", "source",
                      F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, packed into sequences of at most 2048 tokens."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", detect_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_per_group),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack_sequences),
]

#: Trained models and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
