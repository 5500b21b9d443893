"""Hybrid recall for a batch of queries: BM25, dense top-n, rank fusion, re-ranking.

Queries are a DataFrame (query_id, store_key, text, embedding) plus a per-query
``fetch`` (rows taken from each channel) and ``cut`` (rows kept after fusion).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tiermem.functions import text
from tiermem.functions.vectors import SCORE_DIGITS, nearest
from tiermem.operators.lexical_index import LexicalIndex, packed_terms, unpacked
from tiermem.session import cut_lineage

# BM25 constants, fusion constant, over-fetch factors.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
ATOM_OVERFETCH, TEXT_OVERFETCH = 3, 2
SECONDS_PER_DAY = 86400.0


@dataclass(frozen=True)
class Weights:
    recency: float = 0.10
    priority: float = 0.15
    confidence: float = 0.05
    half_life_days: float = 30.0


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """docs(store_key, id, body) -> (store_key, id, term, tf, doc_len), in one pass over the texts.

    Every document also has a row under the empty term, so that the size and the length
    of a store follow from the same table. Tasks count the words of their own documents (one row
    per store and id), so nothing is shuffled. With ``wanted`` (store_key, term) other stores are
    not tokenised and other words are dropped.
    """
    if wanted is not None:
        docs = docs.join(wanted.select("store_key").distinct(), "store_key", "left_semi")
    packed = packed_terms(docs.select("store_key", "id", F.coalesce("body", F.lit("")).alias("body")), 1)
    once = F.when(F.col("term") == "", 1).otherwise(F.col("tf")).cast("long")
    rows = unpacked(packed.drop("bucket")).select("store_key", "id", "doc_len", "term", once.alias("tf"))
    if wanted is not None:
        own = wanted.select("store_key").distinct().withColumn("term", F.lit(""))
        rows = rows.join(wanted.select("store_key", "term").distinct().unionByName(own), ["store_key", "term"], "left_semi")
    return rows


def term_statistics(index: DataFrame) -> DataFrame:
    """postings -> (store_key, term, df, n_docs, avg_len) over all rows of a store, whatever their status."""
    sums = index.groupBy("store_key", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("doc_len").alias("_len"))
    whole = sums.where("term = ''").select("store_key", F.col("df").alias("n_docs"), (F.col("_len") / F.col("df")).alias("avg_len"))
    return sums.where("term <> ''").drop("_len").join(whole, "store_key")


def query_terms(queries: DataFrame) -> DataFrame:
    distinct = F.array_distinct(text.tokens(F.col("text")))
    return queries.select(
        "query_id", "store_key", "fetch", F.size(distinct).alias("n_terms"),
        F.explode(distinct).alias("term"),
    )


def bm25_topn(queries: DataFrame, docs: DataFrame | LexicalIndex, max_fetch: int) -> DataFrame:
    """(query_id, id, score, rank0): documents of the store holding every query token.

    ``docs`` is a kept index, whose folders of the asked terms are read, or the documents, which
    are then tokenised once into a stored table of the postings the queries can use. Candidates
    come from the rarest term of each query only, and the other terms are looked up for those
    candidates alone, so a frequent word in a longer query multiplies nothing. Queries of
    one word are ranked as they are read, without a table of candidates.
    """
    terms = cut_lineage(query_terms(queries))
    if isinstance(docs, LexicalIndex):
        index = cut_lineage(docs.postings(terms))
        stats = docs.statistics(terms, index)
    else:
        index = cut_lineage(postings(docs, terms))
        stats = term_statistics(index)
    of_query = Window.partitionBy("query_id")
    n, df = F.col("n_docs"), F.col("df")
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    ready = cut_lineage(
        terms.join(stats, ["store_key", "term"])
        .withColumns({
            "_present": F.count(F.lit(1)).over(of_query),
            "_lead": F.min(F.struct("df", "term")).over(of_query),
            "idf": idf,
        })
        .where("_present = n_terms")
        .select(
            "query_id", "store_key", "term", "n_terms", "fetch", "idf", "avg_len",
            (F.col("_lead.term") == F.col("term")).alias("is_lead"),
        )
    )
    leads, rest = ready.where("is_lead"), ready.where("NOT is_lead")
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (
        tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len"))
    )
    alone = index.join(leads.where("n_terms = 1"), ["store_key", "term"]).select("query_id", "id", "fetch", part.alias("score"))
    candidates = cut_lineage(
        index.join(leads.where("n_terms > 1"), ["store_key", "term"]).select(
            "query_id", "store_key", "id", "n_terms", "fetch", part.alias("part")
        )
    )
    lookups = candidates.select("query_id", "id").join(
        rest.select("query_id", "store_key", "term", "idf", "avg_len"), "query_id"
    )
    others = index.join(lookups, ["store_key", "id", "term"]).select("query_id", "id", part.alias("part"))
    hits = candidates.select("query_id", "id", "part").unionByName(others)
    together = (
        hits.groupBy("query_id", "id")
        .agg(F.count(F.lit(1)).alias("_hits"), F.sum("part").alias("score"))
        .join(leads.select("query_id", "n_terms", "fetch"), "query_id")
        .where("_hits = n_terms")
        .select("query_id", "id", "fetch", "score")
    )
    return ranked(together.unionByName(alone).withColumn("score", F.round("score", SCORE_DIGITS)), max_fetch)


def dense_topn(queries: DataFrame, vectors: DataFrame, max_fetch: int) -> DataFrame:
    """(query_id, id, score, rank0): exact nearest vectors of the store."""
    near = nearest(queries, vectors, max_fetch)
    return ranked(near.join(queries.select("query_id", "fetch"), "query_id"), max_fetch)


def ranked(scored: DataFrame, max_fetch: int) -> DataFrame:
    """Best first, ties by id; the constant bound is pruned before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (
        scored.withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= max_fetch)
        .where("_rn <= fetch")
        .select("query_id", "id", "score", (F.col("_rn") - 1).cast("long").alias("rank0"))
    )


def rrf(channels: list[DataFrame], queries: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf): reciprocal-rank sums, cut per query."""
    ranks = channels[0].select("query_id", "id", "rank0")
    for channel in channels[1:]:
        ranks = ranks.unionByName(channel.select("query_id", "id", "rank0"))
    fused = ranks.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank0"))), SCORE_DIGITS).alias("rrf")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("id"))
    return (
        fused.join(queries.select("query_id", "store_key", "cut"), "query_id")
        .withColumn("_rn", F.row_number().over(order))
        .where("_rn <= cut")
        .drop("_rn", "cut")
    )


def with_limit(queries: DataFrame, limit, overfetch: int) -> DataFrame:
    cut = F.lit(limit) if isinstance(limit, int) else limit
    return queries.withColumn("cut", cut.cast("int")).withColumn("fetch", F.col("cut") * overfetch)


def _largest(queries: DataFrame, limit) -> int:
    """The largest limit any query asks for, read from the queries: nothing is cut below it."""
    return limit if isinstance(limit, int) else max(1, int(queries.agg(F.max(limit)).first()[0] or 1))


def blend(hits: DataFrame, atoms: DataFrame, as_of_s: int, weights: Weights = Weights()) -> DataFrame:
    """Active hits re-scored with recency, priority and confidence; the cut came first."""
    live = atoms.where("status = 'active'").select(
        "id", "store_key", "priority", "confidence", "pinned", "created_s"
    )
    age_days = (F.lit(as_of_s) - F.col("created_s")) / SECONDS_PER_DAY
    recency = F.pow(F.lit(0.5), age_days / weights.half_life_days)
    strength = F.when(F.col("priority") <= 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("priority") / 100.0))
    )
    trust = F.when(F.col("confidence") == "high", 1.0).when(
        F.col("confidence") == "medium", 0.6
    ).otherwise(0.3)
    score = (
        F.col("rrf") + weights.recency * recency + weights.priority * strength
        + weights.confidence * trust
    )
    return hits.join(live, ["store_key", "id"]).select(
        "query_id", "store_key", "id", "pinned", F.round(score, SCORE_DIGITS).alias("score")
    )


def _hybrid(queries: DataFrame, docs: DataFrame, max_fetch: int, index: LexicalIndex | None = None) -> DataFrame:
    """docs(store_key, id, body, embedding); with an index the bodies are not read."""
    lexical = bm25_topn(queries, docs.select("store_key", "id", "body") if index is None else index, max_fetch)
    dense = dense_topn(queries, docs.select("store_key", "id", "embedding"), max_fetch)
    return rrf([lexical, dense], queries)


def atom_docs(atoms: DataFrame) -> DataFrame:
    return atoms.select("store_key", "id", F.col("content").alias("body"), "embedding")


def scene_docs(scenes: DataFrame) -> DataFrame:
    return scenes.select(
        "store_key", F.col("scene_id").alias("id"),
        F.concat_ws("\n", "title", "summary").alias("body"), "embedding",
    )


def search_atoms(
    queries: DataFrame, atoms: DataFrame, as_of_s: int, limit=10,
    weights: Weights = Weights(), index: LexicalIndex | None = None,
) -> DataFrame:
    """``limit`` is a number or a column of the queries; ``index`` is a kept index of the atoms' texts."""
    top = _largest(queries, limit)
    asked = with_limit(queries, limit, ATOM_OVERFETCH)
    return blend(_hybrid(asked, atom_docs(atoms), top * ATOM_OVERFETCH, index), atoms, as_of_s, weights)


def search_turns(queries: DataFrame, turns: DataFrame, limit: int = 10, index: LexicalIndex | None = None) -> DataFrame:
    asked = with_limit(queries, limit, TEXT_OVERFETCH)
    docs = turns.select("store_key", "id", F.col("content").alias("body"), "embedding")
    return _hybrid(asked, docs, limit * TEXT_OVERFETCH, index).withColumnRenamed("rrf", "score")


def search_scenes(
    queries: DataFrame, scenes: DataFrame, limit=10, index: LexicalIndex | None = None
) -> DataFrame:
    top = _largest(queries, limit)
    asked = with_limit(queries, limit, TEXT_OVERFETCH)
    hits = _hybrid(asked, scene_docs(scenes), top * TEXT_OVERFETCH, index)
    live = scenes.where("status = 'active'").select(F.col("scene_id").alias("id"), "store_key")
    return hits.join(live, ["store_key", "id"], "left_semi").withColumnRenamed("rrf", "score")
