"""The query of every operator of this folder, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermem.llm import (
    byte_bpe, fill_middle, html_text, jaccard_join, language_id, near_vectors, packing, piece_bpe, suffix_dedup, top_k, toxicity, turn_repair,
    url_filters,
)
from tiermem.llm.common import held_out, read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filters.train(url_filters.labelled(spark))
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "blocked_p")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(read(spark, sf_dir, "documents"), words=3, percent=90)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_classes(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(read(spark, sf_dir, "pages"), keep=("url",))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled(docs, labels, ~held_out(4, 2)))
    return toxicity.score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out(3, 1)))
    return language_id.predict(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").filter(top_k.usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(64.0 * x.cast("double"))).alias("weights"))
    return top_k.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_texts(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turn_repair.report(turn_repair.edited(turn_repair.damage(turns), turns))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform_texts(read(spark, sf_dir, "documents"), seed=7, kind="line", rate=100, spm=50)
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(whole, 256).alias("restored_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_bpe.encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_structure_repair": op11_structure_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_sentencepiece": op13_sentencepiece,
}

#: Queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s
            FROM words
        ), tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n, any_value(a.n) AS n, any_value(b.n) AS m
            FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), edges AS MATERIALIZED (
            SELECT x, y FROM pairs WHERE 100 * both_n >= 90 * (n + m - both_n)
            UNION ALL SELECT y, x FROM pairs WHERE 100 * both_n >= 90 * (n + m - both_n)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sets
            UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
        FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = s.doc_id
    """,
    "op9_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_fill_in_middle": r"""
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                   sha256(concat('7:', doc_id)) AS h
            FROM documents
        ), drawn AS (
            SELECT *, len(lines) AS n, CAST(('0x' || h[1:8]) AS BIGINT) % (len(lines) + 1) AS a, CAST(('0x' || h[9:16]) AS BIGINT) % (len(lines) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR CAST(('0x' || h[17:24]) AS BIGINT) % 100 >= 100 THEN 'plain'
                        WHEN CAST(('0x' || h[25:32]) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), cut AS (
            SELECT doc_id, n, form, text, array_to_string(lines[1:least(a, b)], '') AS p,
                   array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(lines[greatest(a, b) + 1:], '') AS s
            FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
                      ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM cut
    """,
}


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_texts() -> dict[str, str]:
    return dict(ORACLES)
