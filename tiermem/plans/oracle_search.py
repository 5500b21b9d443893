"""SQL twins of the search operators."""

from __future__ import annotations

from tiermem.plans.views_sql import toks


def bm25_ctes(p: str) -> str:
    """CTEs <p>_lex from <p>_q(query_id, store_key, text, fetch_n) and <p>_docs(store_key, id, body)."""
    return f"""
{p}_terms AS MATERIALIZED (
  SELECT query_id, store_key, fetch_n, len(w) AS n_terms, unnest(w) AS term
  FROM (SELECT *, list_distinct({toks('text')}) AS w FROM {p}_q) x),
{p}_words AS MATERIALIZED (SELECT store_key, id, {toks('body')} AS w FROM {p}_docs),
{p}_posts AS MATERIALIZED (
  SELECT store_key, id, doc_len, term, count(*) AS tf
  FROM (SELECT store_key, id, len(w) AS doc_len, unnest(w) AS term FROM {p}_words) x
  WHERE term IN (SELECT term FROM {p}_terms) GROUP BY ALL),
{p}_df AS MATERIALIZED (SELECT store_key, term, count(*) AS df FROM {p}_posts GROUP BY ALL),
{p}_len AS MATERIALIZED (
  SELECT store_key, count(*) AS n_docs, sum(len(w)) / count(*) AS avg_len FROM {p}_words GROUP BY ALL),
{p}_lex AS MATERIALIZED (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank0, fetch_n
  FROM (
    SELECT q.query_id, q.fetch_n, p.id,
           round(sum(greatest(ln((s.n_docs - f.df + 0.5) / (f.df + 0.5)), 1e-6) * p.tf * 2.2
                 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.doc_len / s.avg_len))), 9) AS score
    FROM {p}_terms q
    JOIN {p}_posts p ON p.store_key = q.store_key AND p.term = q.term
    JOIN {p}_df f ON f.store_key = q.store_key AND f.term = q.term
    JOIN {p}_len s ON s.store_key = q.store_key
    GROUP BY q.query_id, q.fetch_n, q.n_terms, p.id HAVING count(*) = q.n_terms) b
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= fetch_n)"""


def dense(queries: str, docs: str) -> str:
    return f"""
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank0, fetch_n
  FROM (SELECT q.query_id, q.fetch_n, d.id,
               round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score
        FROM {queries} q JOIN {docs} d ON d.store_key = q.store_key
        WHERE q.embedding IS NOT NULL AND d.embedding IS NOT NULL) x
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= fetch_n"""


def fused(queries: str, lexical: str, near: str) -> str:
    return f"""
  SELECT r.query_id, q.store_key, r.id, r.rrf
  FROM (SELECT query_id, id, round(sum(1.0 / (60 + rank0)), 9) AS rrf
        FROM (SELECT query_id, id, rank0 FROM {lexical} UNION ALL SELECT query_id, id, rank0 FROM {near}) u
        GROUP BY ALL) r JOIN {queries} q ON q.query_id = r.query_id
  QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY r.rrf DESC, r.id) <= any_value(q.cut) OVER (PARTITION BY r.query_id)"""


def blended(hits: str) -> str:
    return f"""
  SELECT h.query_id, h.store_key, h.id, a.pinned,
         round(h.rrf + 0.10 * pow(0.5::DOUBLE, (1709251200 - a.created_s) / 86400.0::DOUBLE / 30.0::DOUBLE)
               + 0.15 * (CASE WHEN a.priority <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - a.priority / 100.0)) END)::DOUBLE
               + 0.05 * (CASE a.confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END)::DOUBLE, 9) AS score
  FROM {hits} h JOIN atoms a ON a.id = h.id AND a.store_key = h.store_key WHERE a.status = 'active'"""


ATOM_DOCS = "SELECT store_key, id, content AS body, embedding FROM atoms"
SCENE_DOCS = """SELECT store_key, scene_id AS id, concat_ws(chr(10), title, summary) AS body, embedding FROM scenes"""


def hybrid_ctes(prefix: str, docs: str, cut: str, factor: int, base: str = "recall_queries") -> str:
    """CTEs <prefix>_q/_docs/_lex/_den/_fused for one hybrid search."""
    p = prefix
    return f"""
{p}_q AS MATERIALIZED (SELECT *, ({cut})::BIGINT AS cut, ({cut})::BIGINT * {factor} AS fetch_n FROM {base}),
{p}_docs AS MATERIALIZED ({docs}),
{bm25_ctes(p)},
{p}_den AS MATERIALIZED ({dense(f'{p}_q', f'{p}_docs')}),
{p}_fused AS MATERIALIZED ({fused(f'{p}_q', f'{p}_lex', f'{p}_den')})"""


SEARCH_ATOMS = f"""WITH {hybrid_ctes('a', ATOM_DOCS, '10', 3)}
{blended('a_fused')}"""
