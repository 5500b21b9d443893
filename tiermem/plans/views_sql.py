"""The same views as portable SQL for the independent check in DuckDB."""

from __future__ import annotations

import re

TENANT = "concat('tenant', {0} % 4, ':self')"
TOKENS = (
    "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), "
    "'[^0-9A-Za-z\\x{{00C0}}-\\x{{024F}}\\x{{0400}}-\\x{{04FF}}\\x{{4E00}}-\\x{{9FFF}}]+'), "
    "lambda x: x <> '')"
)


def toks(col: str) -> str:
    return TOKENS.format(col)


VIEWS = {
    "turns": """
SELECT concat('turn-', conv_id, '-', turn) AS id, concat('tenant', conv_id % 4, ':self') AS store_key,
       concat('sess-', conv_id) AS session_id, role, text AS content,
       1704067200 + conv_id * 3600 + turn * 60 AS ts_s, turn AS turn_index,
       concat(conv_id, ':', turn) AS turn_id,
       row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS seq
FROM conversations""",
    "atoms": """
SELECT * EXCLUDE (rn) FROM (
  SELECT b.*, concat('l1-', substr(sha256(concat(type, ':', content)), 1, 24)) AS id,
         row_number() OVER (PARTITION BY store_key, type, content ORDER BY src_doc_id) AS rn
  FROM (
    SELECT d.doc_id AS src_doc_id, d.text AS content,
           concat('tenant', d.doc_id % 4, ':self') AS store_key,
           CASE d.doc_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'pattern' WHEN 2 THEN 'preference'
                             WHEN 3 THEN 'constraint' ELSE 'instruction' END AS type,
           (d.doc_id * 7) % 101 AS priority,
           CASE d.doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
           d.doc_id % 50 = 0 AS pinned,
           CASE d.doc_id % 10 WHEN 7 THEN 'superseded' WHEN 8 THEN 'merged'
                              WHEN 9 THEN 'archived' ELSE 'active' END AS status,
           1704067200 + (d.doc_id * 3600) % 5184000 AS created_s,
           e.embedding, e.label::BIGINT AS label
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id) b
) t WHERE rn = 1""",
    "atom_evidence": """
SELECT a.id AS atom_id, s.id AS stream_id, a.store_key
FROM (SELECT id, store_key, unnest(list_distinct([src_doc_id // 32, src_doc_id // 64])) AS w FROM atoms) a
JOIN turns s ON a.store_key = s.store_key AND (s.seq - 1) // 4 = a.w""",
    "scenes": """
SELECT concat('scene-', d.doc_id) AS scene_id, concat('tenant', d.doc_id % 4, ':self') AS store_key,
       CASE WHEN d.doc_id % 2 = 0 THEN 'episode' ELSE 'topic' END AS scene_kind,
       substr(d.text, 1, 60) AS title, nullif(substr(d.text, 61), '') AS summary,
       CASE WHEN d.doc_id % 20 = 15 THEN 'retired' ELSE 'active' END AS status,
       1704067200 + (d.doc_id * 1800) % 5184000 AS updated_s, e.embedding
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
    "scene_atoms": """
SELECT store_key, concat('scene-', unnest(list_distinct([src_doc_id, src_doc_id // 8 * 4 + src_doc_id % 4, src_doc_id // 12 * 4 + src_doc_id % 4]))) AS scene_id,
       id AS atom_id FROM atoms""",
    "core": """
SELECT concat('tenant', n_nationkey % 4, ':self') AS store_key,
       concat('# Profile', chr(10), string_agg(n_name, chr(10) ORDER BY n_name)) AS content
FROM nation GROUP BY 1""",
    "prev_topics": """
SELECT concat('topic:', store_key, ':', label) AS scene_id, store_key, id AS atom_id
FROM atoms WHERE status = 'active' AND type <> 'instruction' AND label IS NOT NULL""",
    "recall_queries": """
SELECT concat('q-', item_id, '-', kind) AS query_id, concat('tenant', item_id % 4, ':self') AS store_key,
       query AS text, embedding, mode,
       least(coalesce(CASE item_id % 3 WHEN 1 THEN 4000 WHEN 2 THEN 30000 END,
                      CASE mode WHEN 'auto' THEN 3500 ELSE 6000 END), 20000)::BIGINT AS budget
FROM (
  SELECT item_id, embedding, CASE WHEN item_id % 2 = 0 THEN 'explicit' ELSE 'auto' END AS mode,
         unnest(['phrase', 'rare', 'common']) AS kind,
         unnest([text, sized[len(sized)].w, list_filter(sized, lambda s: s.n >= 3)[1].w]) AS query
  FROM (SELECT b.item_id, b.text, e.embedding,
               list_sort(list_transform(list_distinct(""" + toks("b.text") + """),
                         lambda w: {'n': length(w), 'w': w})) AS sized
        FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id) x
) y""",
    "traces": """
SELECT concat('r-', event_id) AS recall_id, event_id, concat('tenant', user_id % 4, ':self') AS store_key,
       CASE WHEN event_type IN ('click', 'view') THEN 'explicit' ELSE 'auto' END AS mode,
       1704067200 + event_id * 30 AS created_s FROM events""",
    "trace_items": """
SELECT recall_id, store_key, ordinal,
       CASE WHEN ordinal <= 2 THEN 'T1' WHEN ordinal = 3 THEN 'T2' ELSE 'T3' END AS tier,
       CASE WHEN ordinal = 0 THEN 'pinned' WHEN ordinal <= 2 THEN 'ranked'
            WHEN ordinal = 3 THEN 'scene' ELSE 'core' END AS source,
       (event_id // 40 + ordinal * 3) * 4 + substr(store_key, 7, 1)::BIGINT AS item_doc_id, 40 + (event_id * 13 + ordinal * 7) % 560 AS chars,
       CASE (event_id + ordinal) % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'used' ELSE 'unused' END AS usage
FROM (SELECT *, unnest(range(0, event_id % 5 + 1)) AS ordinal FROM traces) t""",
    "trace_refs": """
SELECT i.recall_id, i.store_key, i.ordinal, i.tier, i.source, i.chars, i.usage,
       CASE i.tier WHEN 'T1' THEN coalesce(a.id, concat('gone-', i.item_doc_id))
                   WHEN 'T2' THEN concat('scene-', i.item_doc_id) ELSE 'core' END AS item_id
FROM trace_items i LEFT JOIN atoms a ON a.src_doc_id = i.item_doc_id AND a.store_key = i.store_key""",
    "passes": """
SELECT concat('pass-', o_orderkey) AS pass_id, concat('tenant', o_orderkey % 4, ':self') AS store_key,
       o_orderkey AS pass_no, 1704067200 + o_orderkey * 60 AS started_s,
       CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'done' END AS status,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0
            THEN concat('L2/L3 reconciliation incomplete: ', o_orderkey % 5 + 1, ' scene narration failure(s)')
            WHEN o_orderstatus = 'P' THEN 'malformed extraction response' END AS error,
       o_orderkey % 12 AS input_turn_count, o_orderkey % 7 AS candidate_count,
       o_orderkey // 120 AS watermark_start, o_orderkey // 120 + o_orderkey % 12 AS watermark_end
FROM orders""",
    "decisions": """
SELECT concat('pass-', l_orderkey) AS pass_id, concat('pass-', l_orderkey, '-dec-', l_linenumber) AS id,
       l_linenumber::BIGINT AS position,
       CASE part % 4 WHEN 0 THEN 'store' WHEN 1 THEN 'update' WHEN 2 THEN 'merge' ELSE 'skip' END AS action,
       (CASE part % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 + supp % 3 ELSE 0 END)::BIGINT AS n_targets,
       concat('tenant', l_orderkey % 4, ':self') AS store_key, part // 4 * 4 + l_orderkey % 4 AS atom_doc
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp
      FROM lineitem GROUP BY ALL) x""",
    "decision_targets": """
SELECT t.decision_id, t.pass_id, t.store_key, t.action, t.position, t.target_no,
       coalesce(a.id, concat('gone-', t.target_doc)) AS target_id
FROM (SELECT *, (atom_doc // 8 + target_no) * 4 + substr(store_key, 7, 1)::BIGINT AS target_doc FROM (
        SELECT id AS decision_id, pass_id, store_key, action, position, atom_doc,
             unnest(range(1, n_targets + 1)) AS target_no FROM decisions) u) t
LEFT JOIN atoms a ON a.src_doc_id = t.target_doc AND a.store_key = t.store_key""",
    "decision_rows": """
SELECT d.pass_id, d.store_key, d.id, d.position, d.action, d.n_targets,
       CASE WHEN d.action <> 'skip' THEN a.id END AS atom_id
FROM decisions d LEFT JOIN atoms a ON a.src_doc_id = d.atom_doc AND a.store_key = d.store_key""",
    "scene_effects": """
SELECT concat('pass-', l_orderkey) AS pass_id, concat('scene-', l_partkey) AS scene_id,
       CASE WHEN l_partkey % 2 = 0 THEN 'episode' ELSE 'topic' END AS scene_kind,
       CASE supp % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' WHEN 2 THEN 'retired' ELSE 'unchanged' END AS effect,
       l_partkey % 20 AS members_before, (l_partkey + supp) % 20 AS members_after,
       supp % 6 AS n_added, l_partkey % 6 AS n_removed,
       l_partkey % 3 = 0 AS summary_regenerated, supp % 3 = 0 AS embedding_regenerated
FROM (SELECT l_orderkey, l_partkey, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL) x""",
    "core_effects": """
SELECT concat('pass-', o_orderkey) AS pass_id,
       CASE o_custkey % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'regenerated' WHEN 2 THEN 'deleted' ELSE 'failed' END AS effect,
       o_custkey % 4000 AS old_chars, (o_orderkey * 37) % 4000 AS new_chars
FROM orders WHERE o_orderstatus <> 'P'""",
    "latency": """
SELECT event_id, concat('tenant', user_id % 4, ':self') AS store_key,
       1704067200 + event_id * 30 AS obs_s, value * 20 AS ms FROM events""",
    "pass_intervals": """
SELECT event_id AS pass_event_id, concat('tenant', user_id % 4, ':self') AS store_key,
       1704067200 + event_id * 30 AS start_s, 1704067200 + event_id * 30 + 120 AS end_s
FROM events WHERE event_type = 'purchase'""",
    "atom_changes": """
SELECT atom_id, store_key, change_seq, 1704067200 + src_doc_id * 60 + change_seq * 3600 AS changed_s,
       CASE WHEN (src_doc_id + change_seq) % 5 = 0 THEN 'archived'
            WHEN (src_doc_id + change_seq) % 7 = 0 THEN 'superseded' END AS new_status,
       CASE WHEN (src_doc_id + change_seq) % 3 = 0 THEN 'high' END AS new_confidence,
       CASE WHEN (src_doc_id + change_seq) % 11 = 0 THEN true END AS new_pinned,
       CASE WHEN (src_doc_id + change_seq) % 4 = 0 THEN ['seen', concat('step-', change_seq)] WHEN (src_doc_id + change_seq) % 13 = 0 THEN []::VARCHAR[] END AS new_tags
FROM (SELECT id AS atom_id, store_key, src_doc_id, unnest([1, 2, 3])::BIGINT AS change_seq FROM atoms) a""",
    "attempts": """
SELECT concat('job-', user_id, '-', event_id // 2000) AS job_id, concat('tenant', user_id % 4, ':self') AS store_key,
       CASE WHEN event_type IN ('error', 'view', 'click') THEN 'failed' WHEN event_type = 'purchase' THEN 'done'
            ELSE 'running' END AS outcome,
       event_id AS attempt_key, 1704067200 + event_id * 30 AS at_s FROM events""",
    "replies": """
SELECT src_doc_id AS reply_id, store_key,
       CASE src_doc_id % 6
         WHEN 0 THEN concat('```json', chr(10), '[{"type":"', type, '","content":"memo ', id, '","confidence":"', confidence, '"}]', chr(10), '```')
         WHEN 1 THEN '[]' WHEN 2 THEN '   ' WHEN 3 THEN 'Nothing to report.'
         WHEN 4 THEN concat('{"type":"', type, '","content":"memo ', id, '","confidence":"', confidence, '"}', chr(10), 'trailing prose')
         ELSE concat('{"type":"rumour","content":"memo ', id, '","confidence":"', confidence, '"}') END AS raw
FROM atoms""",
    "pool_members": """
SELECT concat('pool-', n_regionkey) AS pool, concat('tenant', n_nationkey % 4) AS tenant,
       min(CASE n_nationkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'read' ELSE 'readwrite' END) AS access
FROM nation GROUP BY n_regionkey, n_nationkey % 4""",
    "pool_requests": """
SELECT event_id AS request_id, concat('tenant', user_id % 4) AS tenant,
       CASE WHEN event_id % 7 = 6 THEN 'self' ELSE concat('pool-', event_id % 7) END AS pool,
       event_type IN ('purchase', 'signup') AS is_write FROM events""",
    "incoming_turns": """
SELECT copy::BIGINT * 1000000000000 + conv_id * 100000 + turn AS arrival,
       concat('turn-', conv_id, '-', turn) AS id, concat('tenant', conv_id % 4, ':self') AS store_key,
       concat('sess-', conv_id) AS session_id,
       CASE WHEN copy = 3 THEN turn + 100000 ELSE turn END AS turn_index, concat(conv_id, ':', turn) AS turn_id,
       CASE WHEN copy = 2 THEN concat(text, ' (edited)') ELSE text END AS content
FROM (SELECT *, unnest(CASE WHEN role = 'user' THEN [0, 1, 3] ELSE [0, 2] END) AS copy FROM conversations) c""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it names, directly or through other views."""
    known = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"
