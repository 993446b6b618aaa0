"""SQL for the queries of matchings."""

from __future__ import annotations

from sparkloom.operators import matching as M
from sparkloom.plans.matchings import KINDS
from sparkloom.plans.retrieval import D2, QUERY_EVERY

_INDEX = """(SELECT 'section' AS index_name, CAST(p_size AS VARCHAR) AS key, p_partkey AS chunk_id, p_partkey AS pos FROM part
 UNION ALL SELECT 'rule', p_size || 'a', p_partkey, p_partkey FROM part WHERE p_partkey % 2 = 0)"""
_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + f"][e.label % {len(KINDS)} + 1]"
_HITS = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank, round(1 / (1 + d2), 6) AS score FROM
 (SELECT q.vec_id AS query_id, e.vec_id, {D2} AS d2, {_KIND} AS kind, e.label FROM embeddings e, embeddings q WHERE q.vec_id % {QUERY_EVERY} = 0)) WHERE rank <= 50)"""
_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(M.HIERARCHY)) + " ELSE 99 END"
_J = "(SELECT p_partkey AS external_id, p_name AS p, lower(p_type) || ' stores' AS r FROM part)"


def _any(words) -> str:
    return "(" + " OR ".join("contains(q, '" + w.replace("'", "''") + "')" for w in words) + ")"


_FUZZY = """CASE WHEN {a} = {b} THEN 1.0 WHEN {wa} = 0 OR {wb} = 0 THEN len(list_intersect({la}, {lb}))::DOUBLE / len(list_distinct(list_concat({la}, {lb})))
 ELSE ({common}::DOUBLE / {wa} + {common}::DOUBLE / {wb}) / 2 END"""


def _fuzzy(a: str, b: str) -> str:
    la, lb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    w = lambda x: f"coalesce(list_sum(list_transform(list_filter({x}, lambda t: length(t) > 2), lambda t: length(t))), 0)"
    return _FUZZY.format(a=a, b=b, la=la, lb=lb, wa=w(la), wb=w(lb), common=w(f"list_intersect({la}, {lb})"))


ORACLES = {
    "metadata_index_build": f"SELECT * FROM {_INDEX}",
    "query_probes": """SELECT p_partkey, ['section', 'section', 'rule', 'hsn', 'sac', 'form', 'register', 'council', 'court_rule', NULL][p_partkey % 10 + 1] AS index_name,
 CASE p_partkey % 10 WHEN 9 THEN NULL WHEN 2 THEN p_size || 'a' ELSE CAST(p_size AS VARCHAR) END AS key, CASE WHEN p_partkey % 10 = 0 THEN '2' END AS sub FROM part""",
    "exact_lookup": f"SELECT CASE key WHEN '7' THEN 2 ELSE 3 END AS query_id, chunk_id FROM {_INDEX} WHERE (index_name = 'section' AND key = '7') OR (index_name = 'rule' AND key = '89a')",
    "section_prefix_lookup": "SELECT p_size AS section, count(*) AS chunks, min(p_partkey) AS first FROM part WHERE p_size % 2 <> 0 OR p_partkey % 3 = 1 GROUP BY 1",
    "party_match_exact": f"""SELECT query_id, external_id, CASE min(rank) WHEN 0 THEN 'both' WHEN 1 THEN 'petitioner' ELSE 'respondent' END AS reason FROM (
 SELECT 1 AS query_id, external_id, CASE WHEN p = 'small ring' AND r = 'economy stores' THEN 0 WHEN p = 'small ring' THEN 1 ELSE 2 END AS rank FROM {_J} WHERE p = 'small ring' OR r = 'economy stores'
 UNION ALL SELECT 2, external_id, 1 FROM {_J} WHERE p = 'red widget'
 UNION ALL SELECT 3, external_id, CASE WHEN p = 'blue bolt' AND r = 'small stores' THEN 0 WHEN p = 'blue bolt' THEN 1 ELSE 2 END FROM {_J} WHERE p = 'blue bolt' OR r = 'small stores'
 UNION ALL SELECT 4, external_id, 2 FROM {_J} WHERE r = 'promo stores') GROUP BY 1, 2""",
    "party_match_substring": f"""SELECT 1 AS query_id, external_id, CASE WHEN contains(p, 'ring') THEN 'petitioner' ELSE 'respondent' END AS side FROM {_J} WHERE contains(p, 'ring') OR contains(r, 'ring')
 UNION ALL SELECT 2, external_id, CASE WHEN contains('the economy stores of all', p) THEN 'petitioner' ELSE 'respondent' END FROM {_J} WHERE contains('the economy stores of all', p) OR contains('the economy stores of all', r)""",
    "fuzzy_pair_match_top5": f"""WITH q(query_id, a, b) AS (VALUES (1, 'small ring', 'economy stores'), (2, 'blue stores', 'large bolt'), (3, 'none', 'nobody')),
s AS (SELECT query_id, external_id, {_fuzzy('a', 'p')} AS ap, {_fuzzy('a', 'r')} AS ar, {_fuzzy('b', 'p')} AS bp, {_fuzzy('b', 'r')} AS br FROM q, {_J}),
m AS (SELECT query_id, external_id, least(greatest(ap, ar), greatest(bp, br)) AS score FROM s WHERE (ap > ar) <> (bp > br) AND greatest(ap, ar) > 0),
t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, external_id) AS rank FROM t WHERE score >= CASE WHEN best >= 0.75 THEN 0.75 ELSE 0.6 END)
SELECT query_id, external_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
    "judgment_assembly": """WITH b AS (SELECT l_orderkey, string_agg(l_returnflag || ' ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS body FROM lineitem GROUP BY 1)
SELECT o_orderkey, sha256(concat_ws(chr(10), CASE WHEN o_orderstatus <> 'P' THEN 'Status: ' || o_orderstatus END, 'Priority: ' || o_orderpriority) || chr(10) || chr(10) || body) AS text_sha256 FROM orders JOIN b ON l_orderkey = o_orderkey""",
    "intent_classify": "WITH t AS (SELECT conv_id, turn, lower(text || [' how to register', ' RATE', '', ' council'][turn % 4 + 1]) AS q FROM conversations) SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in M.INTENTS) + " ELSE 'general' END AS intent FROM t",
    "mode_detect": "WITH t AS (SELECT conv_id, turn, lower(CASE WHEN turn % 3 = 0 THEN text || ' Support the NOTICE please' ELSE text END) AS q FROM conversations) SELECT conv_id, turn, CASE WHEN " + _any(M.REVENUE_SIDE) + " THEN 'in_favour' ELSE 'defensive' END AS mode FROM t",
    "primary_supporting_split": f"""WITH h AS (SELECT query_id, rank, vec_id, vec_id % 17 = 0 OR (query_id // {QUERY_EVERY} % 5 = 0 AND kind = 'judgment') OR (query_id // {QUERY_EVERY} % 5 = 1 AND kind = 'definition') OR (query_id // {QUERY_EVERY} % 5 = 4 AND kind = 'rule') AS flag FROM {_HITS})
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CASE WHEN bool_or(flag) OVER (PARTITION BY query_id) THEN flag ELSE rank <= 3 END AS primary FROM h""",
    "cosine_clamp": f"""SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0.3, least(1.0, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
 / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))))), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % {QUERY_EVERY} = 0""",
    "score_fusion_topk": f"""WITH u AS (SELECT q.vec_id AS query_id, e.vec_id, 0.95::DOUBLE AS score, 0 AS stage FROM embeddings e JOIN embeddings q ON q.label = e.label AND q.vec_id % {QUERY_EVERY} = 0
 UNION ALL SELECT query_id, vec_id, score, 1 FROM {_HITS}),
f AS (SELECT query_id, vec_id, arg_min(score, stage) AS score, min(stage) AS stage FROM u GROUP BY 1, 2)
SELECT query_id, vec_id, round(score, 6) AS score, stage, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, stage, vec_id) AS rank FROM f) WHERE rank <= 25""",
    "hierarchy_banding": f"""WITH RECURSIVE h AS (SELECT query_id, vec_id, score, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM {_HITS}),
b AS (SELECT query_id, k, score AS leader, 0 AS band FROM h WHERE k = 1
 UNION ALL SELECT h.query_id, h.k, CASE WHEN b.leader - h.score > 0.0500005 THEN h.score ELSE b.leader END, CASE WHEN b.leader - h.score > 0.0500005 THEN b.band + 1 ELSE b.band END FROM b JOIN h ON h.query_id = b.query_id AND h.k = b.k + 1)
SELECT h.query_id, h.vec_id, b.band, h.priority, CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY b.band, h.priority, h.score DESC, h.vec_id) AS INTEGER) AS rank FROM h JOIN b USING (query_id, k)""",
    "issue_rank_15_10": f"""WITH s AS (SELECT query_id, vec_id, round(CASE WHEN kind = 'judgment' THEN 40 WHEN kind = 'rule' THEN 25 ELSE 10 END
 + CASE WHEN kind = 'judgment' AND vec_id % 3 = 0 THEN 30 WHEN kind = 'judgment' AND vec_id % 3 = 1 THEN -20 ELSE 0 END + least(score * 20, 20), 6) AS score FROM {_HITS}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank, rank <= 15 AS primary FROM r WHERE rank <= 25""",
    "sibling_semi_join": """SELECT doc_id FROM documents d WHERE doc_id >= 3 AND (source IN (SELECT source FROM documents WHERE doc_id < 3) OR lang IN (SELECT lang FROM documents WHERE doc_id < 3))""",
    "unseen_only": "SELECT event_id FROM events e WHERE event_type = 'view' OR NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id)",
    "issue_merge_renumber": """WITH i AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 1 THEN 'done' ELSE '' END AS reply FROM conversations),
f AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS id FROM i UNION ALL SELECT conv_id, NULL, 'a new one', count(*) + 1 FROM i GROUP BY 1),
m AS (SELECT f.conv_id, f.id, f.text, (SELECT arg_max(o.text, o.turn) FROM i o WHERE o.conv_id = f.conv_id AND o.reply <> '' AND substr(o.text, 1, 120) = substr(f.text, 1, 120)) AS old FROM f)
SELECT conv_id, CAST(id AS INTEGER) AS id, substr(coalesce(old, text), 1, 40) AS text, CASE WHEN old IS NULL THEN '' ELSE 'done' END AS reply FROM m""",
    "issue_edit": """WITH i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, text, CASE WHEN turn % 2 = 1 THEN 'done' ELSE '' END AS reply FROM conversations),
e AS (SELECT conv_id, CASE WHEN conv_id % 4 IN (0, 3) THEN id - 2 ELSE id END AS id, text, reply FROM i WHERE conv_id % 4 = 1 OR id > 2
 UNION ALL SELECT conv_id, id, 'edited', '' FROM i WHERE conv_id % 4 = 2 AND id <= 2
 UNION ALL SELECT conv_id, greatest(count(*) - 2, 0) + 1, 'edited', '' FROM i WHERE conv_id % 4 = 0 GROUP BY 1
 UNION ALL SELECT conv_id, count(*) + 1, 'edited', '' FROM i WHERE conv_id % 4 = 1 GROUP BY 1)
SELECT conv_id, CAST(id AS INTEGER) AS id, substr(text, 1, 30) AS text, reply FROM e""",
    "document_routing": """SELECT o_orderkey, CASE WHEN NOT o_orderkey % 5 > 0 THEN 'add' WHEN o_orderkey % 7 = 0 THEN 'ask_user' WHEN o_orderstatus = 'F' THEN 'add' WHEN o_orderstatus = 'O' THEN 'new_case' ELSE 'ask_user' END AS route FROM orders""",
}
