"""SQL for the oracles of annotation and graphs."""

from __future__ import annotations

from noteweave.functions.text import quote
from noteweave.jobs.oracle_sql import CASES, FULL, STRIP, q
from noteweave.operators.anchor import DISEASE_RULES, DISEASES, IMPLICIT_TEXT, NEGATABLE, NODE_EDGES, PATIENT_EDGES
from noteweave.operators.annotate import lexicon_order
from noteweave.sources.clinical import CLINICAL_EDGES
from noteweave.sources.packs import GENERIC

P = GENERIC


def matches(src: str, pattern: str, extra: str = "") -> str:
    p = q(pattern)
    return (f"SELECT chunk_id, k, m[k] AS t, CAST(list_sum([length(x) FOR x IN g[1:k]]) + coalesce(list_sum([length(x) FOR x IN m[1:k-1]]), 0) AS INTEGER) AS s{extra} "
            f"FROM (SELECT chunk_id, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM {src} WHERE regexp_matches(text, '{p}')), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS k)")


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


LINES = CASES + f""",
ln AS (SELECT case_id, string_split(raw_text, chr(10)) AS ls FROM cases),
chunk AS (SELECT format('{{}}_l{{:05d}}', case_id, n) AS chunk_id, case_id, CAST((n - 1) // 5 + 1 AS INTEGER) AS section_index, CAST(n AS INTEGER) AS chunk_index, ls[n] AS text,
                 CASE WHEN n % 7 = 0 THEN 'diagnosis_entry' ELSE 'clinical_state' END AS chunk_type
          FROM ln, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS n) WHERE {FULL('ls[n]')})"""

CUES = LINES + ",\ncue AS (" + union([matches("chunk", p, f", '{kind}' AS context_type, {i} AS ord") for i, (p, kind) in enumerate(P.cues)]) + ")"

_lex = union([matches("chunk", quote(t), f", '{k}' AS node_type, '{s}' AS source, {i} AS ord") for i, (t, k, s) in enumerate(lexicon_order(P))])
_lead = "t"
for _p in P.leading:
    _lead = f"regexp_replace({_lead}, '^(?:{q(_p)})', '')"
_site = "CASE " + " ".join(f"WHEN starts_with(u, '{s}') AND length(u) > {len(s)} THEN substr(u, {len(s) + 1})" for s in sorted(P.sites, key=len, reverse=True)) + " ELSE u END"
_suf = union([matches("chunk", p, f", '{k}' AS node_type, '{s}' AS source, {len(P.lexicon) + i} AS ord") for i, (p, k, s) in enumerate(P.suffixes)])

LEXICON = LINES + f",\nlex AS ({_lex})"
SUFFIX = LINES + f""",
suf0 AS ({_suf}),
suf1 AS (SELECT *, {_lead} AS u FROM suf0),
suf2 AS (SELECT *, {_site} AS v FROM suf1),
suf AS (SELECT chunk_id, CAST(s + length(t) - length(v) AS INTEGER) AS s, CAST(s + length(t) AS INTEGER) AS e, v AS t, node_type, source, ord FROM suf2 WHERE v <> '')"""
ENTITIES = SUFFIX + f""",
lex AS ({_lex}),
ent0 AS (SELECT chunk_id, s, CAST(s + length(t) AS INTEGER) AS e, t, node_type, source, ord FROM lex UNION ALL SELECT chunk_id, s, e, t, node_type, source, ord FROM suf),
ent1 AS (SELECT *, max(e) OVER (PARTITION BY chunk_id, node_type ORDER BY s, s - e, ord, e, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ent0),
ent AS (SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY s, s - e, ord) - 1 AS INTEGER) AS pos, s, e, t AS text, node_type, source FROM ent1 WHERE reach IS NULL OR e > reach)"""

_st = []
for _i, (_p, _pairs) in enumerate(P.status):
    for _j, (_item, _value) in enumerate(_pairs):
        part = lambda x, p=_p: f"regexp_extract(t, '{q(p)}', {x[1:]})" if x.startswith("$") else f"'{x}'"
        _st.append(f"SELECT chunk_id, {_i} AS rule, k AS nth, {_j} AS pair, {part(_item)} AS item_text, {part(_value)} AS value_text, t AS evidence_text FROM ({matches('chunk', _p)})")
STATUS = f""",
st0 AS ({union(_st)}),
st1 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, item_text, value_text ORDER BY rule, nth, pair) AS rn FROM st0),
stat AS (SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY rule, nth, pair) - 1 AS INTEGER) AS pos, item_text, value_text, evidence_text,
                CASE WHEN contains(c.text, '{P.status_context}') THEN '{P.status_context}' END AS context_text
         FROM st1 JOIN chunk c USING (chunk_id) WHERE rn = 1)"""

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
RULES = ",\nrule AS (SELECT edge_type, source_type, unnest(t) AS target_type FROM (SELECT edge_type, unnest(s) AS source_type, t FROM (VALUES " + ", ".join(f"('{e}', {_list(ss)}, {_list(ts)})" for e, (ss, ts) in CLINICAL_EDGES.items()) + ") AS v(edge_type, s, t)))"

_N = P.negation
_alt = lambda words: q("|".join(map(quote, words)))
_stops = q("".join(map(quote, dict.fromkeys([*_N["boundaries"], *_N["clause_stops"]]))))
_word = r"[\p{L}\p{N}_]"
#: Negation, by its rules: every trigger's places, a walk over the clauses, the items of enumerations, single scopes.
NEGATION = CUES + f""",
trg(w, rank) AS (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(sorted(_N["triggers"], key=len, reverse=True), 1))}),
trw AS (SELECT chunk_id, text, w, rank, string_split(text, w) AS g FROM chunk JOIN trg ON contains(text, w)),
tr AS (SELECT * FROM (SELECT chunk_id, text, w, rank, k, CAST(list_sum([length(x) FOR x IN g[1:k]]) + (k - 1) * length(w) AS INTEGER) AS p FROM trw, LATERAL (SELECT unnest(range(1, len(g))) AS k))
       WHERE NOT regexp_matches(CASE WHEN p > 0 THEN substr(text, p, 1) ELSE '' END, '{_word}') AND NOT regexp_matches(substr(text, p + length(w) + 1, 1), '{_word}')),
cl0 AS (SELECT chunk_id, p, arg_min(w, rank) AS w, arg_min(body, rank) AS body FROM (SELECT *, regexp_extract(substr(text, p + length(w) + 1), '^[^{_stops}]+') AS body FROM tr) WHERE body <> '' GROUP BY chunk_id, p),
cl AS (SELECT *, p + length(w) + length(body) AS ce FROM cl0),
walk AS (SELECT chunk_id, min(p) AS p FROM cl GROUP BY chunk_id UNION ALL SELECT a.chunk_id, (SELECT min(b.p) FROM cl b WHERE b.chunk_id = a.chunk_id AND b.p >= c.ce) AS p FROM walk a JOIN cl c ON c.chunk_id = a.chunk_id AND c.p = a.p),
enu AS (SELECT cl.* FROM walk JOIN cl USING (chunk_id, p) WHERE regexp_matches(body, '{_alt([*_N["terminators"], *_N["separators"]])}') AND NOT EXISTS (SELECT 1 FROM cue c WHERE c.chunk_id = cl.chunk_id AND cl.p >= c.s AND cl.p < c.s + length(c.t))),
enh AS (SELECT *, regexp_split_to_array(regexp_split_to_array(body, '{_alt(_N["terminators"])}')[1], '{_alt(_N["separators"])}') AS g FROM enu),
eni AS (SELECT chunk_id, p, w, k, g[k] AS item, p + length(w) + coalesce(list_sum([length(x) FOR x IN g[1:k - 1]]), 0) + k - 1 AS at0 FROM enh, LATERAL (SELECT unnest(range(1, len(g) + 1)) AS k)),
en AS (SELECT chunk_id, at0 + strpos(item, {STRIP('item')}) - 1 AS s, {STRIP('item')} AS t, w, 'enumeration' AS pattern, 0 AS rank, p AS nth, k FROM eni WHERE {STRIP('item')} <> ''),
sq0 AS (SELECT tr.*, p + length(w) AS b, substr(text, p + length(w) + 1) AS rest FROM tr
        WHERE NOT EXISTS (SELECT 1 FROM cue c WHERE c.chunk_id = tr.chunk_id AND tr.p >= c.s AND tr.p < c.s + length(c.t)) AND NOT EXISTS (SELECT 1 FROM enu e WHERE e.chunk_id = tr.chunk_id AND tr.p >= e.p AND tr.p < e.ce)),
sq1 AS (SELECT *, {STRIP("substr(rest, 1, CAST(least(length(regexp_split_to_array(rest, '" + _alt([*_N["boundaries"], *_N["separators"], *_N["breakers"]]) + "')[1]), coalesce((SELECT min(o.p) FROM tr o WHERE o.chunk_id = sq0.chunk_id AND o.p >= b) - b, length(rest))) AS BIGINT))")} AS bare FROM sq0),
sq AS (SELECT chunk_id, b + strpos(rest, t) - 1 AS s, t, w, 'sequential' AS pattern, rank, k AS nth, 0 AS k FROM (SELECT *, ltrim(bare, '{q(_N["lead"])}') AS t FROM sq1) WHERE t <> ''),
ng AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, s, length(t) ORDER BY rank, nth, k) AS rn FROM (SELECT * FROM en UNION ALL SELECT * FROM sq) a
       WHERE NOT EXISTS (SELECT 1 FROM cue c WHERE c.chunk_id = a.chunk_id AND c.s = a.s AND length(c.t) = length(a.t))) WHERE rn = 1)"""

GRAPH = ENTITIES + STATUS + RULES + """,
base AS (SELECT chunk_id, text, pos, CASE WHEN pos % 3 = 0 THEN 'SYMPTOM' ELSE node_type END AS node_type FROM (SELECT chunk_id, text, min(pos) AS pos, arg_min(node_type, pos) AS node_type FROM ent GROUP BY chunk_id, text)),
hasb AS (SELECT DISTINCT chunk_id FROM base),
n00 AS (SELECT chunk_id, pos + 1 AS p, node_type, text FROM base
        UNION ALL SELECT chunk_id, 10001, 'SYMPTOM', substr(text, 2) FROM base WHERE pos = 0 AND length(text) > 2
        UNION ALL SELECT chunk_id, 10002, 'SYMPTOM', '@@missing@@' FROM chunk SEMI JOIN hasb USING (chunk_id) WHERE chunk_index % 4 = 0
        UNION ALL SELECT chunk_id, 10003, 'GENERAL_HEALTH_STATUS', evidence_text FROM stat SEMI JOIN hasb USING (chunk_id) WHERE pos = 0),
n0 AS (SELECT chunk_id, CAST(p AS INTEGER) AS node_pos, 'n' || p AS node_id, node_type, text AS source_text, p % 5 = 0 AS negated, CASE WHEN p % 4 = 0 THEN 'suspected' ELSE 'confirmed' END AS certainty, false AS implicit FROM n00),
pairb AS (SELECT b.chunk_id, b.pos + 1 AS k, b.text, t.node_type AS to_type, c.chunk_index FROM base b JOIN base t ON b.chunk_id = t.chunk_id AND t.pos = b.pos + 1 JOIN chunk c ON c.chunk_id = b.chunk_id),
e0 AS (SELECT chunk_id, CAST(k AS INTEGER) AS edge_pos, 'e' || k AS edge_id, CASE WHEN to_type = 'BODY_SITE' THEN 'LOCALIZES_TO' WHEN to_type = 'DRUG' THEN 'TREATED_WITH' WHEN k % 3 = 0 THEN 'HAS_SYMPTOM' ELSE 'ACCOMPANIED_BY' END AS edge_type,
              'n' || k AS src, 'n' || (k + 1) AS tgt, false AS negated, 'confirmed' AS certainty, CASE WHEN k % 4 = 0 THEN 'not there' ELSE text END AS source_text, 'neighbours' AS reasoning, ((k * 37 + chunk_index * 11) % 100) / 100.0::DOUBLE AS confidence FROM pairb
       UNION ALL SELECT chunk_id, 9001, 'e9001', 'ACCOMPANIED_BY', 'n1', 'n999', false, 'confirmed', 'x', 'dangling', 0.7 FROM chunk SEMI JOIN (SELECT chunk_id FROM base WHERE pos = 0 AND length(text) > 2) USING (chunk_id) WHERE chunk_index % 6 = 0)"""

_num = lambda c, letter: f"coalesce(TRY_CAST(nullif(regexp_extract({c}, '^{letter}(?:_anchor_)?([0-9]+)$', 1), '') AS INTEGER), 0)"


def append_nodes(src: str, wanted: str, out: str) -> str:
    return f""",
{out}s AS (SELECT chunk_id, max({_num('node_id', 'n')}) AS top, max(node_pos) AS last FROM {src} GROUP BY chunk_id),
{out} AS (SELECT * FROM {src} UNION ALL
  SELECT w.chunk_id, CAST(coalesce(last, 0) + w.n AS INTEGER), 'n_anchor_' || (coalesce(top, 0) + w.n), node_type, source_text, false, 'confirmed', false
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ord) AS n FROM {wanted}) w LEFT JOIN {out}s USING (chunk_id))"""


def append_edges(src: str, wanted: str, out: str) -> str:
    return f""",
{out}w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, edge_type, src, tgt ORDER BY ord) AS rn FROM {wanted}) w WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {src} x WHERE x.chunk_id = w.chunk_id AND x.edge_type = w.edge_type AND x.src = w.src AND x.tgt = w.tgt)),
{out}s AS (SELECT chunk_id, max({_num('edge_id', 'e')}) AS top, max(edge_pos) AS last FROM {src} GROUP BY chunk_id),
{out} AS (SELECT * FROM {src} UNION ALL
  SELECT w.chunk_id, CAST(coalesce(last, 0) + w.n AS INTEGER), 'e_anchor_' || (coalesce(top, 0) + w.n), edge_type, src, tgt, false, 'confirmed', source_text, reasoning, confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ord) AS n FROM {out}w) w LEFT JOIN {out}s USING (chunk_id))"""


_text_of = lambda nodes, where="TRUE": f"(SELECT chunk_id, source_text AS text, arg_max(node_id, node_pos) AS node_id FROM {nodes} WHERE {where} GROUP BY chunk_id, source_text)"

OVERRIDES = GRAPH + """,
ptype AS (SELECT chunk_id, text, arg_min(node_type, pos) AS t FROM ent GROUP BY chunk_id, text),
n1 AS (SELECT n.chunk_id, node_pos, node_id, coalesce(p.t, n.node_type) AS node_type, source_text, negated, certainty, implicit FROM n0 n LEFT JOIN ptype p ON p.chunk_id = n.chunk_id AND p.text = n.source_text),
conf AS (SELECT chunk_id, node_id, source_text FROM n0 n WHERE NOT EXISTS (SELECT 1 FROM ptype p WHERE p.chunk_id = n.chunk_id AND p.text = n.source_text)
         AND EXISTS (SELECT 1 FROM ptype p WHERE p.chunk_id = n.chunk_id AND (contains(p.text, n.source_text) OR contains(n.source_text, p.text)))),
n2 AS (SELECT * FROM n1 ANTI JOIN conf USING (chunk_id, node_id)),
e1 AS (SELECT * FROM e0 e WHERE NOT EXISTS (SELECT 1 FROM conf c WHERE c.chunk_id = e.chunk_id AND c.node_id IN (e.src, e.tgt))),
mis AS (SELECT chunk_id, arg_min(node_type, pos) AS node_type, text AS source_text, min(pos) AS ord FROM ent p WHERE NOT EXISTS (SELECT 1 FROM n2 n WHERE n.chunk_id = p.chunk_id AND n.source_text = p.text) GROUP BY chunk_id, text)""" + append_nodes("n2", "mis", "n3") + f""",
tx3 AS {_text_of('n3')},
spair AS (SELECT a.chunk_id, a.text AS site, a.pos AS lp, b.text AS proc, b.pos AS rp FROM ent a JOIN ent b ON a.chunk_id = b.chunk_id AND a.node_type = 'BODY_SITE' AND b.node_type = 'PROCEDURE' AND b.s - a.e BETWEEN 0 AND 2),
wsite AS (SELECT p.chunk_id, 'LOCALIZES_TO' AS edge_type, x.node_id AS src, y.node_id AS tgt, site || proc AS source_text, '代码规则：部位 + 受保护医学实体，补充操作与部位的定位关系。' AS reasoning, 0.92::DOUBLE AS confidence, rp * 1000 + lp AS ord
          FROM spair p JOIN tx3 x ON x.chunk_id = p.chunk_id AND x.text = p.proc JOIN tx3 y ON y.chunk_id = p.chunk_id AND y.text = p.site),
tm AS (SELECT n.chunk_id, strpos(c.text, source_text) - 1 AS s, source_text AS tt, node_id, node_pos FROM n3 n JOIN chunk c USING (chunk_id) WHERE n.node_type = 'TIME_REF' AND contains(c.text, source_text)),
nearest AS (SELECT p.chunk_id, p.pos, any_value(p.text) AS proc, arg_max(t.node_id, (t.s, t.node_pos)) AS tgt, arg_max(t.tt, (t.s, t.node_pos)) AS tt, any_value(c.text) AS ct
            FROM ent p JOIN tm t ON t.chunk_id = p.chunk_id AND t.s <= p.s AND p.s - (t.s + length(t.tt)) <= 12 JOIN chunk c ON c.chunk_id = p.chunk_id WHERE p.node_type = 'PROCEDURE' GROUP BY p.chunk_id, p.pos),
nearev AS (SELECT *, strpos(ct, tt) AS a, strpos(substr(ct, strpos(ct, tt) + length(tt)), proc) AS b FROM nearest),
wtime AS (SELECT v.chunk_id, 'OCCURS_AT' AS edge_type, x.node_id AS src, v.tgt, CASE WHEN a > 0 AND b > 0 THEN substr(ct, a, length(tt) + b - 1 + length(proc)) ELSE proc END AS source_text,
                 '代码规则：时间参照位于受保护操作实体左侧，补充操作发生时间。' AS reasoning, 0.94::DOUBLE AS confidence, 10000000 + v.pos AS ord FROM nearev v JOIN tx3 x ON x.chunk_id = v.chunk_id AND x.text = v.proc),
wanted1 AS (SELECT * FROM wsite UNION ALL SELECT * FROM wtime)""" + append_edges("e1", "wanted1", "e2") + """,
stale AS (SELECT chunk_id, node_id FROM n3 n WHERE node_type = 'GENERAL_HEALTH_STATUS' AND EXISTS (SELECT 1 FROM stat s WHERE s.chunk_id = n.chunk_id)
          AND (NOT EXISTS (SELECT 1 FROM stat s WHERE s.chunk_id = n.chunk_id AND n.source_text IN (s.item_text, s.value_text)) OR EXISTS (SELECT 1 FROM stat s WHERE s.chunk_id = n.chunk_id AND contains(s.evidence_text, n.source_text)))),
n4 AS (SELECT * FROM n3 ANTI JOIN stale USING (chunk_id, node_id)),
e3 AS (SELECT * FROM e2 e WHERE NOT EXISTS (SELECT 1 FROM stale c WHERE c.chunk_id = e.chunk_id AND c.node_id IN (e.src, e.tgt))),
wst AS (SELECT chunk_id, node_type, source_text, min(ord) AS ord FROM (SELECT chunk_id, 'GENERAL_STATUS_ITEM' AS node_type, item_text AS source_text, pos * 2 AS ord FROM stat UNION ALL SELECT chunk_id, 'GENERAL_STATUS_VALUE', value_text, pos * 2 + 1 FROM stat) w
        WHERE NOT EXISTS (SELECT 1 FROM n4 n WHERE n.chunk_id = w.chunk_id AND n.node_type = w.node_type AND n.source_text = w.source_text) GROUP BY chunk_id, node_type, source_text)""" + append_nodes("n4", "wst", "n5") + f""",
sti AS {_text_of('n5', "node_type = 'GENERAL_STATUS_ITEM'")}, stv AS {_text_of('n5', "node_type = 'GENERAL_STATUS_VALUE'")},
wstat AS (SELECT s.chunk_id, 'STATUS_VALUE_IS' AS edge_type, i.node_id AS src, v.node_id AS tgt, evidence_text AS source_text, '代码规则：一般状态断言标准化为 item-value 结构。' AS reasoning, 0.98::DOUBLE AS confidence, s.pos AS ord
          FROM stat s JOIN sti i ON i.chunk_id = s.chunk_id AND i.text = s.item_text JOIN stv v ON v.chunk_id = s.chunk_id AND v.text = s.value_text)""" + append_edges("e3", "wstat", "e4")

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_disease = " ".join(f"WHEN regexp_matches(c.text, '{q(p)}'){' OR c.chunk_type = ' + chr(39) + 'diagnosis_entry' + chr(39) if e == 'DIAGNOSED_WITH' else ''} THEN '{e}'" for p, e in DISEASE_RULES)
_plain = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NODE_EDGES.items())

ANCHOR = OVERRIDES + f""",
nopat AS (SELECT chunk_id, list(node_id) AS ids FROM n5 WHERE chunk_id NOT IN (SELECT chunk_id FROM n5 WHERE node_type = 'PATIENT') GROUP BY chunk_id),
n6 AS (SELECT * FROM n5 UNION ALL SELECT chunk_id, -1, 'n0', 'PATIENT', '{IMPLICIT_TEXT}', false, 'confirmed', true FROM nopat),
pat AS (SELECT chunk_id, arg_min(node_id, node_pos) AS patient_id FROM n6 WHERE node_type = 'PATIENT' GROUP BY chunk_id),
ty AS (SELECT chunk_id, node_id, arg_max(node_type, node_pos) AS node_type FROM n6 GROUP BY chunk_id, node_id),
mv AS (SELECT e.*, e.edge_type IN ({_in(PATIENT_EDGES)}) AND s.node_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rule r WHERE r.edge_type = e.edge_type AND r.source_type = s.node_type)
          AND EXISTS (SELECT 1 FROM rule r WHERE r.edge_type = e.edge_type AND r.source_type = 'PATIENT' AND r.target_type = t.node_type) AS moved, patient_id
       FROM e4 e LEFT JOIN ty s ON s.chunk_id = e.chunk_id AND s.node_id = e.src LEFT JOIN ty t ON t.chunk_id = e.chunk_id AND t.node_id = e.tgt LEFT JOIN pat p ON p.chunk_id = e.chunk_id),
e5 AS (SELECT chunk_id, edge_pos, edge_id, edge_type, CASE WHEN moved THEN patient_id ELSE src END AS src, tgt, negated, certainty, source_text,
              CASE WHEN moved THEN '代码规则将省略主语的 patient-centric 关系重锚到隐式患者节点；原 source=' || src || '。' || coalesce(reasoning, '') ELSE reasoning END AS reasoning, confidence FROM mv),
dflt AS (SELECT n.*, c.text AS ct, patient_id, CASE WHEN n.negated AND n.node_type IN ({_in(NEGATABLE)}) THEN 'NEGATED_FINDING' WHEN n.node_type IN ({_in(DISEASES)}) THEN CASE {_disease} END
                WHEN n.node_type = 'ALLERGY' THEN CASE WHEN regexp_matches(c.text, '无|否认|未') THEN 'NEGATED_HISTORY_OF' ELSE 'HISTORY_OF' END ELSE CASE n.node_type {_plain} END END AS edge_type
         FROM n6 n JOIN chunk c USING (chunk_id) JOIN pat USING (chunk_id) WHERE n.node_id <> patient_id),
dfl2 AS (SELECT * FROM dflt d WHERE EXISTS (SELECT 1 FROM rule r WHERE r.edge_type = d.edge_type AND r.source_type = 'PATIENT' AND r.target_type = d.node_type)
         AND NOT EXISTS (SELECT 1 FROM e5 e WHERE e.chunk_id = d.chunk_id AND e.edge_type = d.edge_type AND e.src = d.patient_id AND e.tgt = d.node_id)),
e5s AS (SELECT chunk_id, max({_num('edge_id', 'e')}) AS top, max(edge_pos) AS last FROM e5 GROUP BY chunk_id),
e6 AS (SELECT * FROM e5 UNION ALL
       SELECT w.chunk_id, CAST(coalesce(last, 0) + w.n AS INTEGER), 'e_anchor_' || (coalesce(top, 0) + w.n), edge_type, patient_id, node_id, negated OR starts_with(edge_type, 'NEGATED'), CASE WHEN starts_with(edge_type, 'NEGATED') THEN 'excluded' ELSE certainty END,
              CASE WHEN length(ct) <= 120 THEN ct ELSE source_text END, '代码规则：' || node_type || ' 节点默认归属于病例主体，补充患者锚点关系。', 0.9
       FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY node_pos) AS n FROM dfl2) w LEFT JOIN e5s USING (chunk_id))"""

VALID = ANCHOR + f""",
nv AS (SELECT n.*, n.node_type = 'PATIENT' AND (implicit OR source_text = '{IMPLICIT_TEXT}') OR contains(c.text, n.source_text) AS good FROM n6 n JOIN chunk c USING (chunk_id)),
n7 AS (SELECT * EXCLUDE (good) FROM nv WHERE good),
dg AS (SELECT e.*, CASE WHEN NOT EXISTS (SELECT 1 FROM n7 n WHERE n.chunk_id = e.chunk_id AND n.node_id = e.src) THEN edge_id || ' source ' || src
                        WHEN NOT EXISTS (SELECT 1 FROM n7 n WHERE n.chunk_id = e.chunk_id AND n.node_id = e.tgt) THEN edge_id || ' target ' || tgt END AS reason FROM e6 e),
e7 AS (SELECT * EXCLUDE (reason) FROM dg WHERE reason IS NULL),
ep AS (SELECT e.*, s.node_type AS st, t.node_type AS tt, EXISTS (SELECT 1 FROM rule r WHERE r.edge_type = e.edge_type AND r.source_type = s.node_type AND r.target_type = t.node_type) AS legal
       FROM e7 e JOIN n7 s ON s.chunk_id = e.chunk_id AND s.node_id = e.src JOIN n7 t ON t.chunk_id = e.chunk_id AND t.node_id = e.tgt),
e8 AS (SELECT * EXCLUDE (st, tt, legal) FROM ep WHERE legal),
rv AS (SELECT e.*, confidence < 0.5 OR NOT contains(c.text, e.source_text) AS review FROM e8 e JOIN chunk c USING (chunk_id)),
vd AS (SELECT *, CASE WHEN NOT review THEN 'valid' WHEN edge_pos % 2 = 0 THEN CASE edge_pos % 3 WHEN 0 THEN 'invalid' WHEN 1 THEN 'low_confidence' ELSE 'valid' END ELSE 'low_confidence' END AS v FROM rv),
e9 AS (SELECT * EXCLUDE (review, v), v = 'low_confidence' AS low_confidence FROM vd WHERE v <> 'invalid')"""

MERGE = VALID + """,
ord AS (SELECT chunk_id, case_id, section_index, dense_rank() OVER (PARTITION BY case_id, section_index ORDER BY chunk_index) - 1 AS gi FROM chunk),
mn AS (SELECT n.*, case_id, section_index, gi, 'g' || gi || '_' || node_id AS tmp FROM n7 n JOIN ord USING (chunk_id)),
rs AS (SELECT *, CASE WHEN node_type = 'PATIENT' THEN first_value(tmp) OVER (PARTITION BY case_id, section_index, node_type = 'PATIENT' ORDER BY implicit, gi, node_pos) ELSE first_value(tmp) OVER (PARTITION BY case_id, section_index, source_text ORDER BY gi, node_pos) END AS canon FROM mn),
can AS (SELECT case_id, section_index, canon, format('{}_sec{:03d}_nd{:04d}', case_id, section_index, row_number() OVER (PARTITION BY case_id, section_index ORDER BY node_type = 'PATIENT' DESC, source_text, gi, node_pos)) AS node_id, node_type, source_text, negated, certainty, implicit FROM rs WHERE tmp = canon),
mem AS (SELECT case_id, section_index, canon, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunk_ids, string_agg(tmp, ',' ORDER BY gi, node_pos) AS merged_from FROM rs GROUP BY case_id, section_index, canon),
idm AS (SELECT rs.case_id, rs.section_index, tmp, node_id FROM (SELECT case_id, section_index, tmp, canon FROM rs) rs JOIN (SELECT case_id, section_index, canon, node_id FROM can) c USING (case_id, section_index, canon)),
me AS (SELECT e.*, case_id, section_index, gi, row_number() OVER (PARTITION BY case_id, section_index ORDER BY gi, edge_pos) AS no FROM e9 e JOIN ord USING (chunk_id)),
mm AS (SELECT me.*, s.node_id AS gs, t.node_id AS gt FROM me JOIN idm s ON s.case_id = me.case_id AND s.section_index = me.section_index AND s.tmp = 'g' || gi || '_' || src JOIN idm t ON t.case_id = me.case_id AND t.section_index = me.section_index AND t.tmp = 'g' || gi || '_' || tgt),
fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, section_index, gs, gt, edge_type, negated, chunk_id ORDER BY no) AS rn FROM mm) WHERE rn = 1),
se AS (SELECT case_id, section_index, gs, gt, edge_type, negated, min(no) AS no, arg_min(certainty, no) AS certainty, arg_min(source_text, no) AS source_text, arg_min(reasoning, no) AS reasoning, max(confidence) AS confidence, arg_min(low_confidence, no) AS low_confidence, string_agg(chunk_id, ',' ORDER BY no) AS chunk_ids
       FROM fc GROUP BY case_id, section_index, gs, gt, edge_type, negated)"""
