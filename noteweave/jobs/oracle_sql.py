"""SQL for the oracles: the same tables in DuckDB's words, as common table expressions to build on."""

from __future__ import annotations

from noteweave.functions.text import WS
from noteweave.operators.chunks import GAP_SUMMARY, SHORT, SUMMARY, TAIL_SUMMARY, TRAILING, _TRAILING_CLASS
from noteweave.sources.packs import GENERIC


def q(s: str) -> str:
    return s.replace("'", "''")


STRIP = lambda c: f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"
FULL = lambda c: f"regexp_matches({c}, '[^{WS}]')"

_hits = " ".join(
    f"WHEN {' OR '.join(f"regexp_matches(text, '{q(p)}')" for p in ps)} THEN '{name}'"
    for _, (name, _, ps) in sorted(enumerate(GENERIC.sections), key=lambda x: (-x[1][1], x[0])))

CASES = f"""
cases AS (SELECT sha256(text) AS text_hash, 'case_' || substr(sha256(text), 1, 12) AS case_id, text AS raw_text,
                 min(CAST(doc_id AS VARCHAR)) AS source_file, count(*) AS copies
          FROM documents WHERE {FULL('text')} GROUP BY text)"""

SENTENCES = CASES + f""",
tiled AS (SELECT text_hash, case_id, regexp_extract_all(raw_text, '{q(GENERIC.sentence_pattern(possessive=False))}') AS ps FROM cases),
tile AS (SELECT text_hash, case_id, i, ps[i] AS p FROM tiled, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i)),
placed AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY text_hash ORDER BY i) AS INTEGER) AS e FROM tile),
sent AS (SELECT text_hash, case_id, CAST(row_number() OVER (PARTITION BY text_hash ORDER BY i) AS INTEGER) AS "index",
                CAST(e - length(p) AS INTEGER) AS start_char, e AS end_char, p AS text FROM placed WHERE {FULL('p')})"""

LABELS = SENTENCES + f""",
lab AS (SELECT *, CASE {_hits} END AS rule_label FROM sent),
inh AS (SELECT *, coalesce(last_value(rule_label IGNORE NULLS) OVER (PARTITION BY text_hash ORDER BY "index" ROWS UNBOUNDED PRECEDING), '{GENERIC.default_first}') AS section_id FROM lab)"""

SECTIONS = LABELS + """,
run AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY text_hash ORDER BY "index" ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section_index
        FROM (SELECT *, CASE WHEN lag(section_id) OVER (PARTITION BY text_hash ORDER BY "index") IS NOT DISTINCT FROM section_id THEN 0 ELSE 1 END AS chg FROM inh)),
sect AS (SELECT text_hash, r.case_id, section_index, any_value(section_id) AS section_id, min(start_char) AS start_char, max(end_char) AS end_char,
                CAST(count(*) AS INTEGER) AS n_sentences, string_agg(CAST("index" AS VARCHAR), ',' ORDER BY "index") AS sentence_list,
                substr(any_value(raw_text), min(start_char) + 1, max(end_char) - min(start_char)) AS text
         FROM run r JOIN cases USING (text_hash) GROUP BY text_hash, r.case_id, section_index)"""

PROPOSALS = SECTIONS + """,
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash, section_index ORDER BY "index") AS k FROM run) WHERE k % 3 <> 0),
prop AS (
  SELECT text_hash, section_index, 4 * k AS chunk_index, 'p' || k || '-0' AS standalone_summary, CASE WHEN k % 2 = 0 THEN 'finding' ELSE 'event' END AS chunk_type,
         CASE WHEN k % 5 = 1 THEN regexp_replace(text, '[.!?]+$', '') || ';' WHEN k % 5 = 2 THEN '  ' || text || ' ' ELSE text END AS text FROM pk
  UNION ALL SELECT text_hash, section_index, 4 * k + 1, 'p' || k || '-1', CASE WHEN k % 2 = 0 THEN 'finding' ELSE 'event' END, substr(text, length(text) // 2 + 1) FROM pk WHERE k % 7 = 2
  UNION ALL SELECT text_hash, section_index, 4 * k + 2, 'p' || k || '-2', CASE WHEN k % 2 = 0 THEN 'finding' ELSE 'event' END, '#?' || text FROM pk WHERE k % 11 = 4)"""

_even = lambda c: STRIP(f"regexp_replace({c}, '[{WS}]+', ' ', 'g')")
_loose = lambda c: f"regexp_replace({c}, '[{q(_TRAILING_CLASS)}]+$', '')"

ALIGNED = PROPOSALS + f""",
pre AS (SELECT p.*, s.text AS st, s.start_char AS at0, {STRIP('p.text')} AS bare, {_even('p.text')} AS even, {_even('s.text')} AS seven
        FROM prop p JOIN sect s USING (text_hash, section_index) WHERE length({STRIP('s.text')}) >= {SHORT}),
pre2 AS (SELECT *, {_loose('bare')} AS loose, {_loose('even')} AS leven FROM pre),
pre3 AS (SELECT *, strpos(st, text) AS f1, strpos(st, bare) AS f2, strpos(st, loose) AS f3, strpos(st, loose) - 1 + length(loose) AS e3 FROM pre2),
ali AS (SELECT *,
          CASE WHEN f1 > 0 THEN f1 - 1 WHEN bare <> text AND f2 > 0 THEN f2 - 1 WHEN leven <> '' AND leven <> even AND contains(seven, leven) AND f3 > 0 THEN f3 - 1 END AS s0,
          CASE WHEN f1 > 0 THEN f1 - 1 + length(text) WHEN bare <> text AND f2 > 0 THEN f2 - 1 + length(bare)
               WHEN leven <> '' AND leven <> even AND contains(seven, leven) AND f3 > 0
               THEN e3 + CASE WHEN e3 < length(st) AND contains('{q(TRAILING)}', substr(st, e3 + 1, 1)) THEN 1 ELSE 0 END END AS e0
        FROM pre3)"""

CHUNKS = ALIGNED + f""",
spn AS (SELECT text_hash, section_index, chunk_index, chunk_type, standalone_summary, at0 + s0 AS s, at0 + e0 AS e FROM ali WHERE s0 IS NOT NULL),
isl AS (SELECT *, sum(new) OVER (PARTITION BY text_hash, section_index ORDER BY s, chunk_index ROWS UNBOUNDED PRECEDING) AS isle FROM (
        SELECT *, CASE WHEN max(e) OVER (PARTITION BY text_hash, section_index ORDER BY s, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s THEN 0 ELSE 1 END AS new FROM spn)),
mrg AS (SELECT text_hash, section_index, min(s) AS s, max(e) AS e, arg_min(chunk_type, (s, chunk_index)) AS chunk_type, arg_min(standalone_summary, (s, chunk_index)) AS standalone_summary
        FROM isl GROUP BY text_hash, section_index, isle),
lng AS (SELECT * FROM sect WHERE length({STRIP('text')}) >= {SHORT}),
gin AS (SELECT m.text_hash, m.section_index, coalesce(lag(m.e) OVER (PARTITION BY m.text_hash, m.section_index ORDER BY m.s), l.start_char) AS s, m.s AS e, false AS tail
        FROM mrg m JOIN lng l USING (text_hash, section_index)),
gtl AS (SELECT l.text_hash, l.section_index, coalesce(max(m.e), any_value(l.start_char)) AS s, any_value(l.end_char) AS e, true AS tail
        FROM lng l LEFT JOIN mrg m USING (text_hash, section_index) GROUP BY l.text_hash, l.section_index),
gap AS (SELECT g.*, substr(l.text, g.s - l.start_char + 1, g.e - g.s) AS t FROM (SELECT * FROM gin UNION ALL SELECT * FROM gtl) g JOIN lng l USING (text_hash, section_index) WHERE g.s < g.e),
alls AS (SELECT text_hash, section_index, s, e, chunk_type, standalone_summary, false AS auto_filled FROM mrg
         UNION ALL SELECT text_hash, section_index, s, e, 'clinical_state', CASE WHEN tail THEN '{TAIL_SUMMARY}' ELSE '{GAP_SUMMARY}' END, true FROM gap WHERE {FULL('t')}
         UNION ALL SELECT text_hash, section_index, start_char, end_char, 'clinical_state', substr({STRIP('text')}, 1, {SUMMARY}), false FROM sect WHERE length({STRIP('text')}) < {SHORT}),
num AS (SELECT *, row_number() OVER (PARTITION BY text_hash, section_index ORDER BY s, e) AS chunk_index FROM alls),
chk AS (SELECT format('{{}}_sec{{:03d}}_chk{{:03d}}', x.case_id, n.section_index, n.chunk_index) AS chunk_id, x.case_id, n.text_hash, n.section_index, x.section_id, CAST(n.chunk_index AS INTEGER) AS chunk_index,
               substr(x.text, n.s - x.start_char + 1, n.e - n.s) AS text, CAST(n.s AS INTEGER) AS start_char, CAST(n.e AS INTEGER) AS end_char, n.chunk_type, n.standalone_summary, n.auto_filled
        FROM num n JOIN sect x USING (text_hash, section_index))"""
