"""The registered queries of the core library, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import spans as SP
from noteweave.functions.tables import scratch_path, settled
from noteweave.functions.text import strip
from noteweave.jobs import graphs as G
from noteweave.jobs import notes_to_chunks as N
from noteweave.jobs import oracle_graph as O
from noteweave.jobs import oracle_sql as S
from noteweave.jobs import standins as X
from noteweave.operators import annotate as A
from noteweave.operators import chunk_graph as CG
from noteweave.operators import chunks as C
from noteweave.operators import labels, sections, sentences
from noteweave.operators import merge as M
from noteweave.operators import model as U
from noteweave.operators import requests as Q
from noteweave.operators import normalize as I
from noteweave.operators import report as R
from noteweave.operators import validate as L
from noteweave.sources import notes, pack_tables
from noteweave.sources.clinical import CLINICAL_EDGES, NODE_TYPES
from noteweave.sources.packs import GENERIC, dimension, lexicon, section_rules

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return put


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.cases(read(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- keys and cases


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_file, sha256(text) AS text_hash, 'case_' || substr(sha256(text), 1, 12) AS case_id FROM documents WHERE text IS NOT NULL""")
def case_keys(spark, sf_dir):
    return notes.case_links(notes.read_cases_table(read(spark, sf_dir, "documents")).filter("raw_text IS NOT NULL"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS source_file, reason FROM (SELECT doc_id, CASE WHEN text IS NULL THEN 'null text' WHEN NOT {S.FULL('text')} THEN 'blank text' ELSE 'accepted' END AS reason FROM documents)""")
def validated_cases(spark, sf_dir):
    good, bad = notes.validate_cases(notes.read_cases_table(read(spark, sf_dir, "documents")))
    return good.select("source_file", F.lit("accepted").alias("reason")).unionByName(bad.select("source_file", "reason"))


@query(f"WITH {S.CASES} SELECT text_hash, case_id, source_file, copies FROM cases")
def distinct_cases(spark, sf_dir):
    return _cases(spark, sf_dir).select("text_hash", "case_id", "source_file", "copies")


# ---------------------------------------------------------------- sentences and labels


@query(f'WITH {S.SENTENCES} SELECT text_hash, "index", start_char, end_char, text FROM sent')
def sentence_spans(spark, sf_dir):
    return sentences.split_sentences(_cases(spark, sf_dir), GENERIC).select("text_hash", "index", "start_char", "end_char", "text")


@query(f'WITH {S.LABELS} SELECT text_hash, "index", rule_label FROM lab')
def rule_labels(spark, sf_dir):
    return labels.label_by_rules(sentences.split_sentences(_cases(spark, sf_dir), GENERIC), GENERIC).select("text_hash", "index", "rule_label")


@query(f'WITH {S.LABELS} SELECT text_hash, "index", rule_label FROM lab')
def rule_table_labels(spark, sf_dir):
    """The same labels from a table of rules, by the index of their literals."""
    return labels.label_by_rule_table(sentences.split_sentences(_cases(spark, sf_dir), GENERIC), section_rules(spark, GENERIC)).select("text_hash", "index", "rule_label")


@query(f'WITH {S.LABELS} SELECT text_hash, "index", section_id FROM inh')
def inherited_labels(spark, sf_dir):
    return N.labelled_sentences(_cases(spark, sf_dir), GENERIC).select("text_hash", "index", "section_id")


_INITIAL = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' WHEN 'system' THEN 'frame' END AS section_id, role AS reasoning FROM conversations"
_REVIEW = "SELECT conv_id, turn, CASE WHEN length(text) < 60 THEN 'remark' WHEN contains(text, '.') THEN 'answer' ELSE 'question' END AS section_id, 'length ' || length(text) AS reasoning, length(text) % 3 AS pos FROM conversations WHERE length(text) % 2 = 0"


def _proposed(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "answer").when(F.col("role") == "system", "frame")
    return t.select("conv_id", "turn", role.alias("section_id"), F.col("role").alias("reasoning"))


def _reviews(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").filter("length(text) % 2 = 0")
    return t.select("conv_id", "turn", F.when(F.length("text") < 60, "remark").when(F.contains(F.col("text"), F.lit(".")), "answer").otherwise("question").alias("section_id"),
                    F.concat(F.lit("length "), F.length("text").cast("string")).alias("reasoning"), (F.length("text") % 3).alias("pos"))


@query(f"SELECT *, CASE WHEN section_id IN ('question', 'answer') THEN 'accepted' ELSE 'rejected' END AS status FROM ({_INITIAL})")
def label_domain_check(spark, sf_dir):
    good, bad = labels.ingest_labels(_proposed(spark, sf_dir), dimension(spark, "section", ["question", "answer"]))
    return good.withColumn("status", F.lit("accepted")).unionByName(bad.withColumn("status", F.lit("rejected")))


_OVERLAY = f"""WITH i AS ({_INITIAL}), r AS (SELECT conv_id, turn, arg_max(section_id, pos) AS section_id, arg_max(reasoning, pos) AS reasoning FROM ({_REVIEW}) GROUP BY conv_id, turn),
 o AS (SELECT i.conv_id, i.turn, i.section_id AS initial_section_id, i.reasoning AS initial_reasoning, coalesce(r.section_id, i.section_id) AS reviewed_section_id, coalesce(r.reasoning, '') AS reviewed_reasoning,
              coalesce(r.section_id, i.section_id) <> i.section_id AS changed_in_review FROM i LEFT JOIN r USING (conv_id, turn))"""


@query(_OVERLAY + " SELECT * FROM o")
def label_overlay(spark, sf_dir):
    return labels.overlay_labels(_proposed(spark, sf_dir), _reviews(spark, sf_dir), ("conv_id", "turn"))


@query(_OVERLAY + " SELECT conv_id, CAST(sum(CASE WHEN changed_in_review THEN 1 ELSE 0 END) AS BIGINT) AS n_changed FROM o GROUP BY conv_id")
def changed_labels(spark, sf_dir):
    return labels.changed_counts(label_overlay(spark, sf_dir), "conv_id")


# ---------------------------------------------------------------- sections and chunks


@query(f"WITH {S.SECTIONS} SELECT text_hash, section_index, section_id, start_char, end_char, n_sentences, sentence_list, text FROM sect")
def section_spans(spark, sf_dir):
    out = N.sections_of(_cases(spark, sf_dir), GENERIC)
    return out.select("text_hash", "section_index", "section_id", "start_char", "end_char", "n_sentences", F.concat_ws(",", F.col("sentence_indices").cast("array<string>")).alias("sentence_list"), "text")


@query(f"WITH {S.SECTIONS} SELECT section_id, count(*) AS n_sections, CAST(sum(n_sentences) AS BIGINT) AS n_sentences, CAST(sum(end_char - start_char) AS BIGINT) AS n_chars FROM sect GROUP BY section_id")
def sections_by_type(spark, sf_dir):
    """The flagship: notes to sections, counted by label. One shuffle by text, then one small one."""
    rows = sections.build_sections(N.labelled_sentences(_cases(spark, sf_dir), GENERIC))
    return rows.groupBy("section_id").agg(F.count("*").alias("n_sections"), F.sum("n_sentences").cast("bigint").alias("n_sentences"), F.sum(F.col("end_char") - F.col("start_char")).cast("bigint").alias("n_chars"))


@query(f"""WITH {S.SECTIONS}, nm AS (SELECT * FROM (VALUES ('license', 'License line'), ('secret', 'Secret'), ('table', 'Table row')) AS t(section_id, section_name))
SELECT coalesce(section_name, section_id) AS section_name, count(*) AS n FROM sect LEFT JOIN nm USING (section_id) GROUP BY 1""")
def named_sections(spark, sf_dir):
    names = spark.createDataFrame([("license", "License line"), ("secret", "Secret"), ("table", "Table row")], "section_id string, section_name string")
    rows = sections.build_sections(N.labelled_sentences(_cases(spark, sf_dir), GENERIC))
    return sections.with_names(rows, names).groupBy("section_name").agg(F.count("*").alias("n"))


def _note_chunks(cases):
    return N.chunks_of(cases, GENERIC, X.rule_proposals)


def _note_stages(spark, sf_dir):
    """Notes, sentences, sections and chunks for the queries that read several of them."""
    cases, rows, parts = N.stages_of(_cases(spark, sf_dir), GENERIC)
    return cases, rows, parts, N.chunks_from(parts, rows, GENERIC, X.rule_proposals)


def _aligned(spark, sf_dir):
    _, rows, parts = N.stages_of(_cases(spark, sf_dir), GENERIC)
    return C.align_proposals(parts.filter(F.length(strip(F.col("text"))) >= C.SHORT), X.rule_proposals(rows))


@query(f"WITH {S.ALIGNED} SELECT text_hash, section_index, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(coalesce(at0 + s0, -1) AS INTEGER) AS \"start\", CAST(coalesce(at0 + e0, -1) AS INTEGER) AS \"end\" FROM ali")
def aligned_proposals(spark, sf_dir):
    good, bad = _aligned(spark, sf_dir)
    none = F.lit(-1)
    return good.select("text_hash", "section_index", "chunk_index", "start", "end").unionByName(bad.select("text_hash", "section_index", "chunk_index", none.alias("start"), none.alias("end")))


@query(f"WITH {S.CHUNKS} SELECT CAST(section_index AS INTEGER) AS section_index, text_hash, CAST(s AS INTEGER) AS \"start\", CAST(e AS INTEGER) AS \"end\", chunk_type, standalone_summary FROM mrg")
def merged_spans(spark, sf_dir):
    from noteweave.functions.spans import merge_overlaps

    good, _ = _aligned(spark, sf_dir)
    return merge_overlaps(good, ["text_hash", "section_index"], "chunk_index", ["chunk_type", "standalone_summary"])


@query(f"WITH {S.CHUNKS} SELECT * FROM chk")
def chunk_rows(spark, sf_dir):
    return _note_chunks(_cases(spark, sf_dir))


@query(f"WITH {S.CHUNKS} SELECT text_hash, section_index, count(*) FILTER (auto_filled) AS n_auto, count(*) AS n_chunks FROM chk GROUP BY text_hash, section_index")
def auto_filled_chunks(spark, sf_dir):
    return C.auto_fill_counts(_note_chunks(_cases(spark, sf_dir)))


# ---------------------------------------------------------------- annotation


def _chunks(spark, sf_dir):
    return G.line_chunks(_cases(spark, sf_dir))


def _settled_chunks(spark, sf_dir):
    return settled(_chunks(spark, sf_dir), "chunks")


_P, _M = A._PUNCTUATION.replace("'", "''"), A._MARKER


@query(f"WITH {O.LINES}, f AS (SELECT chunk_id, {S.STRIP('text')} AS t FROM chunk) SELECT chunk_id, NOT (t = '' OR regexp_matches(t, '{_P}') OR regexp_matches(t, '{_M}')) AS graphable FROM f")
def chunk_filter(spark, sf_dir):
    return A.flag_graphable(_chunks(spark, sf_dir)).select("chunk_id", "graphable")


@query(f"WITH {O.LINES}, f AS (SELECT case_id, section_index, {S.STRIP('text')} AS t FROM chunk) SELECT case_id, section_index, count(*) AS n FROM f WHERE NOT (t = '' OR regexp_matches(t, '{_P}') OR regexp_matches(t, '{_M}')) GROUP BY case_id, section_index")
def graphable_sections(spark, sf_dir):
    return A.graphable_chunks(_chunks(spark, sf_dir)).groupBy("case_id", "section_index").agg(F.count("*").alias("n"))


@query(f'WITH {O.CUES} SELECT chunk_id, s AS "start", CAST(s + length(t) AS INTEGER) AS "end", t AS text, context_type, CAST(ord AS INTEGER) AS ord FROM cue')
def context_cue_spans(spark, sf_dir):
    return A.context_cues(_chunks(spark, sf_dir), GENERIC)


@query(f'WITH {O.LEXICON} SELECT chunk_id, s AS "start", CAST(s + length(t) AS INTEGER) AS "end", t AS text, node_type, source FROM lex')
def lexicon_entity_spans(spark, sf_dir):
    return A.lexicon_spans(_chunks(spark, sf_dir), GENERIC).drop("ord")


@query(f'WITH {O.LEXICON} SELECT chunk_id, s AS "start", CAST(s + length(t) AS INTEGER) AS "end", t AS text, node_type, source FROM lex')
def lexicon_table_spans(spark, sf_dir):
    """The pack's lexicon as a table, checked and read from its rows."""
    good, _ = pack_tables.check_rules(spark.createDataFrame(pack_tables.pack_rows(GENERIC), pack_tables.SCHEMA), NODE_TYPES)
    return A.large_lexicon_spans(_chunks(spark, sf_dir), lexicon(spark, pack_tables.load_pack(good)))


_TERM = "term AS (SELECT term, CASE WHEN length(term) % 2 = 0 THEN 'EXAM_TEST' ELSE 'SIGN' END AS node_type FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS term FROM benchmark))"


@query(f"""WITH {O.LINES}, {_TERM}, occ AS (SELECT chunk_id, term, node_type, string_split(text, term) AS g FROM chunk JOIN term ON contains(text, term)),
plc AS (SELECT chunk_id, term, node_type, CAST(list_sum([length(x) FOR x IN g[1:k]]) + (k - 1) * length(term) AS INTEGER) AS s FROM occ, LATERAL (SELECT unnest(range(1, len(g))) AS k))
SELECT chunk_id, s AS "start", CAST(s + length(term) AS INTEGER) AS "end", term AS text, node_type, 'benchmark' AS source FROM plc""")
def large_lexicon_entity_spans(spark, sf_dir):
    """The words of the benchmark as a lexicon."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("term")).distinct()
    terms = words.select("term", F.when(F.length("term") % 2 == 0, "EXAM_TEST").otherwise("SIGN").alias("node_type"), F.lit("benchmark").alias("source"))
    return A.large_lexicon_spans(_chunks(spark, sf_dir), terms)


@query(f'WITH {O.SUFFIX} SELECT chunk_id, s AS "start", e AS "end", t AS text, node_type, source FROM suf')
def suffix_entity_spans(spark, sf_dir):
    return A.suffix_spans(_chunks(spark, sf_dir), GENERIC).drop("ord")


_ENT = f'WITH {O.ENTITIES} SELECT chunk_id, pos, s AS "start", e AS "end", text, node_type, source FROM ent'


@query(_ENT)
def protected_entities(spark, sf_dir):
    return A.entity_spans(_chunks(spark, sf_dir), GENERIC)


@query(f'WITH {O.ENTITIES} SELECT chunk_id, s AS "start", e AS "end", text, node_type, source FROM ent')
def contained_spans_dropped(spark, sf_dir):
    """The windowed form of the dedup inside ``protected_entities``."""
    c = _chunks(spark, sf_dir)
    return SP.drop_contained(A.lexicon_spans(c, GENERIC).unionByName(A.suffix_spans(c, GENERIC)), ["chunk_id", "node_type"], "ord").drop("ord")


@query(f"WITH {O.LINES}{O.STATUS} SELECT * FROM stat")
def status_assertion_rows(spark, sf_dir):
    return A.status_assertions(_chunks(spark, sf_dir), GENERIC)


@query(f'WITH RECURSIVE {O.NEGATION} SELECT chunk_id, CAST(s AS INTEGER) AS "start", CAST(s + length(t) AS INTEGER) AS "end", t AS text, w AS trigger, pattern FROM ng')
def negated_spans(spark, sf_dir):
    return A.negation_spans(_chunks(spark, sf_dir), GENERIC)


@query(f'WITH {O.CUES}, l AS ({O.matches("chunk", "the")}) SELECT chunk_id, s AS "start" FROM l WHERE NOT EXISTS (SELECT 1 FROM cue c WHERE c.chunk_id = l.chunk_id AND l.s >= c.s AND l.s < c.s + length(c.t))')
def points_outside_cues(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    the = A.lexicon_spans(c, GENERIC).filter("text = 'the'").select("chunk_id", "start").withColumnRenamed("start", "at")
    return SP.outside(the, A.context_cues(c, GENERIC), ["chunk_id"], "at").select("chunk_id", F.col("at").alias("start"))


@query(f'WITH {O.CUES}, l AS ({O.matches("chunk", "with [a-z]+")}), a AS (SELECT chunk_id, s, t, context_type, false AS negated, ord AS src, t AS trigger FROM cue UNION ALL SELECT chunk_id, s, t, \'negated_finding\', true, 1000, \'x\' FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, s, s + length(t) ORDER BY src, trigger) AS rn FROM a) SELECT chunk_id, s AS "start", CAST(s + length(t) AS INTEGER) AS "end", context_type, negated FROM r WHERE rn = 1')
def merged_context_spans(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    cues = A.context_cues(c, GENERIC)
    again = cues.filter("context_type = 'accompaniment'").select("chunk_id", "start", "end", "text", F.lit("x").alias("trigger"), F.lit("sequential").alias("pattern"))
    return A.all_context_spans(cues, again).select("chunk_id", "start", "end", "context_type", "negated")


_RENDERED = f"""WITH RECURSIVE {O.NEGATION}{O.ENTITIES[len(O.LINES):]}{O.STATUS},
ctx AS (SELECT chunk_id, s, length(t) AS n, t, context_type, 'False' AS negated, t AS trigger, ord AS src FROM cue UNION ALL SELECT chunk_id, s, length(t), t, 'negated_finding', 'True', w, 1000 FROM ng),
ctx1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, s, n ORDER BY src, trigger) AS rn FROM ctx) WHERE rn = 1),
la AS (SELECT chunk_id, string_agg('  - [' || t || '] → context_type=' || context_type || ', negated=' || negated || '（触发词：' || trigger || '）', chr(10) ORDER BY s, s + n) AS a FROM ctx1 GROUP BY chunk_id),
lb AS (SELECT chunk_id, string_agg('  - [' || text || '] → node_type=' || node_type || ', source=' || source, chr(10) ORDER BY s, pos) AS b FROM ent GROUP BY chunk_id),
lc AS (SELECT chunk_id, string_agg('  - [' || item_text || '] -> [' || value_text || ']（证据：' || evidence_text || coalesce('，context=' || context_text, '') || '）', chr(10) ORDER BY pos) AS c FROM stat GROUP BY chunk_id),
ann AS (SELECT chunk_id, concat_ws(chr(10), '{A._RENDER[0]}', text, '', '{A._RENDER[1]}', coalesce(a, '{A._NONE[0]}'), '', '{A._RENDER[2]}', coalesce(b, '{A._NONE[1]}'), '', '{A._RENDER[3]}', coalesce(c, '{A._NONE[2]}')) AS annotated
        FROM chunk LEFT JOIN la USING (chunk_id) LEFT JOIN lb USING (chunk_id) LEFT JOIN lc USING (chunk_id))"""


@query(_RENDERED + " SELECT * FROM ann")
def rendered_annotations(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return A.render_annotations(c, A.all_context_spans(A.context_cues(c, GENERIC), A.negation_spans(c, GENERIC)), A.entity_spans(c, GENERIC), A.status_assertions(c, GENERIC))


# ---------------------------------------------------------------- normalisation

_PROPOSED = "the [a-z]+|[a-z]{9,}"
_PROP = f"pe AS (SELECT chunk_id, t AS text, CAST(min(k) - 1 AS INTEGER) AS pos FROM ({O.matches('chunk', _PROPOSED)}) GROUP BY chunk_id, t)"
_SUP = O.ENTITIES + O.STATUS + ", " + _PROP + f""",
sup AS (SELECT chunk_id, evidence_text AS text FROM stat
        {' '.join(f"UNION SELECT chunk_id, '{t}' FROM ent WHERE contains(text, '{t}') AND text <> '{t}'" for t in GENERIC.inner_tokens)}
        UNION SELECT chunk_id, x FROM (SELECT e.chunk_id, e.text AS et, unnest(regexp_extract_all(c.text, '{I.EXTENSION}{{1,{I.EXTENSION_MOST}}}' || e.text)) AS x FROM (SELECT DISTINCT chunk_id, text FROM ent) e JOIN chunk c USING (chunk_id)) WHERE x <> et)"""


def _analysis(spark, sf_dir):
    c = _settled_chunks(spark, sf_dir)
    return c, settled(A.entity_spans(c, GENERIC), "entities"), settled(A.status_assertions(c, GENERIC), "status"), settled(I.proposed_entities(c, _PROPOSED), "proposed")


@query(f"WITH {_SUP} SELECT DISTINCT chunk_id, text FROM sup")
def suppressed_texts(spark, sf_dir):
    c, ent, stat, _ = _analysis(spark, sf_dir)
    return I.suppressed_texts(c, ent, stat, GENERIC)


_NORM = _SUP + f""",
k0 AS (SELECT chunk_id, text, pos FROM pe ANTI JOIN sup USING (chunk_id, text)),
ask AS (SELECT chunk_id, text, 1000000 + pos AS pos FROM ent UNION ALL SELECT chunk_id, '{GENERIC.subject}', 2000000 FROM chunk SEMI JOIN stat USING (chunk_id) WHERE contains(text, '{GENERIC.subject}')
        UNION ALL SELECT chunk_id, item_text, 3000000 + 2 * pos FROM stat UNION ALL SELECT chunk_id, value_text, 3000001 + 2 * pos FROM stat),
norm AS (SELECT chunk_id, text, pos FROM k0 UNION ALL SELECT chunk_id, text, min(pos) FROM ask ANTI JOIN k0 USING (chunk_id, text) GROUP BY chunk_id, text)"""


@query(f"WITH {_NORM} SELECT chunk_id, text, CAST(pos AS INTEGER) AS pos FROM norm")
def normalized_entities(spark, sf_dir):
    c, ent, stat, prop = _analysis(spark, sf_dir)
    none = spark.createDataFrame([], "chunk_id string, pos int, subject_text string, object_text string, relation string, evidence_text string, negated boolean, certainty string")
    kept, _ = I.drop_suppressed(prop, none, I.suppressed_texts(c, ent, stat, GENERIC))
    return I.insert_missing(kept, c, ent, stat, GENERIC).select("chunk_id", "text", F.col("pos").cast("int").alias("pos"))


@query(f"""WITH {_NORM},
pr AS (SELECT a.chunk_id, a.text AS s, b.text AS o, a.pos, 'next' AS r FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n FROM pe) a JOIN (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n FROM pe) b ON a.chunk_id = b.chunk_id AND b.n = a.n + 1),
pk AS (SELECT * FROM pr p WHERE NOT EXISTS (SELECT 1 FROM sup x WHERE x.chunk_id = p.chunk_id AND x.text IN (p.s, p.o))),
allr AS (SELECT chunk_id, s, o, r FROM pk
  UNION SELECT chunk_id, '{GENERIC.subject}', item_text, '患者有一般状态观察项目：' || item_text || '。' FROM stat SEMI JOIN (SELECT chunk_id FROM norm WHERE text = '{GENERIC.subject}') USING (chunk_id)
  UNION SELECT chunk_id, item_text, value_text, item_text || '的状态取值为' || value_text || '。' FROM stat
  UNION SELECT a.chunk_id, b.text, a.text, b.text || '涉及的解剖部位是' || a.text || '。' FROM ent a JOIN ent b ON a.chunk_id = b.chunk_id AND a.node_type = 'BODY_SITE' AND b.node_type = 'PROCEDURE' AND b.s - a.e BETWEEN 0 AND 2)
SELECT chunk_id, s AS subject_text, o AS object_text, r AS relation FROM allr""")
def normalized_relations(spark, sf_dir):
    from pyspark.sql import Window

    c, ent, stat, prop = _analysis(spark, sf_dir)
    w = Window.partitionBy("chunk_id").orderBy("pos")
    rel = prop.select("chunk_id", "pos", F.col("text").alias("subject_text"), F.lead("text").over(w).alias("object_text"), F.lit("next").alias("relation"), F.lit("").alias("evidence_text"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty")).filter("object_text IS NOT NULL")
    kept, rel = I.drop_suppressed(prop, rel, I.suppressed_texts(c, ent, stat, GENERIC))
    return I.add_relations(rel, I.insert_missing(kept, c, ent, stat, GENERIC), ent, stat, GENERIC).select("chunk_id", "subject_text", "object_text", "relation")


@query(f"WITH {O.ENTITIES} SELECT a.chunk_id, a.text AS l_text, a.pos AS l_pos, b.text AS r_text, b.pos AS r_pos FROM ent a JOIN ent b ON a.chunk_id = b.chunk_id AND a.node_type = 'BODY_SITE' AND b.node_type = 'PROCEDURE' AND b.s - a.e BETWEEN 0 AND 2")
def adjacent_site_pairs(spark, sf_dir):
    return I.body_site_pairs(A.entity_spans(_chunks(spark, sf_dir), GENERIC)).select("chunk_id", "l_text", "l_pos", "r_text", "r_pos")


# ---------------------------------------------------------------- overrides, anchor, checks


def _overridden(spark, sf_dir):
    """Chunks with their graphs after the overrides, in rows."""
    return settled(CG.overridden(X.proposed_rows(CG.annotated(_chunks(spark, sf_dir), GENERIC))), "overridden")


_N = "chunk_id, node_pos, node_id, node_type, source_text, negated, certainty, implicit"
_EC = ["chunk_id", "edge_pos", "edge_id", "edge_type", "source_node_id", "target_node_id", "negated", "certainty", "source_text", "reasoning", "confidence"]
_E = "chunk_id, edge_pos, edge_id, edge_type, src AS source_node_id, tgt AS target_node_id, negated, certainty, source_text, reasoning, confidence"


@query(f"WITH {O.OVERRIDES} SELECT {_N} FROM n5")
def overridden_nodes(spark, sf_dir):
    return CG.rows_of(_overridden(spark, sf_dir), "nodes")


@query(f"WITH {O.OVERRIDES} SELECT {_E} FROM e4")
def overridden_edges(spark, sf_dir):
    return CG.rows_of(_overridden(spark, sf_dir), "edges").select(_EC)


@query(f"""WITH {O.OVERRIDES}, fr AS (SELECT s.chunk_id, s.pos, s.context_text, w.src, w.tgt, e.edge_id FROM stat s JOIN wstat w ON w.chunk_id = s.chunk_id AND w.ord = s.pos LEFT JOIN e4 e ON e.chunk_id = w.chunk_id AND e.edge_type = 'STATUS_VALUE_IS' AND e.src = w.src AND e.tgt = w.tgt)
SELECT chunk_id, chunk_id || '_frame_status_1' AS frame_id, min(context_text) AS source_text, string_agg(DISTINCT edge_id, ',' ORDER BY edge_id) AS edge_list,
       (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest([f2.src, f2.tgt]) AS x FROM fr f2 WHERE f2.chunk_id = fr.chunk_id)) AS node_list
FROM fr GROUP BY chunk_id HAVING min(context_text) IS NOT NULL""")
def status_frame_rows(spark, sf_dir):
    f = CG.rows_of(_overridden(spark, sf_dir), "frames")
    return f.select("chunk_id", "frame_id", "source_text", F.concat_ws(",", "edge_ids").alias("edge_list"), F.concat_ws(",", "node_ids").alias("node_list"))


def _graph(spark, sf_dir):
    return G.checked_graph(_chunks(spark, sf_dir), GENERIC, CLINICAL_EDGES, X.proposed_rows, X.rule_verdicts)


@query(f"WITH {O.ANCHOR} SELECT {_E} FROM e6")
def anchored_edges(spark, sf_dir):
    return CG.rows_of(CG.anchored(_overridden(spark, sf_dir), CLINICAL_EDGES), "edges").select(_EC)


@query(f"WITH {O.VALID} SELECT {_N} FROM n7")
def valid_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)["nodes"]


@query(f"WITH {O.VALID} SELECT {_E}, low_confidence FROM e9")
def valid_edges(spark, sf_dir):
    return _graph(spark, sf_dir)["edges"].select(*_EC, "low_confidence")


@query(f"""WITH {O.VALID} SELECT code, count(*) AS n FROM (
 SELECT 'BOUNDARY' AS code FROM conf UNION ALL SELECT 'BOUNDARY' FROM mis UNION ALL SELECT 'ANCHOR' FROM mv WHERE moved UNION ALL SELECT 'HARD-node' FROM nv WHERE NOT good
 UNION ALL SELECT 'HARD-dangling' FROM dg WHERE reason IS NOT NULL UNION ALL SELECT 'HARD-endpoint' FROM ep WHERE NOT legal
 UNION ALL SELECT CASE v WHEN 'invalid' THEN 'SOFT-invalid' ELSE 'SOFT-low_conf' END FROM vd WHERE v <> 'valid') GROUP BY code""")
def warning_counts(spark, sf_dir):
    return L.warning_counts(_graph(spark, sf_dir)["warnings"])


@query("""SELECT o_orderkey, o_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') THEN 'source' ELSE 'target' END AS missing_end FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def dangling_order_edges(spark, sf_dir):
    """The dangling check on a large graph: an order is an edge from its customer outside the segment BUILDING to its customer with money left."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    key = lambda x: F.col(x).cast("string")
    node = lambda df, letter: df.select(key("c_custkey").alias("chunk_id"), F.concat(F.lit(letter), key("c_custkey")).alias("node_id"))
    nodes = node(c.filter("c_mktsegment <> 'BUILDING'"), "s").unionByName(node(c.filter("c_acctbal > 0"), "t"))
    edges = o.select(key("o_custkey").alias("chunk_id"), key("o_orderkey").alias("edge_id"), F.concat(F.lit("s"), key("o_custkey")).alias("source_node_id"), F.concat(F.lit("t"), key("o_custkey")).alias("target_node_id"),
                     *[F.lit(None).cast("string").alias(x) for x in ("edge_type", "certainty", "context", "source_text", "reasoning")], F.lit(0).alias("edge_pos"), F.lit(False).alias("negated"), F.lit(0.0).alias("confidence"))
    part = F.split("message", " ")
    return L.drop_dangling(nodes, edges)[1].select(part[0].cast("bigint").alias("o_orderkey"), F.expr("substring(split(message, ' ')[2], 2)").cast("bigint").alias("o_custkey"), part[1].alias("missing_end"))


@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'view' AND q.ts <= e.ts AND e.ts - q.ts <= INTERVAL 1 DAY)) AS near_event
FROM events e WHERE e.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'view' AND q.ts <= e.ts AND e.ts - q.ts <= INTERVAL 1 DAY)""")
def nearest_event_before(spark, sf_dir):
    """The as-of join with tolerance: each purchase and its user's last view within a day."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    points = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("start").alias("at"))
    spans = e.filter("event_type = 'view'").select("user_id", "start", F.col("start").alias("end"), F.col("event_id").alias("view"))
    return SP.nearest_left(points, spans, ["user_id"], "event_id", 86_400_000_000, "view").select("event_id", F.col("near_view").alias("near_event"))


# ---------------------------------------------------------------- section graphs


@query("""WITH t AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand, a.p_name AS short_text, b.p_name AS long_text FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name AND contains(b.p_name, a.p_name) AND length(b.p_name) - length(a.p_name) <= 4""")
def containment_pairs(spark, sf_dir):
    return SP.containment_pairs(read(spark, sf_dir, "part"), ["p_brand"], "p_name", 4)


@query(f"WITH {O.MERGE} SELECT DISTINCT a.case_id, a.section_index, a.source_text AS short_text, b.source_text AS long_text FROM mn a JOIN mn b ON a.case_id = b.case_id AND a.section_index = b.section_index AND a.source_text <> b.source_text AND contains(b.source_text, a.source_text) AND length(b.source_text) - length(a.source_text) <= 4")
def coreference_candidates(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return M.coreference_candidates(M.collect_nodes(g["nodes"], M.graph_order(g["rows"])))


@query(f"""WITH RECURSIVE {O.MERGE},
fb AS (SELECT case_id, section_index, source_text, arg_min(canon, (gi, node_pos)) AS canon, min(gi * 1000000 + node_pos) AS rank FROM rs GROUP BY case_id, section_index, source_text),
fp AS (SELECT a.case_id, a.section_index, a.source_text AS short, b.source_text AS long, row_number() OVER (PARTITION BY a.case_id, a.section_index ORDER BY least(a.rank, b.rank), greatest(a.rank, b.rank)) AS k
       FROM fb a JOIN fb b ON a.case_id = b.case_id AND a.section_index = b.section_index AND a.source_text <> b.source_text AND contains(b.source_text, a.source_text) AND length(b.source_text) - length(a.source_text) <= 4 AND length(b.source_text) % 2 = 0),
fold AS (SELECT case_id, section_index, long AS source_text, short AS now, k FROM fp p WHERE k = (SELECT max(k) FROM fp o WHERE o.case_id = p.case_id AND o.section_index = p.section_index AND o.long = p.long)
         UNION ALL SELECT f.case_id, f.section_index, f.source_text, p.short, p.k FROM fold f JOIN fp p ON p.case_id = f.case_id AND p.section_index = f.section_index AND p.long = f.now
         WHERE p.k = (SELECT max(o.k) FROM fp o WHERE o.case_id = f.case_id AND o.section_index = f.section_index AND o.long = f.now AND o.k < f.k)),
folded AS (SELECT case_id, section_index, source_text, arg_min(now, k) AS now FROM fold GROUP BY case_id, section_index, source_text)
SELECT rs.case_id, rs.section_index, tmp AS tmp_id, coalesce(fb.canon, rs.canon) AS canonical FROM rs LEFT JOIN folded f ON f.case_id = rs.case_id AND f.section_index = rs.section_index AND f.source_text = rs.source_text
LEFT JOIN fb ON fb.case_id = f.case_id AND fb.section_index = f.section_index AND fb.source_text = f.now""")
def coreference_folded(spark, sf_dir):
    g = _graph(spark, sf_dir)
    resolved = M.resolve_entities(M.collect_nodes(g["nodes"], M.graph_order(g["rows"])))
    verdicts = M.coreference_candidates(resolved).withColumn("are_coreferent", F.length("long_text") % 2 == 0)
    return M.apply_coreference(resolved, verdicts).select("case_id", "section_index", "tmp_id", "canonical")


def _sections(spark, sf_dir):
    return G.merged_sections(_graph(spark, sf_dir)["rows"])


@query(f"WITH {O.MERGE} SELECT can.case_id, can.section_index, can.node_id, node_type, source_text, negated, certainty, implicit, chunk_ids, merged_from FROM can JOIN mem USING (case_id, section_index, canon)")
def section_graph_nodes(spark, sf_dir):
    n = _sections(spark, sf_dir)["nodes"]
    return n.withColumns({"chunk_ids": F.concat_ws(",", "chunk_ids"), "merged_from": F.concat_ws(",", "merged_from")})


@query(f"WITH {O.MERGE} SELECT case_id, section_index, format('{{}}_sec{{:03d}}_ed{{:04d}}', case_id, section_index, no) AS edge_id, edge_type, gs AS source_node_id, gt AS target_node_id, negated, certainty, source_text, reasoning, confidence, low_confidence, chunk_ids FROM se")
def section_graph_edges(spark, sf_dir):
    e = _sections(spark, sf_dir)["edges"]
    return e.drop("edge_no", "context").withColumn("chunk_ids", F.concat_ws(",", "chunk_ids"))


@query(f"WITH {O.MERGE} SELECT case_id, section_index, gs AS source_node_id, gt AS target_node_id, arg_max(edge_type, no) AS edge_type, arg_max(confidence, no) AS confidence FROM se GROUP BY case_id, section_index, gs, gt")
def digraph(spark, sf_dir):
    return M.digraph_edges(_sections(spark, sf_dir)["edges"]).select("case_id", "section_index", "source_node_id", "target_node_id", "edge_type", "confidence")


_FR = f"""WITH {O.MERGE},
fr0 AS (SELECT s.chunk_id, min(context_text) AS source_text FROM stat s JOIN wstat w ON w.chunk_id = s.chunk_id AND w.ord = s.pos GROUP BY s.chunk_id HAVING min(context_text) IS NOT NULL),
fr AS (SELECT f.*, case_id, section_index, gi, row_number() OVER (PARTITION BY case_id, section_index ORDER BY gi) AS no FROM fr0 f JOIN ord USING (chunk_id)),
frn AS (SELECT DISTINCT f.case_id, f.section_index, f.no, f.chunk_id, i.node_id FROM fr f JOIN wstat w ON w.chunk_id = f.chunk_id JOIN idm i ON i.case_id = f.case_id AND i.section_index = f.section_index AND i.tmp IN ('g' || f.gi || '_' || w.src, 'g' || f.gi || '_' || w.tgt)),
fre AS (SELECT DISTINCT n.case_id, n.section_index, n.no, format('{{}}_sec{{:03d}}_ed{{:04d}}', n.case_id, n.section_index, se.no) AS edge_id FROM frn n JOIN se ON se.case_id = n.case_id AND se.section_index = n.section_index AND n.node_id IN (se.gs, se.gt) AND list_contains(string_split(se.chunk_ids, ','), n.chunk_id)),
frs AS (SELECT f.case_id, f.section_index, f.chunk_id || '_frame_status_1_sec_' || f.no AS frame_id, source_text,
       (SELECT string_agg(node_id, ',' ORDER BY node_id) FROM frn n WHERE n.case_id = f.case_id AND n.section_index = f.section_index AND n.no = f.no) AS node_ids,
       coalesce((SELECT string_agg(edge_id, ',' ORDER BY edge_id) FROM fre e WHERE e.case_id = f.case_id AND e.section_index = f.section_index AND e.no = f.no), '') AS edge_ids FROM fr f)"""


@query(_FR + " SELECT * FROM frs WHERE node_ids IS NOT NULL")
def section_graph_frames(spark, sf_dir):
    f = _sections(spark, sf_dir)["frames"]
    return f.select("case_id", "section_index", "frame_id", "source_text", F.concat_ws(",", "node_ids").alias("node_ids"), F.concat_ws(",", "edge_ids").alias("edge_ids"))


@query(_FR + """ SELECT case_id, section_index, count(*) AS n_nodes, count(*) FILTER (negated) AS n_negated, count(*) FILTER (implicit) AS n_implicit,
 (SELECT count(*) FROM se WHERE se.case_id = can.case_id AND se.section_index = can.section_index) AS n_edges, (SELECT count(*) FROM se WHERE se.case_id = can.case_id AND se.section_index = can.section_index AND low_confidence) AS n_low_confidence,
 (SELECT count(*) FROM frs WHERE frs.case_id = can.case_id AND frs.section_index = can.section_index AND node_ids IS NOT NULL) AS n_frames FROM can GROUP BY case_id, section_index""")
def section_summaries(spark, sf_dir):
    g = _sections(spark, sf_dir)
    return M.section_summary(g["nodes"], g["edges"], g["frames"])


# ---------------------------------------------------------------- reports and sinks

_DIM = [("section", s[0]) for s in GENERIC.sections] + [("section", "prose"), ("section", "unused"), ("chunk", "finding"), ("chunk", "event"), ("chunk", "none")]


@query(f"""WITH {S.CHUNKS}, dim(kind, name) AS (VALUES {', '.join(f"('{k}', '{n}')" for k, n in _DIM)}),
cnt AS (SELECT 'section' AS kind, section_id AS name, count(*) AS n FROM sect GROUP BY section_id UNION ALL SELECT 'chunk', chunk_type, count(*) FROM chk GROUP BY chunk_type)
SELECT kind, name, CAST(coalesce(n, 0) AS BIGINT) AS n FROM dim FULL JOIN cnt USING (kind, name)""")
def type_dictionary(spark, sf_dir):
    _, _, parts, chunks = _note_stages(spark, sf_dir)
    dim = spark.createDataFrame(_DIM, "kind string, name string")
    return R.type_counts(dim, section=(parts, "section_id"), chunk=(chunks, "chunk_type"))


@query(f"""WITH {S.CHUNKS} SELECT text_hash, CAST(length(raw_text) AS INTEGER) AS n_chars, (SELECT count(*) FROM sent s WHERE s.text_hash = c.text_hash) AS n_sentences, (SELECT count(*) FROM sect s WHERE s.text_hash = c.text_hash) AS n_sections, (SELECT count(*) FROM chk s WHERE s.text_hash = c.text_hash) AS n_chunks FROM cases c""")
def case_statistics(spark, sf_dir):
    cases, rows, parts, chunks = _note_stages(spark, sf_dir)
    return R.case_stats(cases, sentences=rows, sections=parts, chunks=chunks)


@query(f"""WITH {S.SECTIONS}, g AS (SELECT text_hash, coalesce(lag(end_char) OVER w, 0) AS s, start_char AS e FROM sent WINDOW w AS (PARTITION BY text_hash ORDER BY start_char)
 UNION ALL SELECT text_hash, coalesce((SELECT max(end_char) FROM sent s WHERE s.text_hash = c.text_hash), 0), length(raw_text) FROM cases c)
SELECT text_hash, start_char AS "start", end_char AS "end", section_id AS label FROM run UNION ALL SELECT text_hash, CAST(s AS INTEGER), CAST(e AS INTEGER), NULL FROM g WHERE s < e""")
def note_coverage(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return R.coverage(cases, N.labelled_sentences(cases, GENERIC), F.col("section_id"))


@query(f"WITH {S.CHUNKS} SELECT text_hash, section_index, count(*) AS n_chunks, string_agg(CAST(chunk_index AS VARCHAR), ', ' ORDER BY chunk_index) AS chunk_list, CAST(max(end_char) - min(start_char) AS INTEGER) AS span_length FROM chk GROUP BY text_hash, section_index")
def section_chunk_lists(spark, sf_dir):
    return R.chunk_listing(_note_chunks(_cases(spark, sf_dir)), ["text_hash", "section_index"])


@query(f"WITH {S.CHUNKS} SELECT case_id, (SELECT count(*) FROM sent s WHERE s.case_id = c.case_id) AS n_sentences, (SELECT count(*) FROM sect s WHERE s.case_id = c.case_id) AS n_sections, (SELECT count(*) FROM chk s WHERE s.case_id = c.case_id) AS n_chunks, (SELECT arg_min(text, \"index\") FROM sent s WHERE s.case_id = c.case_id) AS first_sentence FROM cases c")
def nested_case_documents(spark, sf_dir):
    """The nested documents, flattened again to counts and the first sentence."""
    cases, rows, parts, chunks = _note_stages(spark, sf_dir)
    d = notes.case_documents(cases, rows, parts, chunks)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(f"n_{c}")
    return d.select("case_id", size("sentences"), size("sections"), size("chunks"), F.expr("sentences[0].text").alias("first_sentence"))


@query(_FR + """ SELECT can.case_id, can.section_index, count(*) AS n_nodes, min(node_id) AS first_node, (SELECT count(*) FROM se WHERE se.case_id = can.case_id AND se.section_index = can.section_index) AS n_edges FROM can GROUP BY can.case_id, can.section_index""")
def nested_section_graphs(spark, sf_dir):
    g = _sections(spark, sf_dir)
    d = notes.section_graph_documents(g["nodes"], g["edges"], g["frames"])
    return d.select("case_id", "section_index", F.size("nodes").cast("bigint").alias("n_nodes"), F.expr("nodes[0].node_id").alias("first_node"), F.coalesce(F.size("edges"), F.lit(0)).cast("bigint").alias("n_edges"))


_CAT = [("PATIENT", "patient"), ("SYMPTOM", "symptom"), ("DRUG", "treatment"), ("PROCEDURE", "treatment"), ("DISEASE", "disease"), ("TIME_REF", "time"), ("BODY_SITE", "bodysite")]


@query(f"""WITH {O.MERGE}, cat(node_type, category) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _CAT)}),
nl AS (SELECT case_id, section_index, node_id, negated, certainty, implicit, node_type, CASE WHEN implicit AND node_type = 'PATIENT' THEN '患者' ELSE source_text END AS t FROM can)
SELECT case_id, section_index, 'node' AS kind, node_id AS id, CASE WHEN negated THEN '¬ ' ELSE '' END || CASE WHEN length(t) > 22 THEN substr(t, 1, 22) || '…' ELSE t END AS label,
       'node ntype-' || coalesce(category, 'unknown') || CASE WHEN negated THEN ' negated' ELSE '' END || CASE WHEN certainty IN ('suspected', 'uncertain') THEN ' uncertain' WHEN certainty = 'excluded' THEN ' excluded' ELSE '' END AS classes FROM nl LEFT JOIN cat USING (node_type)
UNION ALL SELECT case_id, section_index, 'edge', format('{{}}_sec{{:03d}}_ed{{:04d}}', case_id, section_index, no), CASE WHEN negated THEN '¬ ' WHEN low_confidence THEN '? ' ELSE '' END || edge_type,
       'edge' || CASE WHEN negated THEN ' negated' ELSE '' END || CASE WHEN low_confidence THEN ' low-conf' ELSE '' END FROM se""")
def viewer_elements(spark, sf_dir):
    g = _sections(spark, sf_dir)
    return notes.graph_elements(g["nodes"], g["edges"], spark.createDataFrame(_CAT, "node_type string, category string")).select("case_id", "section_index", "kind", "id", "label", "classes")


_TYPES = [("node", t) for t in NODE_TYPES] + [("edge", t) for t in CLINICAL_EDGES]


@query(f"""WITH {O.MERGE}, dim(kind, name) AS (VALUES {', '.join(f"('{k}', '{n}')" for k, n in _TYPES)}),
cnt AS (SELECT 'node' AS kind, node_type AS name, count(*) AS n FROM can GROUP BY node_type UNION ALL SELECT 'edge', edge_type, count(*) FROM se GROUP BY edge_type)
SELECT kind, name, CAST(coalesce(n, 0) AS BIGINT) AS n FROM dim FULL JOIN cnt USING (kind, name)""")
def graph_type_dictionary(spark, sf_dir):
    """Every node and edge type of the clinical schema with its count in the section graphs, and any other."""
    g = _sections(spark, sf_dir)
    return R.type_counts(spark.createDataFrame(_TYPES, "kind string, name string"), node=(g["nodes"], "node_type"), edge=(g["edges"], "edge_type"))


@query(f"""WITH {O.MERGE}{S.LABELS[len(S.CASES):]}, per AS (SELECT case_id, count(*) FILTER (rule_label IS NULL OR rule_label <> section_id) AS n_changed FROM inh GROUP BY case_id)
SELECT case_id, CAST(length(raw_text) AS INTEGER) AS n_chars, coalesce((SELECT n_changed FROM per p WHERE p.case_id = c.case_id), 0) AS n_changed, (SELECT count(*) FROM can n WHERE n.case_id = c.case_id) AS n_nodes, (SELECT count(*) FROM se e WHERE e.case_id = c.case_id) AS n_edges FROM cases c""")
def case_graph_statistics(spark, sf_dir):
    """Changed labels, nodes and edges of each case; a label is changed where the inherited one isn't the rule's own."""
    cases = settled(_cases(spark, sf_dir), "cases")
    keys, none = ["case_id", "index"], F.lit("")
    both = settled(N.labelled_sentences(cases, GENERIC).select(*keys, "rule_label", "section_id"), "labels")
    overlaid = labels.overlay_labels(both.select(*keys, F.coalesce("rule_label", none).alias("section_id"), none.alias("reasoning")), both.select(*keys, "section_id", none.alias("reasoning"), F.lit(0).alias("pos")))
    g = _sections(spark, sf_dir)
    return R.case_stats(cases, "case_id", changed=overlaid.filter("changed_in_review"), nodes=g["nodes"], edges=g["edges"])


@query(f"WITH {S.SECTIONS} SELECT text_hash, section_index, section_id, (SELECT string_agg('S' || x, ', ' ORDER BY CAST(x AS INTEGER)) FROM (SELECT unnest(string_split(sentence_list, ',')) AS x)) AS sentence_list, CAST(end_char - start_char AS INTEGER) AS span_length FROM sect")
def section_sentence_lists(spark, sf_dir):
    return R.section_listing(sections.build_sections(N.labelled_sentences(_cases(spark, sf_dir), GENERIC)))


@query(f"""WITH {S.CHUNKS}, g AS (SELECT text_hash, coalesce(lag(end_char) OVER w, 0) AS s, start_char AS e FROM chk WINDOW w AS (PARTITION BY text_hash ORDER BY start_char)
 UNION ALL SELECT text_hash, coalesce((SELECT max(end_char) FROM chk s WHERE s.text_hash = c.text_hash), 0), length(raw_text) FROM cases c)
SELECT text_hash, start_char AS "start", end_char AS "end", chunk_type AS label FROM chk UNION ALL SELECT text_hash, CAST(s AS INTEGER), CAST(e AS INTEGER), NULL FROM g WHERE s < e""")
def chunk_coverage(spark, sf_dir):
    cases = settled(_cases(spark, sf_dir), "cases")
    return R.coverage(cases, _note_chunks(cases), F.col("chunk_type"))


@query(f"""WITH {S.CASES}, l AS (SELECT case_id, n, ls[n] AS t, coalesce(list_sum([length(x) + 1 FOR x IN ls[1:n - 1]]), 0) AS s FROM (SELECT case_id, string_split(raw_text, chr(10)) AS ls FROM cases), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS n))
SELECT case_id, CAST(s AS INTEGER) AS start_char, CAST(s + length(t) AS INTEGER) AS end_char, CAST(row_number() OVER (PARTITION BY case_id ORDER BY s) AS INTEGER) AS "index" FROM l WHERE {S.FULL('t')}""")
def numbered_sentences(spark, sf_dir):
    """Spans from outside (here lines, each given twice) numbered."""
    lines = _cases(spark, sf_dir).select("case_id", F.explode(A.matches(F.col("raw_text"), "[^\n]+")).alias("m")).select("case_id", F.col("m.start").alias("start_char"), F.col("m.end").alias("end_char"), F.col("m.text").alias("text"))
    return sentences.number_sentences(lines.unionByName(lines)).select("case_id", "start_char", "end_char", "index")


@query(f"SELECT stage, count(*) AS n_rows, count(DISTINCT text_hash) AS n_texts FROM (SELECT CASE WHEN text IS NOT NULL AND {S.FULL('text')} THEN 'accepted' ELSE 'rejected' END AS stage, sha256(text) AS text_hash FROM documents) GROUP BY stage")
def audited_stages(spark, sf_dir):
    """Stages written for audit, and what the written table holds."""
    path = scratch_path(spark, "audit")
    good, bad = notes.validate_cases(notes.read_cases_table(read(spark, sf_dir, "documents")))
    for df, stage in ((good, "accepted"), (bad, "rejected")):
        notes.write_stage(df.select("source_file", "text_hash"), path, stage)
    return spark.read.parquet(path).groupBy("stage").agg(F.count("*").alias("n_rows"), F.countDistinct("text_hash").alias("n_texts"))


# ---------------------------------------------------------------- model calls, with stand-ins as models

_ASK = """SELECT text_hash, "index", section_id, rule_label, start_char, end_char, p.text, CAST(start_char AS VARCHAR) || ':' || CAST(end_char AS VARCHAR) || ' ' || p.text || ' | ' || raw_text AS rq FROM inh p JOIN cases USING (text_hash)"""


@query(f"""WITH {S.LABELS}, a AS ({_ASK}), b AS (SELECT *, CASE WHEN length(rq) % 7 = 0 THEN NULL WHEN length(rq) % 3 = 0 THEN 'prose' WHEN length(rq) % 3 = 1 THEN 'table' END AS said FROM a)
SELECT text_hash, "index", coalesce(said, section_id) AS section_id, CASE WHEN said IS NULL THEN 'rule' ELSE 'model' END AS "by" FROM b""")
def labels_by_model(spark, sf_dir):
    """Each sentence labelled with its whole note as context."""
    cases = settled(_cases(spark, sf_dir), "cases")
    return Q.label_sentences(sentences.split_sentences(cases, GENERIC), cases, GENERIC, dimension(spark, "section", ["prose", "table"]), X.label, "{start}:{end} {sentence} | {context}")


@query(f"""WITH {S.LABELS}, l AS (SELECT text_hash, string_agg('- S' || "index" || ' [' || start_char || ':' || end_char || '] label=`' || section_id || '`  text=' || text || '  reason=' || coalesce(rule_label, ''), chr(10) ORDER BY "index") AS x FROM inh GROUP BY text_hash),
r AS (SELECT text_hash, length('Review:' || chr(10) || x) AS n FROM l),
o AS (SELECT inh.*, "index" = 1 AND n % 2 = 0 AND n % 5 <> 0 AS said FROM inh JOIN r USING (text_hash))
SELECT text_hash, "index", section_id AS initial_section_id, coalesce(rule_label, '') AS initial_reasoning, CASE WHEN said THEN 'table' ELSE section_id END AS reviewed_section_id, CASE WHEN said THEN 'first' ELSE '' END AS reviewed_reasoning, said AND section_id <> 'table' AS changed_in_review FROM o""")
def labels_reviewed_by_model(spark, sf_dir):
    rows = settled(N.labelled_sentences(_cases(spark, sf_dir), GENERIC), "sentences")
    first = rows.select("text_hash", "index", "section_id", F.coalesce("rule_label", F.lit("")).alias("reasoning"))
    return Q.review_labels(first, rows, X.review, "Review:\n{labels}")


@query(f"""WITH {S.SECTIONS}, r AS (SELECT *, length({S.STRIP('text')}) < {C.SHORT} AS short, length('Section ' || section_id || ':' || chr(10) || text) % 9 = 0 AS lost FROM sect),
c AS (SELECT text_hash, section_index, 1 AS chunk_index, text, 'clinical_state' AS chunk_type, CASE WHEN short THEN substr({S.STRIP('text')}, 1, {C.SUMMARY}) ELSE '{C.FAILED_SUMMARY}' END AS standalone_summary FROM r WHERE short OR lost
  UNION ALL SELECT text_hash, section_index, 1, substr(text, 1, 40), 'event', 'start' FROM r WHERE NOT short AND NOT lost
  UNION ALL SELECT text_hash, section_index, 2, substr(text, 41), 'clinical_state', '{C.TAIL_SUMMARY}' FROM r WHERE NOT short AND NOT lost AND {S.FULL('substr(text, 41)')})
SELECT text_hash, section_index, CAST(chunk_index AS INTEGER) AS chunk_index, text, chunk_type, standalone_summary FROM c""")
def chunks_by_model(spark, sf_dir):
    """Sections split by a model; those it fails on stay whole."""
    parts = settled(N.sections_of(settled(_cases(spark, sf_dir), "cases"), GENERIC), "sections")
    return Q.split_sections(parts, X.split, "Section {section}:\n{text}").select("text_hash", "section_index", "chunk_index", "text", "chunk_type", "standalone_summary")


@query(_RENDERED + f""", e AS (SELECT chunk_id, length(annotated) % 8 = 0 AS lost, (length(annotated) + 55) % 11 = 0 AS unmapped, substr(annotated, 5, 8) AS s, substr(annotated, 5, 3) AS t FROM ann), m AS (SELECT * FROM e WHERE NOT lost AND NOT unmapped)
SELECT chunk_id, 'node' AS kind, 'SYMPTOM ' || s AS value FROM m UNION ALL SELECT chunk_id, 'node', 'SIGN ' || t FROM m UNION ALL SELECT chunk_id, 'edge', 'n1 ACCOMPANIED_BY n2: ' || s FROM m
UNION ALL SELECT chunk_id, 'relation', s || ' > ' || t FROM e WHERE NOT lost UNION ALL SELECT chunk_id, 'warning', '{Q.NO_GRAPH}' FROM e WHERE NOT lost AND unmapped UNION ALL SELECT chunk_id, 'warning', '{Q.NO_ANALYSIS}' FROM e WHERE lost""")
def graphs_by_model(spark, sf_dir):
    """Annotated chunks analysed by a model, and the analysis mapped to nodes and edges by another; warnings where either fails."""
    asked = settled(rendered_annotations(spark, sf_dir), "annotated")
    entities, relations, w1 = Q.analyse_chunks(asked, X.analyse, "{chunk}")
    nodes, edges, w2 = Q.map_graph(asked, entities, relations, X.build, "{chunk}\n{entities}\n{relations}")
    rows = lambda df, kind, value: df.select("chunk_id", F.lit(kind).alias("kind"), value.alias("value"))
    return (rows(nodes, "node", F.concat_ws(" ", "node_type", "source_text")).unionByName(rows(edges, "edge", F.concat(F.concat_ws(" ", "source_node_id", "edge_type", "target_node_id"), F.lit(": "), "source_text")))
            .unionByName(rows(relations, "relation", F.concat_ws(" > ", "subject_text", "object_text"))).unionByName(rows(w1.unionByName(w2), "warning", F.col("message"))))


@query("""WITH t AS (SELECT DISTINCT p_brand, p_name FROM part), p AS (SELECT a.p_brand, a.p_name AS short_text, b.p_name AS long_text, length('A: ' || a.p_name || chr(10) || 'B: ' || b.p_name) AS n FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name AND contains(b.p_name, a.p_name) AND length(b.p_name) - length(a.p_name) <= 4)
SELECT p_brand, short_text, long_text, n % 5 <> 0 AND n % 2 = 0 AS are_coreferent FROM p""")
def coreference_by_model(spark, sf_dir):
    return Q.coreference_verdicts(containment_pairs(spark, sf_dir), X.coreference, "A: {short}\nB: {long}").drop("reason")


@query(f"""WITH {O.VALID}, r AS (SELECT e.chunk_id, e.edge_id, length(e.edge_type || ' by ' || e.source_text || ' at ' || CAST(e.confidence AS VARCHAR) || ' in: ' || c.text) AS n FROM e9 e JOIN chunk c USING (chunk_id) WHERE confidence < 0.5 OR NOT contains(c.text, e.source_text))
SELECT chunk_id, edge_id, 'ok' AS status, CASE WHEN n % 3 = 0 THEN 'low_confidence' ELSE 'valid' END AS verdict, 'length ' || n AS verdict_reason FROM r""")
def reviewed_by_model(spark, sf_dir):
    """The batch call: doubtful edges as requests to a stand-in, its verdicts joined back."""
    g = _graph(spark, sf_dir)
    c = g["rows"].select("chunk_id", "text")
    asked = Q.edge_requests(L.needs_review(c, g["edges"].drop("low_confidence")), c, "{edge} by {evidence} at {confidence} in: {chunk}")
    return U.apply_model(asked, "request", X.verdict, Q.VERDICT).select("chunk_id", "edge_id", "status", "verdict", "verdict_reason")
