"""Golden cases of the notes' operators (worked out by hand from the rules), and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from noteweave.functions import spans as SP
from noteweave.functions import text as TX
from noteweave.jobs import graphs as G
from noteweave.operators import anchor, annotate, chunks, labels, merge, model, normalize, overrides, requests, sections, sentences, validate
from noteweave.sources import notes
from noteweave.sources.packs import GENERIC, GENERIC_EDGES, ZH_CLINICAL, endpoint_rules


def zh(spark, *texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---------------------------------------------------------------- sources and keys


def test_read_validate_and_dedupe(spark, tmp_path):
    for name, text in (("a.txt", "主诉：咳嗽。\n平素可。"), ("b.txt", "  \n"), ("c.txt", "主诉：咳嗽。\n平素可。"), (".h.txt", "x"), ("d.md", "x")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    good, bad = notes.validate_cases(notes.read_cases(spark, str(tmp_path)))
    assert sorted(r.source_file for r in good.collect()) == ["a.txt", "c.txt"] and [r.reason for r in bad.collect()] == ["blank text"]
    one = notes.dedupe_cases(good).collect()
    assert len(one) == 1 and one[0].copies == 2 and one[0].source_file == "a.txt"
    import hashlib

    assert one[0].text_hash == hashlib.sha256("主诉：咳嗽。\n平素可。".encode()).hexdigest() and one[0].case_id == "case_" + one[0].text_hash[:12]


def test_keys(spark):
    r = spark.range(1).select(TX.chunk_key(F.lit("c"), F.lit(2), F.lit(1234)).alias("a"), TX.edge_key(F.lit("c"), F.lit(1), F.lit(7)).alias("b")).collect()[0]
    assert r.a == "c_sec002_chk1234" and r.b == "c_sec001_ed0007"
    with pytest.raises(Exception, match="index must be 1 or more"):
        spark.range(1).select(TX.node_key(F.lit("c"), F.lit(1), F.col("id").cast("int"))).collect()


def test_matches_have_exact_offsets(spark):
    rng = random.Random(1)
    import re

    texts = ["".join(rng.choice("ab日😀.\n") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("a+b?", "日", r"\.\n?"):
        for r in df.select("t", TX.matches(F.col("t"), pattern).alias("m")).collect():
            assert [(m.start, m.end, m.text) for m in r.m] == [(x.start(), x.end(), x[0]) for x in re.finditer(pattern, r.t)]


# ---------------------------------------------------------------- sentences, labels, sections


def test_sentences_labels_sections(spark):
    cases = notes.keyed(spark.createDataFrame([("既往体健。平素可！\r\n主诉：咳嗽。\n\n  \n末句", "f")], "raw_text string, source_file string"))
    s = sentences.split_sentences(cases, ZH_CLINICAL).orderBy("index").collect()
    text = "既往体健。平素可！\r\n主诉：咳嗽。\n\n  \n末句"
    assert [(r["index"], r.text) for r in s] == [(1, "既往体健。"), (2, "平素可！"), (3, "主诉：咳嗽。"), (4, "末句")]
    assert all(text[r.start_char : r.end_char] == r.text for r in s)
    lab = labels.inherit_labels(labels.label_by_rules(sentences.split_sentences(cases, ZH_CLINICAL), ZH_CLINICAL), ZH_CLINICAL)
    assert [r.section_id for r in lab.orderBy("index").collect()] == ["relevant_history", "relevant_history", "chief_complaint", "chief_complaint"]
    sec = sections.with_text(sections.build_sections(lab), cases).orderBy("section_index").collect()
    assert [(r.section_id, r.sentence_indices) for r in sec] == [("relevant_history", [1, 2]), ("chief_complaint", [3, 4])] and sec[1].text == text[11:]


def test_rule_table_gives_the_same_labels(spark):
    from noteweave.sources.packs import section_rules

    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(["见 MIT License | x", "a | b", "###", "plain", "token | x"])], "text_hash string, index int, text string")
    a = labels.label_by_rules(df, GENERIC).orderBy("index").select("rule_label").collect()
    b = labels.label_by_rule_table(df, section_rules(spark, GENERIC)).orderBy("index").select("rule_label").collect()
    assert a == b and [r.rule_label for r in a] == ["license", "table", "junk", None, "secret"]


def test_runs_become_sections(spark):
    df = spark.createDataFrame([("h", i + 1, x) for i, x in enumerate("aabba")], "k string, index int, v string")
    assert [r.island for r in SP.islands(df, ["k"], ["index"], "v").orderBy("index").collect()] == [1, 1, 2, 2, 3]


# ---------------------------------------------------------------- chunks


def section(spark, text, start=0):
    return spark.createDataFrame([("h", 1, "case_x", "s", text, start, start + len(text))], "text_hash string, section_index int, case_id string, section_id string, text string, start_char int, end_char int")


def proposals(spark, *texts):
    return spark.createDataFrame([("h", 1, i, t, f"t{i}", f"s{i}") for i, t in enumerate(texts)], "text_hash string, section_index int, chunk_index int, text string, chunk_type string, standalone_summary string")


def test_alignment_and_gap_fill(spark):
    text = "咳嗽3天，发热。其后一直在家休养未再就诊也没有服用任何药物。"
    s = section(spark, text, 10)
    good, bad = chunks.align_proposals(s, proposals(spark, "咳嗽3天；", "发热", "没有别的"))
    assert sorted(rows(good, "start", "end")) == [(10, 15), (15, 17)] and [r.text for r in bad.collect()] == ["没有别的"]
    full = chunks.build_chunks(s, proposals(spark, "咳嗽3天；", "发热", "没有别的"))
    assert sorted(rows(full, "start_char", "end_char", "auto_filled", "standalone_summary")) == [(10, 15, False, "s0"), (15, 17, False, "s1"), (17, 10 + len(text), True, chunks.TAIL_SUMMARY)]


def test_chunks_of_a_long_note(spark):
    lines = [f"line {i} of a very long note" for i in range(4_000)]
    text = "\n".join(lines)
    df = spark.createDataFrame([("h", 1, i, t, "t", "s") for i, t in enumerate(lines) if i % 2], "text_hash string, section_index int, chunk_index int, text string, chunk_type string, standalone_summary string")
    out = sorted(rows(chunks.build_chunks(section(spark, text), df), "start_char", "end_char", "text", "auto_filled"))
    assert all(text[a:b] == t for a, b, t, _ in out) and len(out) == 4_000 and sum(x[3] for x in out) == 2_000


def test_overlaps_merge_and_tail(spark):
    df = spark.createDataFrame([("h", 0, 5, 0, "a"), ("h", 3, 8, 1, "b"), ("h", 8, 10, 2, "c")], "k string, start int, end int, pos int, t string")
    m = SP.merge_overlaps(df, ["k"], "pos", ["t"])
    assert sorted(rows(m, "start", "end", "t")) == [(0, 8, "a"), (8, 10, "c")]
    frame = spark.createDataFrame([("h", 0, 14), ("i", 0, 3)], "k string, start int, end int")
    assert sorted(rows(SP.gaps(m, frame, ["k"]), "k", "start", "end", "tail")) == [("h", 10, 14, True), ("i", 0, 3, True)]


def test_span_operators_equal_brute_force(spark):
    rng = random.Random(3)
    data = []
    for k in range(40):
        for p in range(rng.randint(1, 8)):
            a = rng.randint(0, 20)
            data.append((k, a, a + rng.randint(0, 6), p, rng.choice("xy")))
    df = spark.createDataFrame(data, "k int, start int, end int, pos int, t string")
    want, kept = [], []
    for k in range(40):
        own = sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[3]))
        out = []
        for _, a, e, p, t in own:
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
            else:
                out.append((a, e, t))
        want += [(k, *x) for x in out]
        for t in "xy":
            seen = []
            for x in sorted((x for x in own if x[4] == t), key=lambda x: (x[1], x[1] - x[2], x[3])):
                if not any(y[1] <= x[1] and x[2] <= y[2] for y in seen):
                    seen.append(x)
            kept += seen
    assert sorted(rows(SP.merge_overlaps(df, ["k"], "pos", ["t"]), "k", "start", "end", "t")) == sorted(want)
    assert sorted(rows(SP.drop_contained(df, ["k", "t"], "pos"), "k", "start", "end", "pos", "t")) == sorted(kept)


def test_chunks_cover_their_sections(spark):
    text = "第一句话比较长一些。第二句话，也很长很长。" + "第三句话在这里结束了。第四句！"
    s = section(spark, text).unionByName(section(spark, "短。").withColumn("section_index", F.lit(2)))
    out = chunks.build_chunks(s, proposals(spark, "第二句话，也很长", "第三句话", "第三句话在")).collect()
    long = sorted((r for r in out if r.section_index == 1), key=lambda r: r.chunk_index)
    assert "".join(r.text for r in long) == text and [r.chunk_index for r in long] == list(range(1, len(long) + 1))
    assert all(x.end_char == y.start_char for x, y in zip(long, long[1:], strict=False)) and long[0].chunk_id == "case_x_sec001_chk001"
    assert [(r.text, r.standalone_summary) for r in out if r.section_index == 2] == [("短。", "短。")]
    failed = chunks.build_chunks(s, proposals(spark), spark.createDataFrame([("h", 1)], "text_hash string, section_index int")).filter("section_index = 1").collect()
    assert [(r.text, r.standalone_summary) for r in failed] == [(text, chunks.FAILED_SUMMARY)]


# ---------------------------------------------------------------- annotation


def test_fragments(spark):
    got = [r.graphable for r in annotate.flag_graphable(zh(spark, "A1.", "2.", "，", "三、", "C", "CT", "患者,女,77岁", " ", "A1 )")).orderBy("chunk_id").collect()]
    assert got == [False] * 5 + [True, True, False, False]


@pytest.mark.parametrize("text, want", [
    ("无明显诱因出现咳嗽，无发热。", {(11, 13, "发热", "无", "sequential")}),
    ("无午后低热、乏力、盗汗等不适。", {(1, 5, "午后低热", "无", "enumeration"), (6, 8, "乏力", "无", "enumeration"), (9, 11, "盗汗", "无", "enumeration")}),
    ("胸片未见异常。", {(3, 6, "见异常", "未", "sequential"), (4, 6, "异常", "未见", "sequential")}),
    ("无发热，但有咳嗽。", {(1, 3, "发热", "无", "sequential")}),
])
def test_negation(spark, text, want):
    assert set(rows(annotate.negation_spans(zh(spark, text), ZH_CLINICAL), "start", "end", "text", "trigger", "pattern")) == want


def test_longest_trigger_only(spark):
    assert rows(annotate.negation_spans(zh(spark, "胸片未见异常。"), ZH_CLINICAL, longest_only=True), "text") == [("异常",)]


def test_cues_and_entities(spark):
    assert rows(annotate.context_cues(zh(spark, "无明显诱因出现咳嗽，无发热。"), ZH_CLINICAL), "start", "end", "text", "context_type") == [(0, 5, "无明显诱因", "absence_trigger")]
    ent = annotate.entity_spans(zh(spark, "40年前左下肢骨折固定术"), ZH_CLINICAL)
    assert rows(ent, "start", "end", "text", "node_type", "source") == [(4, 7, "左下肢", "BODY_SITE", "body_site_lexicon"), (7, 12, "骨折固定术", "PROCEDURE", "medical_lexicon")]
    assert rows(normalize.body_site_pairs(ent), "l_text", "r_text") == [("左下肢", "骨折固定术")]
    assert rows(annotate.entity_spans(zh(spark, "口服沙库巴曲缬沙坦片 2片/次 1次/日"), ZH_CLINICAL), "start", "end", "text", "node_type", "source") == [(2, 10, "沙库巴曲缬沙坦片", "DRUG", "medical_lexicon")]


def test_status_assertions(spark):
    df = annotate.status_assertions(zh(spark, "病程中，患者神志清，精神可，饮食睡眠、大小便正常，体重无明显变化"), ZH_CLINICAL).orderBy("pos")
    assert rows(df, "item_text", "value_text") == [("神志", "清"), ("精神", "可"), ("大小便", "正常"), ("饮食", "正常"), ("睡眠", "正常"), ("体重", "无明显变化")] or sorted(rows(df, "item_text", "value_text")) == sorted([("神志", "清"), ("精神", "可"), ("大小便", "正常"), ("饮食", "正常"), ("睡眠", "正常"), ("体重", "无明显变化")])
    assert {r.context_text for r in df.collect()} == {"病程中"}


def test_rendering(spark):
    c = zh(spark, "无发热。")
    none = annotate.entity_spans(c, ZH_CLINICAL), annotate.status_assertions(c, ZH_CLINICAL)
    spans = annotate.all_context_spans(annotate.context_cues(c, ZH_CLINICAL), annotate.negation_spans(c, ZH_CLINICAL))
    out = annotate.render_annotations(c, spans, *none).collect()[0].annotated.split("\n")
    assert out[:2] == ["原文：", "无发热。"] and out[4] == "  - [发热] → context_type=negated_finding, negated=True（触发词：无）" and out[7] == "  - （无）" and out[-1] == "  - （无）"


def test_suppressed_texts_and_normalisation(spark):
    c = zh(spark, "左下肢骨折固定术，患者神志清")
    ent, status = annotate.entity_spans(c, ZH_CLINICAL), annotate.status_assertions(c, ZH_CLINICAL)
    sup = {r.text for r in normalize.suppressed_texts(c, ent, status, ZH_CLINICAL).collect()}
    assert {"骨折", "固定术", "左下肢骨折固定术", "神志清"} <= sup
    given = spark.createDataFrame([("c0", 0, "骨折", "d", False, "confirmed"), ("c0", 1, "咳嗽", "d", False, "confirmed")], "chunk_id string, pos int, text string, description string, negated boolean, certainty string")
    rel = spark.createDataFrame([("c0", 0, "骨折", "咳嗽", "r", "e", False, "confirmed"), ("c0", 1, "咳嗽", "咳嗽", "r", "e", False, "confirmed")], "chunk_id string, pos int, subject_text string, object_text string, relation string, evidence_text string, negated boolean, certainty string")
    kept, rel = normalize.drop_suppressed(given, rel, normalize.suppressed_texts(c, ent, status, ZH_CLINICAL))
    full = normalize.insert_missing(kept, c, ent, status, ZH_CLINICAL)
    assert [r.text for r in full.orderBy("pos").collect()] == ["咳嗽", "左下肢", "骨折固定术", "患者", "神志", "清"]
    got = {(r.subject_text, r.object_text) for r in normalize.add_relations(rel, full, ent, status, ZH_CLINICAL).collect()}
    assert got == {("咳嗽", "咳嗽"), ("患者", "神志"), ("神志", "清"), ("骨折固定术", "左下肢")}


# ---------------------------------------------------------------- graphs

NODES = "chunk_id string, node_pos int, node_id string, node_type string, source_text string, negated boolean, certainty string, implicit boolean"
EDGES = "chunk_id string, edge_pos int, edge_id string, edge_type string, source_node_id string, target_node_id string, negated boolean, certainty string, context string, source_text string, reasoning string, confidence double"
ZH_EDGES = GENERIC_EDGES | {"NEGATED_FINDING": (("PATIENT",), ("SYMPTOM", "DISEASE"))}


def chunk(spark, text, kind="clinical_state"):
    return spark.createDataFrame([("c0", text, kind)], "chunk_id string, text string, chunk_type string")


def node(pos, i, kind, text, negated=False):
    return ("c0", pos, i, kind, text, negated, "confirmed", False)


def edge(pos, i, kind, s, t, text="咳嗽", confidence=0.8):
    return ("c0", pos, i, kind, s, t, False, "confirmed", None, text, "why", confidence)


def test_anchor(spark):
    nodes, edges, _ = anchor.anchor(chunk(spark, "咳嗽"), spark.createDataFrame([node(1, "n1", "SYMPTOM", "咳嗽")], NODES), spark.createDataFrame([], EDGES), endpoint_rules(spark, ZH_EDGES))
    assert sorted(rows(nodes, "node_pos", "node_id", "node_type", "source_text", "implicit")) == [(-1, "n0", "PATIENT", "__PATIENT__", True), (1, "n1", "SYMPTOM", "咳嗽", False)]
    assert rows(edges, "edge_id", "edge_type", "source_node_id", "target_node_id", "confidence", "source_text") == [("e_anchor_1", "HAS_SYMPTOM", "n0", "n1", 0.9, "咳嗽")]


def test_anchor_takes_a_free_id_and_moves_edges(spark):
    rules = endpoint_rules(spark, ZH_EDGES)
    ns = spark.createDataFrame([node(1, "n0", "SYMPTOM", "咳嗽"), node(2, "n2", "PROCEDURE", "术")], NODES)
    nodes, edges, warned = anchor.anchor(chunk(spark, "咳嗽术"), ns, spark.createDataFrame([edge(1, "e7", "HAS_SYMPTOM", "n2", "n0")], EDGES), rules)
    assert ("n_patient_0",) in rows(nodes, "node_id") and warned.count() == 1
    assert sorted(rows(edges, "edge_id", "edge_type", "source_node_id")) == [("e7", "HAS_SYMPTOM", "n_patient_0"), ("e_anchor_8", "UNDERWENT", "n_patient_0")]


def test_disease_edge_order(spark):
    _, edges, _ = anchor.anchor(chunk(spark, "否认肝炎病史，既往高血压"), spark.createDataFrame([node(1, "n1", "DISEASE", "高血压")], NODES), spark.createDataFrame([], EDGES), endpoint_rules(spark, ZH_EDGES))
    assert rows(edges, "edge_type", "negated", "certainty") == [("NEGATED_FINDING", True, "excluded")]


def test_checks_and_verdicts(spark):
    c = chunk(spark, "咳嗽 阿司匹林")
    ns = spark.createDataFrame([node(1, "n1", "SYMPTOM", "咳嗽"), node(2, "n2", "DRUG", "阿司匹林"), node(3, "n3", "SYMPTOM", "发热")], NODES)
    es = spark.createDataFrame([edge(1, "e1", "RELATED_TO", "n1", "n2"), edge(2, "e2", "RELATED_TO", "n3", "n2"), edge(3, "e3", "HAS_SYMPTOM", "n1", "n2"), edge(4, "e4", "RELATED_TO", "n2", "n1", confidence=0.5), edge(5, "e5", "TREATED_WITH", "n1", "n2", confidence=0.4), edge(6, "e6", "RELATED_TO", "n1", "n1", text="无")], EDGES)
    ns, w1 = validate.check_nodes(c, ns)
    es, w2 = validate.drop_dangling(ns, es)
    es, w3 = validate.check_endpoints(ns, es, endpoint_rules(spark, GENERIC_EDGES))
    assert [rows(w, "code", "message") for w in (w1, w2)] == [[("HARD-node", "n3")], [("HARD-dangling", "e2 source n3")]] and w3.count() == 1
    review = validate.needs_review(c, es)
    assert sorted(rows(review, "edge_id")) == [("e5",), ("e6",)]
    out, _ = validate.apply_verdicts(es, review, spark.createDataFrame([("c0", "e5", "invalid", "r"), ("c0", "e1", "invalid", "r")], "chunk_id string, edge_id string, verdict string, verdict_reason string"))
    assert sorted(rows(out, "edge_id", "low_confidence")) == [("e1", False), ("e4", False), ("e6", True)]


def test_overrides(spark):
    text = "3天前左下肢骨折固定术，病程中神志清"
    c = zh(spark, text)
    ent, status = annotate.entity_spans(c, ZH_CLINICAL), annotate.status_assertions(c, ZH_CLINICAL)
    ns = spark.createDataFrame([node(1, "n1", "TIME_REF", "3天前"), node(2, "n2", "SYMPTOM", "骨折固定术"), node(3, "n3", "SYMPTOM", "骨折"), node(4, "n4", "GENERAL_HEALTH_STATUS", "神志清")], NODES)
    es = spark.createDataFrame([edge(1, "e1", "RELATED_TO", "n2", "n3")], EDGES)
    nodes, edges, frames, _ = overrides.apply_overrides(c, ns, es, ent, status)
    assert {(r.node_id, r.node_type, r.source_text) for r in nodes.collect()} == {("n1", "TIME_REF", "3天前"), ("n2", "PROCEDURE", "骨折固定术"), ("n_anchor_5", "BODY_SITE", "左下肢"), ("n_anchor_6", "GENERAL_STATUS_ITEM", "神志"), ("n_anchor_7", "GENERAL_STATUS_VALUE", "清")}
    assert sorted(rows(edges, "edge_id", "edge_type", "source_node_id", "target_node_id", "source_text", "confidence")) == [
        ("e_anchor_1", "LOCALIZES_TO", "n2", "n_anchor_5", "左下肢骨折固定术", 0.92), ("e_anchor_2", "OCCURS_AT", "n2", "n1", "3天前左下肢骨折固定术", 0.94), ("e_anchor_3", "STATUS_VALUE_IS", "n_anchor_6", "n_anchor_7", "神志清", 0.98)]
    assert rows(frames, "source_text", "node_ids", "edge_ids") == [("病程中", ["n_anchor_6", "n_anchor_7"], ["e_anchor_3"])]


def test_section_merge(spark):
    cs = spark.createDataFrame([("A", "case", 1, 1), ("B", "case", 1, 2), ("C", "case", 1, 3)], "chunk_id string, case_id string, section_index int, chunk_index int")
    ns = spark.createDataFrame([("A", -1, "n0", "PATIENT", "__PATIENT__", False, "confirmed", True), ("A", 1, "n1", "SYMPTOM", "咳嗽", False, "confirmed", False), ("B", 1, "n1", "PATIENT", "患者", False, "confirmed", False), ("B", 2, "n2", "SIGN", "咳嗽", True, "confirmed", False)], NODES)
    mk = lambda c, pos, i, s, t, conf, low: (c, pos, i, "HAS_SYMPTOM", s, t, False, "confirmed", None, f"x{i}", "r", conf, low)
    es = spark.createDataFrame([mk("A", 1, "e1", "n0", "n1", 0.6, True), mk("A", 2, "e2", "n0", "n1", 0.9, False), mk("B", 1, "e1", "n1", "n2", 0.7, False)], EDGES + ", low_confidence boolean")
    fr = spark.createDataFrame([("B", 1, "f", "temporal_context", "t", ["n2", "n9"], [], ["B"]), ("C", 1, "g", "temporal_context", "t", ["n5"], [], ["C"])], "chunk_id string, frame_pos int, frame_id string, frame_type string, source_text string, node_ids array<string>, edge_ids array<string>, chunk_ids array<string>")
    out = G.section_graphs(cs, {"nodes": ns, "edges": es, "frames": fr})
    assert sorted(rows(out["nodes"], "node_id", "source_text", "node_type", "chunk_ids", "merged_from")) == [("case_sec001_nd0001", "患者", "PATIENT", ["A", "B"], ["g0_n0", "g1_n1"]), ("case_sec001_nd0002", "咳嗽", "SYMPTOM", ["A", "B"], ["g0_n1", "g1_n2"])]
    assert rows(out["edges"], "edge_id", "chunk_ids", "confidence", "low_confidence", "source_text") == [("case_sec001_ed0001", ["A", "B"], 0.7, True, "xe1")]
    assert rows(out["frames"], "frame_id", "node_ids", "edge_ids", "chunk_ids") == [("f_sec_1", ["case_sec001_nd0002"], ["case_sec001_ed0001"], ["B"])]
    assert rows(merge.section_summary(out["nodes"], out["edges"], out["frames"]), "n_nodes", "n_edges", "n_frames", "n_low_confidence") == [(2, 1, 1, 1)]


def test_containment_pairs(spark):
    df = spark.createDataFrame([("k", t) for t in ("气短", "气短加重", "活动后气短明显加重", "气短", None)] + [("j", "气短")], "k string, t string")
    assert rows(SP.containment_pairs(df, ["k"], "t"), "short_text", "long_text") == [("气短", "气短加重")]
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    want = {(a, b) for a in texts for b in texts if a != b and a in b and len(b) - len(a) <= 4}
    assert set(rows(SP.containment_pairs(spark.createDataFrame([("k", t) for t in texts], "k string, t string"), ["k"], "t"), "short_text", "long_text")) == want


def test_coreference_fold_is_sequential(spark):
    data = [("case", 1, f"g0_n{i}", t, i, 0, f"g0_n{i}") for i, t in enumerate(["ab", "abc", "abcd"])]
    df = spark.createDataFrame(data, "case_id string, section_index int, tmp_id string, source_text string, node_pos int, gi int, canonical string")
    yes = spark.createDataFrame([("case", 1, "abc", "abcd", True), ("case", 1, "ab", "abc", True), ("case", 1, "ab", "abcd", False)], "case_id string, section_index int, short_text string, long_text string, are_coreferent boolean")
    assert sorted(rows(merge.apply_coreference(df, yes), "tmp_id", "canonical")) == [("g0_n0", "g0_n0"), ("g0_n1", "g0_n0"), ("g0_n2", "g0_n0")]
    later = spark.createDataFrame([("case", 1, "ab", "abc", True)], "case_id string, section_index int, short_text string, long_text string, are_coreferent boolean")
    assert sorted(rows(merge.apply_coreference(df, later), "tmp_id", "canonical"))[2] == ("g0_n2", "g0_n2")


def test_model_calls_never_stop_the_job(spark):
    def fn(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("down")
        return [{"verdict": t, "verdict_reason": "r"} if t != "odd" else {"x": 1} for t in texts]

    df = spark.createDataFrame([("a",), ("boom",), ("odd",), ("a",)], "request string")
    got = sorted(rows(model.apply_model(df, "request", fn, requests.VERDICT), "request", "status", "verdict"), key=repr)
    assert got == sorted([("a", "ok", "a"), ("a", "ok", "a"), ("boom", "error", None), ("odd", "error", None)], key=repr)
    assert spark.range(1).select(model.render("{a} of {b}", a=F.lit(1), b=F.lit(None).cast("string")).alias("r")).collect()[0].r == "1 of "


def test_a_store_asks_once_for_each_digest(spark, tmp_path):
    import time

    log, up, store = tmp_path / "log", tmp_path / "up", str(tmp_path / "store")

    def fn(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        if "slow" in texts and not up.exists():
            time.sleep(3)
        if any(t.startswith("bad") for t in texts) and not up.exists():
            raise RuntimeError("down")
        return [{"verdict": t, "verdict_reason": "r"} for t in texts]

    texts = ["a", "bad1", "b", "a", "slow", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, request string")
    ask = lambda: {r.id: (r.status, r.verdict) for r in model.apply_model(df, "request", fn, requests.VERDICT, batch=2, partitions=2, store=store, waves=2, retries=1, backoff=0.01, timeout=1.0, parallel=2).collect()}
    first = ask()
    assert {i for i, (status, _) in first.items() if status == "error"} == {1, 4, 5} and first[0] == first[3] == ("ok", "a")
    log.write_text("")
    up.write_text("")
    second = ask()
    asked = log.read_text().split("\n")[:-1]
    assert set(asked) <= {"bad1", "slow", "None"} and second[1] == ("ok", "bad1") and second[4] == ("ok", "slow") and second[2] == ("ok", "b")
    log.write_text("")
    assert {i: v for i, v in ask().items() if i != 5} == {i: v for i, v in second.items() if i != 5} and set(log.read_text().split("\n")) <= {"", "None"}


def test_outside_and_nearest(spark):
    p = spark.createDataFrame([("k", 1), ("k", 5), ("j", 5)], "k string, at int")
    s = spark.createDataFrame([("k", 4, 6, 0), ("k", 0, 3, 1)], "k string, start int, end int, pos int")
    assert sorted(rows(SP.outside(p, s.filter("start = 4"), ["k"], "at"), "k", "at")) == [("j", 5), ("k", 1)]
    near = SP.nearest_left(p.withColumn("id", F.monotonically_increasing_id()), s, ["k"], "id", 12, "pos")
    assert sorted(rows(near, "at", "near_start")) == [(1, 0), (5, 4)]


def test_nearest_and_adjacent_equal_brute_force(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 9, 40]), i) for i, s in enumerate(rng.randrange(120) for _ in range(150))]
    points = [(rng.choice("abc"), i, rng.randrange(150)) for i in range(200)]
    s, p = spark.createDataFrame(spans, "k string, start int, end int, pos int"), spark.createDataFrame(points, "k string, id int, at int")
    want = []
    for k, i, at in points:
        fit = [x for x in spans if x[0] == k and x[1] <= at and at - x[2] <= 5]
        if fit:
            want.append((i, at, max(fit, key=lambda x: (x[1], x[3]))[3]))
    assert sorted(rows(SP.nearest_left(p, s, ["k"], "id", 5, "pos"), "id", "at", "near_pos")) == sorted(want)
    assert sorted(rows(SP.adjacent(s, s, ["k"], 0, 2), "l_pos", "r_pos")) == sorted((x[3], y[3]) for x in spans for y in spans if x[0] == y[0] and 0 <= y[1] - x[2] <= 2)


def test_checks_on_nulls_and_repeated_verdicts(spark):
    c = chunk(spark, "咳嗽 阿司匹林")
    ns = spark.createDataFrame([node(1, "n1", "SYMPTOM", "咳嗽")], NODES)
    es = spark.createDataFrame([edge(1, "e1", "ACCOMPANIED_BY", None, "n1"), edge(2, "e2", "ACCOMPANIED_BY", "n1", None), edge(3, "e3", "ACCOMPANIED_BY", "n1", "n1", text=None), edge(4, "e4", "ACCOMPANIED_BY", "n1", "n1", confidence=None)], EDGES)
    good, bad = validate.drop_dangling(ns, es)
    assert sorted(rows(bad, "message")) == [("e1 source null",), ("e2 target null",)] and sorted(rows(validate.needs_review(c, good), "edge_id")) == [("e3",), ("e4",)]
    schema = "chunk_id string, edge_id string, verdict string, verdict_reason string"
    said = [("c0", "e3", "valid", "z"), ("c0", "e3", "invalid", "a"), ("c0", "e4", "valid", "b")]
    out, warned = validate.apply_verdicts(good, good, spark.createDataFrame(said, schema))
    assert rows(out, "edge_id", "low_confidence") == [("e4", False)] and rows(warned, "message") == [("e3 a",)]
    out, _ = validate.apply_verdicts(good, good, spark.createDataFrame([(*x, i) for i, x in enumerate(reversed(said))], schema + ", pos int"))
    assert sorted(rows(out, "edge_id", "low_confidence")) == [("e3", False), ("e4", False)]


def test_large_lexicon_equals_a_scan(spark):
    import re

    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("ab咳") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"thatthat", "that"})
    texts = ["".join(rng.choice("ab咳 ") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["thathat thatthatthat", "", "aaaa" * 800]
    table = spark.createDataFrame([(t, "SIGN", "x") for t in terms], "term string, node_type string, source string")
    want = sorted((f"c{i}", m.start(), m.end(), t) for i, text in enumerate(texts) for t in terms for m in re.finditer(re.escape(t), text))
    assert sorted(rows(annotate.large_lexicon_spans(zh(spark, *texts), table), "chunk_id", "start", "end", "text")) == want
    assert annotate.large_lexicon_spans(zh(spark, *texts), table.filter("false")).collect() == []


def test_stream_appends_each_note_once(spark, tmp_path):
    from noteweave.streaming.notes import stream_sections

    (tmp_path / "in").mkdir()
    run = lambda: stream_sections(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), GENERIC).awaitTermination()
    (tmp_path / "in/a.txt").write_text("MIT License. More.")
    run()
    (tmp_path / "in/b.txt").write_text("MIT License. More.")
    (tmp_path / "in/c.txt").write_text("Plain prose.")
    run()
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")), "section_id", "n_sentences")) == [("license", 2), ("prose", 1)]
