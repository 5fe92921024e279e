"""Every chunk graph gets one patient, and what belongs to a patient gets an edge from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.tables import settled
from noteweave.operators.overrides import EDGE, NODE, K, highest_number
from noteweave.sources import clinical as W

IMPLICIT_ID = "n0"
IMPLICIT_TEXT = "__PATIENT__"
EVIDENCE_MOST = 120

# Edge types whose source is the patient, the edge for each type of node, types whose negation
# is a finding, and the order of the expressions that tell how a disease belongs to the patient.
PATIENT_EDGES = (
    "HAS_SEX", "HAS_AGE", "HAS_OCCUPATION", "HAS_BIRTHPLACE", "HAS_GENERAL_STATUS", "HAS_STATUS_ITEM", "HAS_SYMPTOM", "SYMPTOM_ONSET", "HAS_SIGN",
    "HAS_VITAL_SIGN", "HAS_FUNCTIONAL_STATUS", "NEGATED_FINDING", "DIAGNOSED_WITH", "SUSPECTED_DIAGNOSIS", "DIAGNOSIS_PENDING", "COMORBIDITY",
    "HISTORY_OF", "NEGATED_HISTORY_OF", "INFECTION_WITH", "UNDERWENT_EXAM", "TREATED_WITH", "UNDERWENT", "PARTICIPATED_IN", "HAS_ADHERENCE",
    "RECEIVED_VACCINATION", "EXPOSED_TO", "HAS_HABIT",
)
NODE_EDGES = {
    "SEX": "HAS_SEX", "AGE": "HAS_AGE", "OCCUPATION": "HAS_OCCUPATION", "BIRTHPLACE": "HAS_BIRTHPLACE", "GENERAL_HEALTH_STATUS": "HAS_GENERAL_STATUS",
    "GENERAL_STATUS_ITEM": "HAS_STATUS_ITEM", "SYMPTOM": "HAS_SYMPTOM", "SIGN": "HAS_SIGN", "VITAL_SIGN": "HAS_VITAL_SIGN",
    "FUNCTIONAL_STATUS": "HAS_FUNCTIONAL_STATUS", "EXAM_TEST": "UNDERWENT_EXAM", "DRUG": "TREATED_WITH", "PROCEDURE": "UNDERWENT",
    "OXYGEN_THERAPY": "TREATED_WITH", "CLINICAL_TRIAL": "PARTICIPATED_IN", "VACCINATION": "RECEIVED_VACCINATION", "EXPOSURE": "EXPOSED_TO",
    "HABIT": "HAS_HABIT", "MEDICATION_ADHERENCE": "HAS_ADHERENCE",
}
NEGATABLE = (
    "SYMPTOM", "SIGN", "DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION", "IMAGING_FINDING", "CARDIAC_FINDING", "ECG_FINDING",
    "ULTRASOUND_FINDING", "PFT_RESULT", "LAB_RESULT", "BLOOD_GAS_RESULT", "ALLERGY",
)
DISEASES = ("DISEASE", "DISEASE_SUBTYPE", "PATHOGEN_OR_INFECTION")
DISEASE_RULES = (
    (r"否认|无[^\n]*(?:病史|感染|结核|肝炎)|未见", "NEGATED_FINDING"),
    (r"待诊|待排|排查", "DIAGNOSIS_PENDING"),
    (r"考虑|疑诊|可能|倾向", "SUSPECTED_DIAGNOSIS"),
    (r"既往|病史|史[，。；,;]|患[^\n]*年|有[^\n]*年", "HISTORY_OF"),
    (r"诊断|诊为|确诊|收住", "DIAGNOSED_WITH"),
    (r"合并|伴有|同时患有", "COMORBIDITY"),
)
DIAGNOSIS_CHUNK = "diagnosis_entry"
ALLERGY_DENIED = r"无|否认|未"


def add_patients(nodes: DataFrame) -> DataFrame:
    """Chunks that have nodes but no patient get an implicit one at place -1: ``n0``, or the first free of
    ``n_patient_0, 1, ..`` where that id is taken."""
    has = nodes.filter("node_type = 'PATIENT'").select(K).distinct()
    ids = nodes.join(has, K, "left_anti").groupBy(K).agg(F.collect_set("node_id").alias("_ids"))
    free = F.filter(F.transform(F.sequence(F.lit(0), F.size("_ids")), lambda i: F.concat(F.lit("n_patient_"), i.cast("string"))), lambda x: ~F.array_contains(F.col("_ids"), x))
    node_id = F.when(~F.array_contains("_ids", IMPLICIT_ID), F.lit(IMPLICIT_ID)).otherwise(F.get(free, F.lit(0)))
    new = ids.select(K, F.lit(-1).alias("node_pos"), node_id.alias("node_id"), F.lit("PATIENT").alias("node_type"), F.lit(IMPLICIT_TEXT).alias("source_text"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"), F.lit(True).alias("implicit"))
    return nodes.select(NODE).unionByName(new)


def patients(nodes: DataFrame) -> DataFrame:
    """``chunk_id, patient_id``: each chunk's first patient."""
    return nodes.filter("node_type = 'PATIENT'").groupBy(K).agg(F.min_by("node_id", "node_pos").alias("patient_id"))


def _types(nodes: DataFrame, node: str, kind: str) -> DataFrame:
    """Of nodes with one id the last counts."""
    return nodes.groupBy(K, F.col("node_id").alias(node)).agg(F.max_by("node_type", "node_pos").alias(kind))


def reanchor(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patient edges whose source has a wrong type move to the patient if that makes them legal; and a
    warning for each."""
    source = rules.select(F.col("edge_type"), F.col("source_type").alias("_st")).distinct().withColumn("_source_ok", F.lit(True))
    target = rules.filter("source_type = 'PATIENT'").select("edge_type", F.col("target_type").alias("_tt")).distinct().withColumn("_patient_ok", F.lit(True))
    e = edges.join(_types(nodes, "source_node_id", "_st"), [K, "source_node_id"], "left").join(_types(nodes, "target_node_id", "_tt"), [K, "target_node_id"], "left").join(patients(nodes), K, "left")
    e = e.join(source, ["edge_type", "_st"], "left").join(target, ["edge_type", "_tt"], "left")
    move = F.col("edge_type").isin(list(PATIENT_EDGES)) & F.col("_st").isNotNull() & F.col("_source_ok").isNull() & F.coalesce("_patient_ok", F.lit(False)) & F.col("patient_id").isNotNull()
    note = F.concat(F.lit(W.MOVED_REASON[0]), F.col("source_node_id"), F.lit(W.MOVED_REASON[1]), F.coalesce("reasoning", F.lit("")))
    e = e.withColumn("_move", move).withColumn("reasoning", F.when(move, note).otherwise(F.col("reasoning"))).withColumn("_old", F.col("source_node_id")).withColumn("source_node_id", F.when(move, F.col("patient_id")).otherwise(F.col("source_node_id")))
    warned = e.filter("_move").select(K, F.lit("ANCHOR").alias("code"), F.concat(F.col("edge_id"), F.lit(" moved from "), F.col("_old")).alias("message"))
    return e.select(EDGE), warned


def default_edge_type(kind: Column, negated: Column, text: Column, chunk_type: Column) -> Column:
    """The edge that a node of a type has from the patient; null for none."""
    disease = None
    for p, name in DISEASE_RULES:
        hit = F.rlike(text, F.lit(p))
        if name == "DIAGNOSED_WITH":
            hit = hit | (chunk_type == DIAGNOSIS_CHUNK)
        disease = F.when(hit, name) if disease is None else disease.when(hit, name)
    plain = F.create_map(*[F.lit(x) for kv in NODE_EDGES.items() for x in kv])
    return (F.when(negated & kind.isin(list(NEGATABLE)), "NEGATED_FINDING").when(kind.isin(list(DISEASES)), disease)
            .when(kind == "ALLERGY", F.when(F.rlike(text, F.lit(ALLERGY_DENIED)), "NEGATED_HISTORY_OF").otherwise("HISTORY_OF")).otherwise(F.try_element_at(plain, kind)))


def default_edges(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """The edges with the missing ones from the patient to each node that calls for one, if legal."""
    w = nodes.join(chunks.select(K, F.col("text").alias("_t"), "chunk_type"), K).join(patients(nodes), K).filter("node_id <> patient_id")
    w = w.withColumn("edge_type", default_edge_type(F.col("node_type"), F.col("negated"), F.col("_t"), F.col("chunk_type"))).filter("edge_type IS NOT NULL")
    legal = rules.filter("source_type = 'PATIENT'").select("edge_type", F.col("target_type").alias("node_type")).distinct()
    w = w.join(legal, ["edge_type", "node_type"], "left_semi")
    have = edges.select(K, "edge_type", F.col("source_node_id").alias("patient_id"), F.col("target_node_id").alias("node_id")).distinct()
    w = w.join(have, [K, "edge_type", "patient_id", "node_id"], "left_anti")
    state = highest_number(edges, "edge_id", "e").join(edges.groupBy(K).agg(F.max("edge_pos").alias("last")), K)
    n = F.row_number().over(Window.partitionBy(K).orderBy("node_pos"))
    w = w.withColumn("_n", n).join(state, K, "left")
    no = F.startswith(F.col("edge_type"), F.lit("NEGATED"))
    new = w.select(K, (F.coalesce("last", F.lit(0)) + F.col("_n")).alias("edge_pos"), F.concat(F.lit("e_anchor_"), (F.coalesce("top", F.lit(0)) + F.col("_n")).cast("string")).alias("edge_id"), "edge_type",
                   F.col("patient_id").alias("source_node_id"), F.col("node_id").alias("target_node_id"), (F.col("negated") | no).alias("negated"), F.when(no, "excluded").otherwise(F.col("certainty")).alias("certainty"),
                   F.lit(None).cast("string").alias("context"), F.when(F.length("_t") <= EVIDENCE_MOST, F.col("_t")).otherwise(F.col("source_text")).alias("source_text"),
                   F.concat(F.lit(W.ANCHOR_REASON[0]), F.col("node_type"), F.lit(W.ANCHOR_REASON[1])).alias("reasoning"), F.lit(0.9).alias("confidence"))
    return edges.select(EDGE).unionByName(new)


def anchor(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings with all anchors."""
    nodes = settled(add_patients(nodes), "nodes")
    edges, warned = reanchor(nodes, edges, rules)
    edges = settled(edges, "edges")
    return nodes, settled(default_edges(chunks, nodes, edges, rules), "edges"), warned
