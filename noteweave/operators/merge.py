"""Chunk graphs of a section become one graph: entity resolution, edge dedup, frames.

Input rows have ``case_id, section_index`` and ``chunk_index`` besides the chunk graph's columns. All windows
and joins have (case_id, section_index) as an equality.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.spans import containment_pairs
from noteweave.functions.text import edge_key, node_key

S = ["case_id", "section_index"]


def graph_order(chunks: DataFrame) -> DataFrame:
    """``chunk_id, case_id, section_index, gi``: each chunk's place among its section's graphable chunks, from
    0, those with empty graphs counted too."""
    w = Window.partitionBy(*S).orderBy("chunk_index")
    return chunks.select("chunk_id", *S, (F.dense_rank().over(w) - 1).alias("gi"))


def collect_nodes(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """Nodes with their section and an id that is unique in it: one row for each id of a chunk, the first
    place, the last values."""
    rest = [c for c in nodes.columns if c not in ("chunk_id", "node_id", "node_pos")]
    one = nodes.groupBy("chunk_id", "node_id").agg(F.min("node_pos").alias("node_pos"), F.max_by(F.struct(*rest), "node_pos").alias("_v")).select("chunk_id", "node_id", "node_pos", *[f"_v.{c}" for c in rest])
    return one.join(order, "chunk_id").withColumn("tmp_id", F.concat(F.lit("g"), F.col("gi").cast("string"), F.lit("_"), F.col("node_id")))


def collect_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    tmp = lambda c: F.concat(F.lit("g"), F.col("gi").cast("string"), F.lit("_"), F.col(c))
    w = Window.partitionBy(*S).orderBy("gi", "edge_pos")
    return edges.join(order, "chunk_id").withColumns({"tmp_edge": tmp("edge_id"), "tmp_source": tmp("source_node_id"), "tmp_target": tmp("target_node_id")}).withColumn("edge_no", F.row_number().over(w))


def resolve_entities(nodes: DataFrame) -> DataFrame:
    """The nodes with ``canonical``: the first node of equal text in the section, whatever its type; all
    patients are one, the first explicit one if there is any."""
    order = F.struct("gi", "node_pos")
    by_text = F.min_by("tmp_id", order).over(Window.partitionBy(*S, "source_text"))
    patient = F.min_by("tmp_id", F.when(F.col("node_type") == "PATIENT", F.struct("implicit", "gi", "node_pos"))).over(Window.partitionBy(*S))
    return nodes.withColumn("canonical", F.when(F.col("node_type") == "PATIENT", patient).otherwise(by_text))


def coreference_candidates(nodes: DataFrame, most: int = 4) -> DataFrame:
    """Pairs of texts of a section to ask about: one holds the other and is at most ``most`` longer."""
    return containment_pairs(nodes, S, "source_text", most)


def apply_coreference(resolved: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Folds positive verdicts (``case_id, section_index, short_text, long_text, are_coreferent``) into the
    canonical ids, in the order of the pairs' texts: all nodes of the long text take what the short text's
    first node has at that moment. Sections without positive verdicts pass by."""
    yes = verdicts.filter("are_coreferent").select(*S, "short_text", "long_text").distinct()
    touched = resolved.join(yes.select(*S).distinct(), S, "left_semi")
    texts = touched.groupBy(*S, F.col("source_text")).agg(F.min(F.struct("gi", "node_pos")).alias("at"), F.min_by("canonical", F.struct("gi", "node_pos")).alias("canonical"))
    texts = texts.select(*S, "source_text", (F.col("at.gi").cast("bigint") * 1_000_000 + F.col("at.node_pos")).alias("rank"), "canonical", F.lit(None).cast("string").alias("long_text"))
    asked = yes.select(*S, F.col("short_text").alias("source_text"), F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("canonical"), "long_text")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["long_text"].isna()]
        rank = dict(zip(known["source_text"], known["rank"], strict=True))
        now = dict(zip(known["source_text"], known["canonical"], strict=True))
        pairs = [(s, t) for s, t in zip(pdf["source_text"], pdf["long_text"], strict=True) if isinstance(t, str) and s in rank and t in rank]
        changed = {}
        for short, long in sorted(pairs, key=lambda p: (min(rank[p[0]], rank[p[1]]), max(rank[p[0]], rank[p[1]]))):
            changed[long] = now[long] = now[short]
        first = pdf.iloc[0]
        return pd.DataFrame({"case_id": first["case_id"], "section_index": first["section_index"], "source_text": list(changed), "moved": list(changed.values())})

    kind = dict(resolved.dtypes)
    moved = texts.unionByName(asked).groupBy(*S).applyInPandas(fold, f"case_id {kind['case_id']}, section_index {kind['section_index']}, source_text string, moved string")
    return resolved.join(moved, [*S, "source_text"], "left").withColumn("canonical", F.coalesce("moved", "canonical")).drop("moved")


def section_nodes(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities numbered patient first, then by text; and the map from temporary to entity ids."""
    order = F.struct("gi", "node_pos")
    members = resolved.groupBy(*S, "canonical").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"), F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "tmp_id"))), lambda x: x["tmp_id"]).alias("merged_from"))
    base = resolved.filter("tmp_id = canonical").select(*S, "canonical", "node_type", "source_text", "negated", "certainty", "implicit", order.alias("_o"))
    rows = base.join(members, [*S, "canonical"])
    n = F.row_number().over(Window.partitionBy(*S).orderBy((F.col("node_type") == "PATIENT").desc(), "source_text", "_o"))
    rows = rows.withColumn("node_id", node_key(F.col("case_id"), F.col("section_index"), n))
    ids = resolved.select(*S, "tmp_id", "canonical").join(rows.select(*S, "canonical", "node_id"), [*S, "canonical"]).select(*S, "tmp_id", "node_id")
    return rows.select(*S, "node_id", "node_type", "source_text", "negated", "certainty", "implicit", "chunk_ids", "merged_from"), ids


def section_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between entities, one for each (source, target, type, negated): the first one's attributes and
    number, the chunks in order, the greatest confidence of each chunk's first edge."""
    e = edges.join(ids.withColumnsRenamed({"tmp_id": "tmp_source", "node_id": "source"}), [*S, "tmp_source"]).join(ids.withColumnsRenamed({"tmp_id": "tmp_target", "node_id": "target"}), [*S, "tmp_target"])
    key = [*S, "source", "target", "edge_type", "negated"]
    values = ["edge_no", "certainty", "context", "source_text", "reasoning", "low_confidence", "confidence"]
    by_chunk = e.groupBy(*key, "chunk_id").agg(F.min_by(F.struct(*values), "edge_no").alias("f"))
    out = by_chunk.groupBy(*key).agg(F.min_by("f", "f.edge_no").alias("f"), F.max("f.confidence").alias("confidence"),
                                     F.transform(F.sort_array(F.collect_list(F.struct(F.col("f.edge_no").alias("o"), "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return out.select(*S, edge_key(F.col("case_id"), F.col("section_index"), F.col("f.edge_no")).alias("edge_id"), F.col("f.edge_no").alias("edge_no"), "edge_type", F.col("source").alias("source_node_id"), F.col("target").alias("target_node_id"),
                      "negated", "f.certainty", "f.context", "f.source_text", "f.reasoning", "confidence", "chunk_ids", "f.low_confidence")


def section_frames(frames: DataFrame, order: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Frames over entities: their nodes mapped, with the section's edges of the same chunk that touch them;
    numbered in the section, then empty ones dropped."""
    f = frames.join(order, "chunk_id").withColumn("no", F.row_number().over(Window.partitionBy(*S).orderBy("gi", "frame_pos")))
    node = f.select(*S, "no", "gi", "chunk_id", F.explode("node_ids").alias("n")).withColumn("tmp_id", F.concat(F.lit("g"), F.col("gi").cast("string"), F.lit("_"), F.col("n"))).join(ids, [*S, "tmp_id"]).select(*S, "no", "chunk_id", "node_id").distinct()
    ends = edges.select(*S, "edge_id", "chunk_ids", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).select(*S, "edge_id", "node_id", F.explode("chunk_ids").alias("chunk_id"))
    touched = node.join(ends, [*S, "chunk_id", "node_id"]).groupBy(*S, "no").agg(F.sort_array(F.collect_set("edge_id")).alias("edge_ids"))
    nodes = node.groupBy(*S, "no").agg(F.sort_array(F.collect_set("node_id")).alias("node_ids"))
    out = f.drop("node_ids", "edge_ids").join(nodes, [*S, "no"]).join(touched, [*S, "no"], "left")
    return out.select(*S, F.format_string("%s_sec_%d", F.col("frame_id"), F.col("no")).alias("frame_id"), "frame_type", "source_text", "node_ids", F.coalesce("edge_ids", F.array().cast("array<string>")).alias("edge_ids"), F.sort_array(F.array_union("chunk_ids", F.array("chunk_id"))).alias("chunk_ids"))


def digraph_edges(edges: DataFrame) -> DataFrame:
    """A simple directed graph: one edge for each pair of entities, the last one."""
    return edges.groupBy(*S, "source_node_id", "target_node_id").agg(F.max_by(F.struct("edge_id", "edge_type", "negated", "confidence", "low_confidence"), "edge_no").alias("e")).select(*S, "source_node_id", "target_node_id", "e.*")


def section_summary(nodes: DataFrame, edges: DataFrame, frames: DataFrame) -> DataFrame:
    n = nodes.groupBy(*S).agg(F.count("*").alias("n_nodes"), F.count_if("negated").alias("n_negated"), F.count_if("implicit").alias("n_implicit"))
    e = edges.groupBy(*S).agg(F.count("*").alias("n_edges"), F.count_if("low_confidence").alias("n_low_confidence"))
    f = frames.groupBy(*S).agg(F.count("*").alias("n_frames"))
    return n.join(e, S, "left").join(f, S, "left").na.fill(0, ["n_edges", "n_low_confidence", "n_frames"])
