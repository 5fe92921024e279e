"""Rules that overrule a proposed graph: protected entities and status assertions.

Nodes are ``chunk_id, node_pos, node_id, node_type, source_text, negated, certainty, implicit``; edges ``chunk_id,
edge_pos, edge_id, edge_type, source_node_id, target_node_id, negated, certainty, context, source_text, reasoning,
confidence``. All joins have the chunk as an equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.spans import first_of, nearest_left
from noteweave.functions.tables import settled
from noteweave.operators.normalize import body_site_pairs
from noteweave.sources import clinical as W

K = "chunk_id"
EDGE = ["chunk_id", "edge_pos", "edge_id", "edge_type", "source_node_id", "target_node_id", "negated", "certainty", "context", "source_text", "reasoning", "confidence"]
NODE = ["chunk_id", "node_pos", "node_id", "node_type", "source_text", "negated", "certainty", "implicit"]
#: How far left of a procedure its time may end.
TIME_REACH = 12


def highest_number(df: DataFrame, column: str, letter: str) -> DataFrame:
    """``chunk_id, top``: the largest number among ids ``n3`` or ``n_anchor_3``, 0 without one."""
    number = F.regexp_extract(column, rf"^{letter}(?:_anchor_)?([0-9]+)$", 1)
    return df.groupBy(K).agg(F.max(F.when(number != "", number.cast("int")).otherwise(0)).alias("top"))


def append_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Appends wanted nodes (``chunk_id, node_type, source_text, ord``) with new ids in their order."""
    state = highest_number(nodes, "node_id", "n").join(nodes.groupBy(K).agg(F.max("node_pos").alias("last")), K)
    n = F.row_number().over(Window.partitionBy(K).orderBy("ord"))
    new = wanted.withColumn("_n", n).join(state, K, "left")
    new = new.select(K, (F.coalesce("last", F.lit(0)) + F.col("_n")).alias("node_pos"), F.concat(F.lit("n_anchor_"), (F.coalesce("top", F.lit(0)) + F.col("_n")).cast("string")).alias("node_id"),
                     "node_type", "source_text", F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"), F.lit(False).alias("implicit"))
    return nodes.select(NODE).unionByName(new)


def append_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Appends wanted edges (``chunk_id, edge_type, source_node_id, target_node_id, source_text, reasoning,
    confidence, ord``) that aren't there yet; of equal ones the first."""
    same = [K, "edge_type", "source_node_id", "target_node_id"]
    wanted = first_of(wanted, same, ["ord"]).join(edges.select(same).distinct(), same, "left_anti")
    state = highest_number(edges, "edge_id", "e").join(edges.groupBy(K).agg(F.max("edge_pos").alias("last")), K)
    new = wanted.withColumn("_n", F.row_number().over(Window.partitionBy(K).orderBy("ord"))).join(state, K, "left")
    new = new.select(K, (F.coalesce("last", F.lit(0)) + F.col("_n")).alias("edge_pos"), F.concat(F.lit("e_anchor_"), (F.coalesce("top", F.lit(0)) + F.col("_n")).cast("string")).alias("edge_id"),
                     "edge_type", "source_node_id", "target_node_id", F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"), F.lit(None).cast("string").alias("context"), "source_text", "reasoning", F.col("confidence").cast("double").alias("confidence"))
    return edges.select(EDGE).unionByName(new)


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in ``gone`` (``chunk_id, node_id``) and the edges that touch them."""
    edge = edges
    for end in ("source_node_id", "target_node_id"):
        edge = edge.join(gone.select(K, F.col("node_id").alias(end)), [K, end], "left_anti")
    return nodes.join(gone.select(K, "node_id"), [K, "node_id"], "left_anti").select(NODE), edge.select(EDGE)


def retype_protected(nodes: DataFrame, protected: DataFrame) -> DataFrame:
    """A node whose text is a protected entity's takes its type (the first one's)."""
    types = protected.groupBy(K, F.col("text").alias("source_text")).agg(F.min_by("node_type", "pos").alias("_type"))
    return nodes.join(types, [K, "source_text"], "left").withColumn("node_type", F.coalesce("_type", "node_type")).select(NODE)


def boundary_conflicts(nodes: DataFrame, protected: DataFrame) -> DataFrame:
    """``chunk_id, node_id, source_text`` of nodes that lie inside a protected entity's text or hold one,
    without being one."""
    texts = protected.select(K, F.col("text").alias("_p")).distinct()
    other = nodes.join(texts, (nodes[K] == texts[K]) & (F.col("source_text") == F.col("_p")), "left_anti")
    return other.join(texts, (other[K] == texts[K]) & (F.contains(F.col("_p"), F.col("source_text")) | F.contains(F.col("source_text"), F.col("_p"))), "left_semi").select(K, "node_id", "source_text")


def missing_protected(nodes: DataFrame, protected: DataFrame) -> DataFrame:
    """Wanted nodes for protected entities without one, one for each text."""
    first = first_of(protected, [K, "text"], ["pos"]).select(K, "node_type", F.col("text").alias("source_text"), F.col("pos").alias("ord"))
    return first.join(nodes.select(K, "source_text").distinct(), [K, "source_text"], "left_anti")


def _by_text(nodes: DataFrame, text: str, node: str) -> DataFrame:
    """Of nodes with one text the last one counts."""
    return nodes.groupBy(K, F.col("source_text").alias(text)).agg(F.max_by("node_id", "node_pos").alias(node))


def site_edges(nodes: DataFrame, protected: DataFrame) -> DataFrame:
    """Wanted edges from a procedure to the body site before it."""
    pairs = body_site_pairs(protected).join(_by_text(nodes, "r_text", "source_node_id"), [K, "r_text"]).join(_by_text(nodes, "l_text", "target_node_id"), [K, "l_text"])
    return pairs.select(K, F.lit("LOCALIZES_TO").alias("edge_type"), "source_node_id", "target_node_id", F.concat("l_text", "r_text").alias("source_text"),
                        F.lit(W.SITE_REASON).alias("reasoning"), F.lit(0.92).alias("confidence"), (F.col("r_pos") * 1000 + F.col("l_pos")).cast("bigint").alias("ord"))


def bounded_evidence(text: Column, left: Column, right: Column) -> Column:
    """The text from the left term to the end of the right one behind it, else the right term."""
    a = F.instr(text, left)
    b = F.call_function("locate", right, text, a + F.length(left))
    return F.when((a > 0) & (b > 0), F.substring(text, a, b - a + F.length(right))).otherwise(right)


def time_edges(nodes: DataFrame, protected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Wanted edges from a procedure to the time that stands closest on its left."""
    times = nodes.filter("node_type = 'TIME_REF'").join(chunks.select(K, F.col("text").alias("_t")), K)
    times = times.withColumn("start", F.instr(F.col("_t"), F.col("source_text")) - 1).filter("start >= 0")
    times = times.select(K, "start", (F.col("start") + F.length("source_text")).alias("end"), "node_id", "node_pos", F.col("source_text").alias("time_text"))
    points = protected.filter("node_type = 'PROCEDURE'").select(K, "pos", F.col("start").alias("at"))
    near = nearest_left(points, times, [K], "pos", TIME_REACH, "node_pos")
    near = near.join(protected.select(K, "pos", "text"), [K, "pos"]).join(_by_text(nodes, "text", "source_node_id"), [K, "text"]).join(chunks.select(K, F.col("text").alias("_t")), K)
    return near.select(K, F.lit("OCCURS_AT").alias("edge_type"), "source_node_id", F.col("near_node_id").alias("target_node_id"), bounded_evidence(F.col("_t"), F.col("near_time_text"), F.col("text")).alias("source_text"),
                       F.lit(W.TIME_REASON).alias("reasoning"), F.lit(0.94).alias("confidence"), (F.lit(10_000_000) + F.col("pos")).cast("bigint").alias("ord"))


def stale_status(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """General status nodes that the assertions replace: no item or value, or part of a phrase."""
    a = status.groupBy(K).agg(F.collect_set("evidence_text").alias("_ev"), F.array_union(F.collect_set("item_text"), F.collect_set("value_text")).alias("_known"))
    hit = nodes.filter("node_type = 'GENERAL_HEALTH_STATUS'").join(a, K)
    return hit.filter(~F.array_contains("_known", F.col("source_text")) | F.exists("_ev", lambda e: F.contains(e, F.col("source_text")))).select(K, "node_id", "source_text")


def missing_status(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """Wanted nodes for items and values, by type and text."""
    item = status.select(K, F.lit("GENERAL_STATUS_ITEM").alias("node_type"), F.col("item_text").alias("source_text"), (F.col("pos") * 2).alias("ord"))
    value = status.select(K, F.lit("GENERAL_STATUS_VALUE").alias("node_type"), F.col("value_text").alias("source_text"), (F.col("pos") * 2 + 1).alias("ord"))
    return first_of(item.unionByName(value), [K, "node_type", "source_text"], ["ord"]).join(nodes.select(K, "node_type", "source_text").distinct(), [K, "node_type", "source_text"], "left_anti")


def _status_ends(nodes: DataFrame, status: DataFrame) -> DataFrame:
    by = lambda kind, text, node: nodes.filter(F.col("node_type") == kind).groupBy(K, F.col("source_text").alias(text)).agg(F.max_by("node_id", "node_pos").alias(node))
    return status.join(by("GENERAL_STATUS_ITEM", "item_text", "source_node_id"), [K, "item_text"]).join(by("GENERAL_STATUS_VALUE", "value_text", "target_node_id"), [K, "value_text"])


def status_edges(nodes: DataFrame, status: DataFrame) -> DataFrame:
    return _status_ends(nodes, status).select(K, F.lit("STATUS_VALUE_IS").alias("edge_type"), "source_node_id", "target_node_id", F.col("evidence_text").alias("source_text"),
                                              F.lit(W.STATUS_REASON).alias("reasoning"), F.lit(0.98).alias("confidence"), F.col("pos").cast("bigint").alias("ord"))


def status_frames(nodes: DataFrame, edges: DataFrame, status: DataFrame) -> DataFrame:
    """A frame around a chunk's status nodes and edges, where a context word stands."""
    ends = _status_ends(nodes, status)
    both = ends.join(edges.filter("edge_type = 'STATUS_VALUE_IS'").select(K, "source_node_id", "target_node_id", "edge_id"), [K, "source_node_id", "target_node_id"], "left")
    out = both.groupBy(K).agg(F.min_by("context_text", F.when(F.col("context_text").isNotNull(), F.col("pos"))).alias("source_text"),
                              F.sort_array(F.array_union(F.collect_set("source_node_id"), F.collect_set("target_node_id"))).alias("node_ids"), F.sort_array(F.collect_set("edge_id")).alias("edge_ids"))
    return out.filter("source_text IS NOT NULL").select(K, F.lit(1).alias("frame_pos"), F.concat(K, F.lit("_frame_status_1")).alias("frame_id"), F.lit("temporal_context").alias("frame_type"), "source_text", "node_ids", "edge_ids", F.array(K).alias("chunk_ids"))


def apply_overrides(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, protected: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, frames and warnings after all overrides, in their fixed order. Each round of nodes and edges
    is written, for the next one uses it several times."""
    conflict = settled(boundary_conflicts(nodes, protected), "conflicts")
    warnings = [conflict.select(K, F.lit("BOUNDARY").alias("code"), F.concat(F.lit("removed "), "node_id").alias("message"))]
    nodes, edges = drop_nodes(retype_protected(nodes, protected), edges, conflict)
    missing = settled(missing_protected(nodes, protected), "missing")
    warnings.append(missing.select(K, F.lit("BOUNDARY").alias("code"), F.concat(F.lit("added "), "source_text").alias("message")))
    nodes = settled(append_nodes(nodes, missing), "nodes")
    edges = append_edges(settled(edges, "edges"), site_edges(nodes, protected).unionByName(time_edges(nodes, protected, chunks)))
    nodes, edges = drop_nodes(nodes, edges, settled(stale_status(nodes, status), "stale"))
    nodes, edges = settled(nodes, "nodes"), settled(edges, "edges")
    nodes = settled(append_nodes(nodes, missing_status(nodes, status)), "nodes")
    edges = settled(append_edges(edges, status_edges(nodes, status)), "edges")
    return nodes, edges, status_frames(nodes, edges, status), reduce(DataFrame.unionByName, warnings)
