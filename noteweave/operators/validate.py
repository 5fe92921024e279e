"""Checks on chunk graphs. Each gives what passes and warnings (``chunk_id, code, message``) for what doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.operators.anchor import IMPLICIT_TEXT, _types
from noteweave.operators.overrides import EDGE, NODE, K

THRESHOLD = 0.5


def check_nodes(chunks: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node's text must stand in its chunk; implicit patients are exempt."""
    seen = nodes.join(chunks.select(K, F.col("text").alias("_t")), K, "left")
    exempt = (F.col("node_type") == "PATIENT") & (F.col("implicit") | (F.col("source_text") == IMPLICIT_TEXT))
    good = exempt | F.coalesce(F.contains(F.col("_t"), F.col("source_text")), F.lit(False))
    return seen.filter(good).select(NODE), seen.filter(~good).select(K, F.lit("HARD-node").alias("code"), F.col("node_id").alias("message"))


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ends of an edge must exist (a null end doesn't); the reason names the source first."""
    e = edges
    for end, flag in (("source_node_id", "_s"), ("target_node_id", "_t")):
        e = e.join(nodes.select(K, F.col("node_id").alias(end)).distinct().withColumn(flag, F.lit(True)), [K, end], "left")
    end = lambda name: F.concat_ws(" ", "edge_id", F.lit(name), F.coalesce(f"{name}_node_id", F.lit("null")))
    reason = F.when(F.col("_s").isNull(), end("source")).when(F.col("_t").isNull(), end("target"))
    e = e.withColumn("_reason", reason)
    return e.filter("_reason IS NULL").select(EDGE), e.filter("_reason IS NOT NULL").select(K, F.lit("HARD-dangling").alias("code"), F.col("_reason").alias("message"))


def check_endpoints(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The types at an edge's ends must be a legal pair for its type."""
    e = edges.join(_types(nodes, "source_node_id", "source_type"), [K, "source_node_id"]).join(_types(nodes, "target_node_id", "target_type"), [K, "target_node_id"])
    legal = rules.select("edge_type", "source_type", "target_type").distinct()
    key = ["edge_type", "source_type", "target_type"]
    bad = e.join(legal, key, "left_anti").select(K, F.lit("HARD-endpoint").alias("code"), F.concat_ws(" ", "edge_id", "edge_type", "source_type", "target_type").alias("message"))
    return e.join(legal, key, "left_semi").select(EDGE), bad


def needs_review(chunks: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges of low (or null) confidence, or whose evidence is null or doesn't stand in the chunk."""
    e = edges.join(chunks.select(K, F.col("text").alias("_t")), K)
    sure = (F.col("confidence") >= threshold) & F.contains(F.col("_t"), F.col("source_text"))
    return e.filter(~F.coalesce(sure, F.lit(False))).select(EDGE)


def apply_verdicts(edges: DataFrame, review: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed edges with the verdict invalid go, those with low_confidence (or without any) are flagged. Of several
    verdicts on an edge the last by ``pos`` counts, where there is that column; else the most cautious one (invalid,
    low_confidence, valid), with its own reason."""
    asked = review.select(K, "edge_id").distinct().withColumn("_asked", F.lit(True))
    caution = F.when(F.col("verdict") == "invalid", 2).when(F.col("verdict") == "low_confidence", 1).otherwise(0)
    order = F.col("pos") if "pos" in verdicts.columns else caution
    last = verdicts.groupBy(K, "edge_id").agg(F.max_by(F.struct("verdict", "verdict_reason"), F.struct(order, "verdict", "verdict_reason")).alias("_l")).select(K, "edge_id", "_l.verdict", "_l.verdict_reason")
    e = edges.join(asked, [K, "edge_id"], "left").join(last, [K, "edge_id"], "left")
    verdict = F.when(F.col("_asked").isNotNull(), F.coalesce("verdict", F.lit("low_confidence"))).otherwise("valid")
    e = e.withColumn("_v", verdict)
    code = F.when(F.col("_v") == "invalid", "SOFT-invalid").otherwise("SOFT-low_conf")
    warned = e.filter("_v <> 'valid'").select(K, code.alias("code"), F.concat_ws(" ", "edge_id", "verdict_reason").alias("message"))
    return e.filter("_v <> 'invalid'").withColumn("low_confidence", F.col("_v") == "low_confidence").select(*EDGE, "low_confidence"), warned


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code").agg(F.count("*").alias("n"))
