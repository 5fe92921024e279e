"""Rules in place of models: they make the input tables that models would, so that the queries have some. Nothing
but the queries and tests uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.arrays import firsts
from noteweave.functions.spans import islands
from noteweave.operators.chunk_graph import EDGE_TYPE, NODE_TYPE

K = "chunk_id"


def rule_proposals(sentence_rows: DataFrame) -> DataFrame:
    """A rule in place of a model's proposals, from labelled sentences: two of three sentences become a
    chunk, some with other closing marks or white space around, some twice with an overlap, some with
    text that isn't there."""
    key = ["text_hash", "section_index"]
    runs = islands(sentence_rows, ["text_hash"], ["index"], "section_id", "section_index")
    k = F.row_number().over(Window.partitionBy(*key).orderBy("index"))
    rows = runs.withColumn("k", k).filter("k % 3 <> 0")
    base = F.when(F.col("k") % 5 == 1, F.concat(F.regexp_replace("text", "[.!?]+$", ""), F.lit(";"))).when(F.col("k") % 5 == 2, F.concat(F.lit("  "), F.col("text"), F.lit(" "))).otherwise(F.col("text"))
    kind = F.when(F.col("k") % 2 == 0, "finding").otherwise("event")
    one = lambda at, text, on: F.when(on, F.struct((F.col("k") * 4 + at).alias("chunk_index"), text.alias("text"), kind.alias("chunk_type"), F.concat(F.lit("p"), F.col("k").cast("string"), F.lit(f"-{at}")).alias("standalone_summary")))
    made = F.array_compact(F.array(
        one(0, base, F.lit(True)),
        one(1, F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)"), F.col("k") % 7 == 2),
        one(2, F.concat(F.lit("#?"), F.col("text")), F.col("k") % 11 == 4)))
    return rows.select(*key, F.explode(made).alias("m")).select(*key, "m.*")


def proposed_graph(chunks: DataFrame, entities: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A rule in place of a model's graph, with the faults that models make: some nodes have a wrong type, are
    cut short, stand nowhere in the text, or repeat a status phrase; some edges lead nowhere."""
    base = entities.groupBy(K, "text").agg(F.min("pos").alias("pos"), F.min_by("node_type", "pos").alias("node_type"))
    base = base.withColumn("node_type", F.when(F.col("pos") % 3 == 0, "SYMPTOM").otherwise(F.col("node_type")))
    at = chunks.select(K, "chunk_index")

    def made(df: DataFrame, pos, kind, text) -> DataFrame:
        return df.select(K, pos.cast("int").alias("node_pos"), F.concat(F.lit("n"), pos.cast("string")).alias("node_id"), kind.alias("node_type"), text.alias("source_text"),
                         (pos % 5 == 0).alias("negated"), F.when(pos % 4 == 0, "suspected").otherwise("confirmed").alias("certainty"), F.lit(False).alias("implicit"))

    first = base.filter("pos = 0 AND length(text) > 2")
    nodes = [
        made(base, F.col("pos") + 1, F.col("node_type"), F.col("text")),
        made(first, F.lit(10001), F.lit("SYMPTOM"), F.expr("substring(text, 2)")),
        made(at.filter("chunk_index % 4 = 0").join(base.select(K).distinct(), K, "left_semi"), F.lit(10002), F.lit("SYMPTOM"), F.lit("@@missing@@")),
        made(status.filter("pos = 0").join(base.select(K).distinct(), K, "left_semi"), F.lit(10003), F.lit("GENERAL_HEALTH_STATUS"), F.col("evidence_text")),
    ]
    nodes = reduce(DataFrame.unionByName, nodes)
    nxt = base.select(K, (F.col("pos") - 1).alias("pos"), F.col("node_type").alias("to_type"), F.col("text").alias("to_text"))
    pair = base.join(nxt, [K, "pos"]).join(at, K)
    k = F.col("pos") + 1
    kind = F.when(F.col("to_type") == "BODY_SITE", "LOCALIZES_TO").when(F.col("to_type") == "DRUG", "TREATED_WITH").when(k % 3 == 0, "HAS_SYMPTOM").otherwise("ACCOMPANIED_BY")
    edge = lambda df, pos, kind, source, target, text, reason, conf: df.select(K, pos.cast("int").alias("edge_pos"), F.concat(F.lit("e"), pos.cast("string")).alias("edge_id"), kind.alias("edge_type"), source.alias("source_node_id"), target.alias("target_node_id"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"), F.lit(None).cast("string").alias("context"), text.alias("source_text"), reason.alias("reasoning"), conf.alias("confidence"))
    node = lambda x: F.concat(F.lit("n"), x.cast("string"))
    edges = edge(pair, k, kind, node(k), node(k + 1), F.when(k % 4 == 0, "not there").otherwise(F.col("text")), F.lit("neighbours"), ((k * 37 + F.col("chunk_index") * 11) % 100) / 100.0)
    lost = edge(at.filter("chunk_index % 6 = 0").join(first.select(K), K, "left_semi"), F.lit(9001), F.lit("ACCOMPANIED_BY"), F.lit("n1"), F.lit("n999"), F.lit("x"), F.lit("dangling"), F.lit(0.7))
    return nodes, edges.unionByName(lost)


def proposed_rows(chunks: DataFrame) -> DataFrame:
    """``proposed_graph`` on chunks with their annotations in the row (``chunk_graph.annotated``): ``nodes`` and ``edges`` beside them."""
    first = firsts(F.col("entities"), lambda e: e["text"], lambda e: e["pos"])
    base = F.transform(first, lambda e: F.struct(e["pos"].alias("pos"), e["text"].alias("text"), F.when(e["pos"] % 3 == 0, "SYMPTOM").otherwise(e["node_type"]).alias("kind")))

    def node(pos, kind, text):
        return F.struct(pos.cast("int").alias("node_pos"), F.concat(F.lit("n"), pos.cast("string")).alias("node_id"), kind.alias("node_type"), text.alias("source_text"), (pos % 5 == 0).alias("negated"),
                        F.when(pos % 4 == 0, "suspected").otherwise("confirmed").alias("certainty"), F.lit(False).alias("implicit"))

    def edge(pos, kind, source, target, text, reason, confidence):
        return F.struct(pos.cast("int").alias("edge_pos"), F.concat(F.lit("e"), pos.cast("string")).alias("edge_id"), kind.alias("edge_type"), source.alias("source_node_id"), target.alias("target_node_id"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"),
                        F.lit(None).cast("string").alias("context"), text.alias("source_text"), F.lit(reason).alias("reasoning"), confidence.cast("double").alias("confidence"))

    g = chunks.withColumn("_base", base)
    b, lit = F.col("_base"), F.lit
    some, head = F.size(b) > 0, F.get(b, lit(0))
    cut = F.coalesce((head["pos"] == 0) & (F.length(head["text"]) > 2), lit(False))
    phrase = F.get(F.filter("status", lambda s: s["pos"] == 0), lit(0))["evidence_text"]
    more = F.array_compact(F.array(F.when(cut, node(lit(10001), lit("SYMPTOM"), F.substring(head["text"], lit(2), F.length(head["text"])))), F.when(some & (F.col("chunk_index") % 4 == 0), node(lit(10002), lit("SYMPTOM"), lit("@@missing@@"))),
                                   F.when(some & phrase.isNotNull(), node(lit(10003), lit("GENERAL_HEALTH_STATUS"), phrase))))
    pairs = F.filter(F.zip_with(b, F.slice(b, lit(2), F.size(b)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["y"]["pos"] == p["x"]["pos"] + 1)
    name = lambda i: F.concat(lit("n"), i.cast("string"))

    def joined(p):
        k, to = p["x"]["pos"] + 1, p["y"]["kind"]
        kind = F.when(to == "BODY_SITE", "LOCALIZES_TO").when(to == "DRUG", "TREATED_WITH").when(k % 3 == 0, "HAS_SYMPTOM").otherwise("ACCOMPANIED_BY")
        return edge(k, kind, name(k), name(k + 1), F.when(k % 4 == 0, "not there").otherwise(p["x"]["text"]), "neighbours", ((k * 37 + F.col("chunk_index") * 11) % 100) / 100.0)

    lost = F.array_compact(F.array(F.when(cut & (F.col("chunk_index") % 6 == 0), edge(lit(9001), lit("ACCOMPANIED_BY"), lit("n1"), lit("n999"), lit("x"), "dangling", lit(0.7)))))
    return g.withColumns({"nodes": F.concat(F.transform(b, lambda x: node(x["pos"] + 1, x["kind"], x["text"])), more).cast(NODE_TYPE), "edges": F.concat(F.transform(pairs, joined), lost).cast(EDGE_TYPE)}).drop("_base")


def rule_verdicts(review: DataFrame) -> DataFrame:
    """A rule in place of a reviewer: every other edge gets a verdict by its place."""
    verdict = F.when(F.col("edge_pos") % 3 == 0, "invalid").when(F.col("edge_pos") % 3 == 1, "low_confidence").otherwise("valid")
    return review.filter("edge_pos % 2 = 0").select(K, "edge_id", verdict.alias("verdict"), F.lit("by place").alias("verdict_reason"))


# ---------------------------------------------------------------- batch functions


def _failing(requests: list[str], every: int) -> None:
    """Models fail now and then: here on requests of some lengths, which are then asked alone and fail again."""
    if any(len(r) % every == 0 for r in requests):
        raise ValueError("no answer")


def label(requests: list[str]) -> list[dict]:
    _failing(requests, 7)
    return [{"section_id": ("prose", "table", "nonsense")[len(r) % 3], "reasoning": f"length {len(r)}"} for r in requests]


def review(requests: list[str]) -> list[dict]:
    _failing(requests, 5)
    return [{"items": [{"index": 1, "section_id": "table", "reasoning": "first"}] if len(r) % 2 == 0 else []} for r in requests]


def split(requests: list[str]) -> list[dict]:
    _failing(requests, 9)
    return [{"chunks": [{"text": r.split("\n", 1)[1][:40], "chunk_type": "event", "standalone_summary": "start"}]} for r in requests]


def analyse(requests: list[str]) -> list[dict]:
    """Two texts from behind the annotated chunk's title, and a relation between them."""
    _failing(requests, 8)
    entity = lambda t: {"text": t, "description": "front", "negated": False, "certainty": "confirmed"}
    relation = lambda s, o: {"subject_text": s, "object_text": o, "relation": "front", "evidence_text": s, "negated": False, "certainty": "confirmed"}
    return [{"entities": [entity(r[4:12]), entity(r[4:7])], "relations": [relation(r[4:12], r[4:7])]} for r in requests]


def build(requests: list[str]) -> list[dict]:
    """A node for each end of the relation that closes the request (``- 8 characters > 3 characters: front``), and its edge."""
    _failing(requests, 11)
    node = lambda i, kind, text: {"node_id": f"n{i}", "node_type": kind, "source_text": text, "negated": False, "certainty": "confirmed"}
    edge = lambda text: {"edge_id": "e1", "edge_type": "ACCOMPANIED_BY", "source_node_id": "n1", "target_node_id": "n2", "negated": False, "certainty": "confirmed", "context": None, "source_text": text, "reasoning": "front", "confidence": 0.75}
    return [{"nodes": [node(1, "SYMPTOM", r[-21:-13]), node(2, "SIGN", r[-10:-7])], "edges": [edge(r[-21:-13])]} for r in requests]


def verdict(requests: list[str]) -> list[dict]:
    return [{"verdict": "valid" if len(r) % 3 else "low_confidence", "verdict_reason": f"length {len(r)}"} for r in requests]


def coreference(requests: list[str]) -> list[dict]:
    _failing(requests, 5)
    return [{"are_coreferent": len(r) % 2 == 0, "reason": f"length {len(r)}"} for r in requests]
