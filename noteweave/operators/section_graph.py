"""A section's graph as one row: the chunk graphs of a section meet in one shuffle, and entity resolution, edge dedup and
frames are steps on arrays inside its row. The table forms, for verdicts on coreference as well, are in ``merge``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.arrays import firsts, lookup, none_of, runs
from noteweave.functions.text import edge_key, let, node_key
from noteweave.operators.chunk_graph import FRAME_TYPE
from noteweave.operators.merge import S

_NODE = ["node_type", "source_text", "negated", "certainty", "implicit"]
_EDGE = ["certainty", "context", "source_text", "reasoning", "low_confidence", "confidence"]


def _one_per_id(nodes: Column) -> Column:
    """One node for each id: the first place, the last values."""
    def with_values(first: Column) -> Column:
        last = F.reverse(F.sort_array(nodes))
        values = lookup(F.transform(first, lambda n: n["node_id"]), F.transform(last, lambda n: n["node_id"]), F.transform(last, lambda n: F.struct(*[n[c].alias(c) for c in _NODE])))
        return F.zip_with(first, values, lambda n, v: F.struct(n["node_pos"].alias("node_pos"), n["node_id"].alias("node_id"), *[v[c].alias(c) for c in _NODE]))

    return let(firsts(nodes, lambda n: n["node_id"], lambda n: n["node_pos"]), with_values)


def _tmp(gi: Column, node_id: Column) -> Column:
    return F.concat(F.lit("g"), gi.cast("string"), F.lit("_"), node_id)


def collected(graphs: DataFrame) -> DataFrame:
    """Chunk graphs (rows with ``case_id, section_index, chunk_index, nodes, edges, frames``; empty ones too) as one row for each
    section, the chunks in order. ``chunk_index`` tells the chunks of a section apart."""
    one = graphs.withColumns({"nodes": _one_per_id(F.col("nodes")), "frames": F.coalesce("frames", F.array().cast(FRAME_TYPE))})
    return one.groupBy(*S).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "nodes", "edges", "frames"))).alias("chunks"))


def _resolved(sections: DataFrame) -> DataFrame:
    """``members``: all nodes of a section with ``canon``, the first node of equal text; all patients are one, the first
    explicit one if there is any."""
    each = F.flatten(F.transform("chunks", lambda c, gi: F.transform(c["nodes"], lambda n: F.struct(gi.alias("gi"), n["node_pos"].alias("pos"), _tmp(gi, n["node_id"]).alias("tmp"), c["chunk_id"].alias("chunk_id"), *[n[x].alias(x) for x in _NODE]))))
    g = sections.withColumn("_all", each)
    nodes = F.col("_all")
    patient = F.array_min(F.transform(F.filter(nodes, lambda n: n["node_type"] == "PATIENT"), lambda n: F.struct(n["implicit"].alias("a"), n["gi"].alias("b"), n["pos"].alias("c"), n["tmp"].alias("tmp"))))["tmp"]
    texts = F.transform(nodes, lambda n: n["source_text"])
    by_text = lookup(texts, texts, F.transform(nodes, lambda n: n["tmp"]))  # the nodes are in order
    canon = let(patient, lambda p: F.zip_with(nodes, by_text, lambda n, t: F.when(n["node_type"] == "PATIENT", p).otherwise(F.coalesce(t, n["tmp"]))))
    return g.withColumn("members", F.zip_with("_all", canon, lambda n, c: F.struct(c.alias("canon"), *[n[x].alias(x) for x in ("gi", "pos", "tmp", "chunk_id", *_NODE)]))).drop("_all")


def _entities(sections: DataFrame) -> DataFrame:
    """``nodes``: entities numbered patient first, then by text; ``ids``: the entity of each temporary id ``tmp``."""
    first = F.filter("members", lambda n: n["tmp"] == n["canon"])
    ordered = F.sort_array(F.transform(first, lambda n: F.struct((n["node_type"] != "PATIENT").alias("a"), n["source_text"].alias("b"), n["gi"].alias("c"), n["pos"].alias("d"), n.alias("n"))))
    g = sections.withColumn("_first", F.transform(ordered, lambda x, i: F.struct(node_key(F.col("case_id"), F.col("section_index"), i + 1).alias("node_id"), x["n"].alias("n"))))
    group = F.transform(runs(F.sort_array("members"), lambda n: n["canon"]), lambda r: F.struct(r[0]["canon"].alias("canon"), F.struct(F.array_distinct(F.sort_array(F.transform(r, lambda n: n["chunk_id"]))).alias("chunk_ids"), F.transform(r, lambda n: n["tmp"]).alias("merged_from")).alias("m")))
    g = g.withColumn("_groups", let(group, lambda r: lookup(F.transform("_first", lambda x: x["n"]["canon"]), F.transform(r, lambda x: x["canon"]), F.transform(r, lambda x: x["m"]))))
    g = g.withColumn("nodes", F.zip_with("_first", "_groups", lambda x, m: F.struct(x["node_id"].alias("node_id"), *[x["n"][c].alias(c) for c in _NODE], m["chunk_ids"].alias("chunk_ids"), m["merged_from"].alias("merged_from"))))
    number = lookup(F.transform("members", lambda n: n["canon"]), F.transform("_first", lambda x: x["n"]["canon"]), F.transform("_first", lambda x: x["node_id"]))
    return g.withColumns({"tmp": F.transform("members", lambda n: n["tmp"]), "ids": number}).drop("_first", "_groups", "members")


def _merged_edges(sections: DataFrame) -> DataFrame:
    """``edges``: one for each (source, target, type, negated): the first one's attributes and number, the chunks in order, the
    greatest confidence of each chunk's first edge."""
    each = F.flatten(F.transform("chunks", lambda c, gi: F.transform(F.sort_array(c["edges"]), lambda e: F.struct(_tmp(gi, e["source_node_id"]).alias("s"), _tmp(gi, e["target_node_id"]).alias("t"), c["chunk_id"].alias("chunk_id"), e.alias("e")))))
    g = sections.withColumn("_all", F.transform(each, lambda x, i: F.struct((i + 1).alias("edge_no"), x.alias("x"))))
    end = lambda side: lookup(F.transform("_all", lambda a: a["x"][side]), F.col("tmp"), F.col("ids"))
    placed = F.zip_with("_all", F.arrays_zip(end("s").alias("s"), end("t").alias("t")), lambda a, m: F.struct(F.struct(m["s"].alias("s"), m["t"].alias("t"), a["x"]["e"]["edge_type"].alias("k"), a["x"]["e"]["negated"].alias("n")).alias("key"), a["edge_no"].alias("edge_no"), a["x"]["chunk_id"].alias("chunk_id"), *[a["x"]["e"][c].alias(c) for c in _EDGE]))
    kept = F.sort_array(F.filter(placed, lambda x: x["key"]["s"].isNotNull() & x["key"]["t"].isNotNull()))

    def one(run: Column) -> Column:  # the edges of a key by number; a chunk's stand together
        return let(F.transform(runs(run, lambda x: x["chunk_id"]), lambda r: r[0]), lambda f: F.struct(
            edge_key(F.col("case_id"), F.col("section_index"), f[0]["edge_no"]).alias("edge_id"), f[0]["edge_no"].alias("edge_no"), f[0]["key"]["k"].alias("edge_type"), f[0]["key"]["s"].alias("source_node_id"), f[0]["key"]["t"].alias("target_node_id"), f[0]["key"]["n"].alias("negated"),
            *[f[0][c].alias(c) for c in ("certainty", "context", "source_text", "reasoning")], F.array_max(F.transform(f, lambda x: x["confidence"])).alias("confidence"), F.transform(f, lambda x: x["chunk_id"]).alias("chunk_ids"), f[0]["low_confidence"].alias("low_confidence")))

    return g.withColumn("edges", F.transform(runs(kept, lambda x: x["key"]), one)).drop("_all")


def _merged_frames(sections: DataFrame) -> DataFrame:
    """``frames``: their nodes mapped, with the section's edges of the same chunk that touch them; numbered in the section, then
    empty ones dropped."""
    each = F.flatten(F.transform("chunks", lambda c, gi: F.transform(F.sort_array(c["frames"]), lambda f: F.struct(c["chunk_id"].alias("chunk_id"), F.transform(f["node_ids"], lambda n: _tmp(gi, n)).alias("tmp"), f.alias("f")))))
    g = sections.withColumn("_frames", F.transform(each, lambda x, i: F.struct((i + 1).alias("no"), x.alias("x"))))
    touching = F.flatten(F.transform("edges", lambda e: F.transform(e["chunk_ids"], lambda c: F.struct(c.alias("chunk"), e["edge_id"].alias("id"), e["source_node_id"].alias("s"), e["target_node_id"].alias("t")))))
    of_chunk = F.transform(runs(F.sort_array(touching), lambda x: x["chunk"]), lambda r: F.struct(r[0]["chunk"].alias("chunk"), r.alias("edges")))
    g = g.withColumn("_edges", F.when(F.size("_frames") > 0, of_chunk).otherwise(none_of(of_chunk)))
    g = g.withColumn("_edges", lookup(F.transform("_frames", lambda x: x["x"]["chunk_id"]), F.transform("_edges", lambda x: x["chunk"]), F.transform("_edges", lambda x: x["edges"])))

    def one(a: Column, own: Column) -> Column:
        x = a["x"]
        ids = lookup(x["tmp"], F.col("tmp"), F.col("ids"))
        def made(nodes: Column) -> Column:
            touched = F.transform(F.filter(F.coalesce(own, none_of(own)), lambda e: F.array_contains(nodes, e["s"]) | F.array_contains(nodes, e["t"])), lambda e: e["id"])
            return F.struct(F.format_string("%s_sec_%d", x["f"]["frame_id"], a["no"]).alias("frame_id"), x["f"]["frame_type"].alias("frame_type"), x["f"]["source_text"].alias("source_text"), nodes.alias("node_ids"),
                            F.sort_array(F.array_distinct(touched)).alias("edge_ids"), F.sort_array(F.array_union(x["f"]["chunk_ids"], F.array(x["chunk_id"]))).alias("chunk_ids"))
        return let(F.sort_array(F.array_distinct(F.array_compact(ids))), made)

    return g.withColumn("frames", F.filter(F.zip_with("_frames", "_edges", one), lambda f: F.size(f["node_ids"]) > 0)).drop("_frames", "_edges")


def section_rows(graphs: DataFrame) -> DataFrame:
    """``case_id, section_index, nodes, edges, frames`` of each section."""
    return _merged_frames(_merged_edges(_entities(_resolved(collected(graphs))))).select(*S, "nodes", "edges", "frames")


def rows_of(sections: DataFrame, name: str) -> DataFrame:
    return sections.select(*S, F.explode(name).alias("_x")).select(*S, "_x.*")
