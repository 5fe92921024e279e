"""A chunk's graph as one row: entities, status rows, nodes, edges and warnings are arrays beside the chunk's text.

The overrides, the patient anchor and the checks are steps on these arrays, so a chunk passes them all in one projection,
without a shuffle or a table in between. The table forms of the same
rules are in ``overrides``, ``anchor`` and ``validate``; they serve graphs that are no chunk's, of any size.

Columns: ``chunk_id, text, chunk_type`` and what else the chunk has; ``entities`` (``pos, start, end, text, node_type,
source``), ``status`` (``pos, item_text, value_text, evidence_text, context_text``), ``nodes``, ``edges``, ``frames`` and
``warnings`` (``code, message``). Null arrays count as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.arrays import firsts, lookup, none_of, null_of, within
from noteweave.functions.text import let, scan
from noteweave.operators import anchor as P
from noteweave.operators.annotate import entity_array, status_array
from noteweave.operators.overrides import TIME_REACH, bounded_evidence
from noteweave.operators.validate import THRESHOLD
from noteweave.sources import clinical as W
from noteweave.sources.packs import Pack

K = "chunk_id"
ENTITY_TYPE = "array<struct<pos:int,start:int,end:int,text:string,node_type:string,source:string>>"
STATUS_TYPE = "array<struct<pos:int,item_text:string,value_text:string,evidence_text:string,context_text:string>>"
NODE_TYPE = "array<struct<node_pos:int,node_id:string,node_type:string,source_text:string,negated:boolean,certainty:string,implicit:boolean>>"
EDGE_TYPE = "array<struct<edge_pos:int,edge_id:string,edge_type:string,source_node_id:string,target_node_id:string,negated:boolean,certainty:string,context:string,source_text:string,reasoning:string,confidence:double>>"
FRAME_TYPE = "array<struct<frame_pos:int,frame_id:string,frame_type:string,source_text:string,node_ids:array<string>,edge_ids:array<string>,chunk_ids:array<string>>>"
WARNING_TYPE = "array<struct<code:string,message:string>>"
#: An edge type's (source types, target types).
Rules = dict[str, tuple[tuple[str, ...], tuple[str, ...]]]


def annotated(chunks: DataFrame, pack: Pack) -> DataFrame:
    """The chunks with ``entities`` and ``status``, found in the row."""
    return chunks.withColumns({"entities": entity_array("text", pack).cast(ENTITY_TYPE), "status": status_array("text", pack).cast(STATUS_TYPE)})


def nested(table: DataFrame, name: str, kind: str, key: str = K) -> DataFrame:
    """A table's rows by chunk as one sorted array of the given type: what a model's answers come as."""
    fields = [f.split(":")[0] for f in kind.removeprefix("array<struct<").removesuffix(">>").replace("array<string>", "list").split(",")]
    return table.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).cast(kind).alias(name))


def with_arrays(chunks: DataFrame, **arrays: DataFrame) -> DataFrame:
    """The chunks joined with nested tables (see ``nested``), one exchange each; a chunk without rows has an empty array."""
    for name, df in arrays.items():
        chunks = chunks.join(df, K, "left").withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
    return chunks


def rows_of(graphs: DataFrame, name: str, *more: str) -> DataFrame:
    """An array column as a table with the chunk's key."""
    return graphs.select(K, *more, F.explode(name).alias("_x")).select(K, *more, "_x.*")


# ---------------------------------------------------------------- steps


def _set(item: Column, fields: list[str], **new: Column) -> Column:
    """The struct with some fields changed."""
    return F.struct(*[new.get(f, item[f]).alias(f) for f in fields])


_NODE = ["node_pos", "node_id", "node_type", "source_text", "negated", "certainty", "implicit"]
_EDGE = ["edge_pos", "edge_id", "edge_type", "source_node_id", "target_node_id", "negated", "certainty", "context", "source_text", "reasoning", "confidence"]


def _values(items: Column, field: str) -> Column:
    return F.transform(items, lambda x: x[field])


def _warned(items: Column, code: str, message: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(code).alias("code"), message(x).alias("message")))


def _top(items: Column, letter: str, last: str) -> Column:
    """``struct<number, last>``: the largest number among ids ``n3`` or ``n_anchor_3``, and the last place; 0 without."""
    number = lambda x: F.regexp_extract(x[f"{letter}_id"], rf"^{letter[0]}(?:_anchor_)?([0-9]+)$", 1)
    top = F.array_max(F.transform(items, lambda x: F.when(number(x) != "", number(x).cast("int")).otherwise(0)))
    return F.struct(F.coalesce(top, F.lit(0)).alias("number"), F.coalesce(F.array_max(_values(items, last)), F.lit(0)).alias("last"))


def append_nodes(nodes: Column, wanted: Column) -> Column:
    """The nodes with wanted ones (``node_type, source_text``, in order) under new ids."""
    def made(top: Column) -> Column:
        return F.transform(wanted, lambda w, i: F.struct((top["last"] + i + 1).alias("node_pos"), F.concat(F.lit("n_anchor_"), (top["number"] + i + 1).cast("string")).alias("node_id"), w["node_type"].alias("node_type"),
                                                         w["source_text"].alias("source_text"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"), F.lit(False).alias("implicit")))

    return F.concat(nodes, let(_top(nodes, "node", "node_pos"), made))


def append_edges(edges: Column, wanted: Column) -> Column:
    """The edges with wanted ones (``ord, edge_type, source_node_id, target_node_id, source_text, reasoning, confidence``)
    that aren't there yet; of equal ones the first."""
    same = lambda e: F.struct(e["edge_type"].alias("a"), e["source_node_id"].alias("b"), e["target_node_id"].alias("c"))

    def made(top: Column, new: Column) -> Column:
        return F.transform(new, lambda w, i: F.struct((top["last"] + i + 1).alias("edge_pos"), F.concat(F.lit("e_anchor_"), (top["number"] + i + 1).cast("string")).alias("edge_id"), w["edge_type"].alias("edge_type"), w["source_node_id"].alias("source_node_id"),
                                                      w["target_node_id"].alias("target_node_id"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"), F.lit(None).cast("string").alias("context"), w["source_text"].alias("source_text"), w["reasoning"].alias("reasoning"), w["confidence"].alias("confidence")))

    new = let(F.transform(edges, same), lambda have: F.filter(firsts(wanted, same, lambda w: w["ord"]), lambda w: ~within(have, same(w))))
    return F.when(F.size(wanted) > 0, F.concat(edges, let(new, lambda n: let(_top(edges, "edge", "edge_pos"), lambda top: made(top, n))))).otherwise(edges)


def _without(edges: Column, gone: Column) -> Column:
    """The edges that touch none of the nodes; ``gone`` is a column of its own."""
    return F.when(F.size(gone) > 0, F.filter(edges, lambda e: ~within(gone, e["source_node_id"]) & ~within(gone, e["target_node_id"]))).otherwise(edges)


def _nodes_without(nodes: Column, gone: Column) -> Column:
    return F.when(F.size(gone) > 0, F.filter(nodes, lambda n: ~within(gone, n["node_id"]))).otherwise(nodes)


def _ids_by_text(texts: Column, nodes: Column) -> Column:
    """The node behind each text; of nodes with one text the last counts."""
    return lookup(texts, F.reverse(_values(nodes, "source_text")), F.reverse(_values(nodes, "node_id")))


def _retyped(nodes: Column, protected: Column) -> Column:
    kinds = lookup(_values(nodes, "source_text"), _values(protected, "text"), _values(protected, "node_type"))
    return F.zip_with(nodes, kinds, lambda n, k: _set(n, _NODE, node_type=F.coalesce(k, n["node_type"])))


def _conflicts(nodes: Column, protected: Column) -> Column:
    """Nodes inside a protected text or around one, without being one."""
    around = lambda n, texts: F.coalesce(F.exists(texts, lambda p: F.contains(p, n["source_text"]) | F.contains(n["source_text"], p)), F.lit(False))
    return let(F.array_distinct(_values(protected, "text")), lambda texts: F.filter(nodes, lambda n: ~within(texts, n["source_text"]) & around(n, texts)))


def _missing_protected(nodes: Column, protected: Column) -> Column:
    first = F.transform(firsts(protected, lambda p: p["text"], lambda p: p["pos"]), lambda p: F.struct(p["node_type"].alias("node_type"), p["text"].alias("source_text")))
    return let(_values(nodes, "source_text"), lambda have: F.filter(first, lambda f: ~within(have, f["source_text"])))


def _near_sites(protected: Column) -> Column:
    """``struct<r, l>``: procedures with the sites that end at most two characters before them, by one sweep."""
    both = F.sort_array(F.concat(F.transform(F.filter(protected, lambda p: p["node_type"] == "BODY_SITE"), lambda p: F.struct(p["end"].alias("at"), F.lit(0).alias("t"), p.alias("p"))),
                                 F.transform(F.filter(protected, lambda p: p["node_type"] == "PROCEDURE"), lambda p: F.struct(p["start"].alias("at"), F.lit(1).alias("t"), p.alias("p")))))

    def sweep(a: Column) -> Column:
        near = lambda s, x: F.filter(s, lambda y: y["at"] >= x["at"] - 2)
        pairs = lambda s, x: F.when(x["t"] == 1, F.transform(near(s, x), lambda y: F.struct(x["p"].alias("r"), y["p"].alias("l"))))
        return F.flatten(F.array_compact(scan(a, none_of(a), lambda s, x: F.when(x["t"] == 0, F.array_append(near(s, x), x)).otherwise(near(s, x)), pairs)[1]))

    empty = none_of(F.transform(protected, lambda p: F.struct(p.alias("r"), p.alias("l"))))
    return let(both, lambda a: F.when(F.exists(a, lambda x: x["t"] == 0) & F.exists(a, lambda x: x["t"] == 1), sweep(a)).otherwise(empty))


def _wanted_edge(order: Column, kind: str, source: Column, target: Column, text: Column, reason: str, confidence: float) -> Column:
    return F.struct(order.cast("bigint").alias("ord"), F.lit(kind).alias("edge_type"), source.alias("source_node_id"), target.alias("target_node_id"), text.alias("source_text"), F.lit(reason).alias("reasoning"), F.lit(confidence).alias("confidence"))


def _between(pairs: Column, sources: Column, targets: Column, made: Callable[[Column, Column, Column], Column]) -> Column:
    """An edge for each pair whose two ends are known."""
    each = F.zip_with(pairs, F.arrays_zip(sources.alias("s"), targets.alias("t")), lambda p, e: F.when(e["s"].isNotNull() & e["t"].isNotNull(), made(p, e["s"], e["t"])))
    return F.array_compact(each)


def _site_edges(nodes: Column, protected: Column) -> Column:
    def made(pairs: Column) -> Column:
        return _between(pairs, _ids_by_text(F.transform(pairs, lambda x: x["r"]["text"]), nodes), _ids_by_text(F.transform(pairs, lambda x: x["l"]["text"]), nodes),
                        lambda x, s, t: _wanted_edge(x["r"]["pos"] * 1000 + x["l"]["pos"], "LOCALIZES_TO", s, t, F.concat(x["l"]["text"], x["r"]["text"]), W.SITE_REASON, 0.92))

    return let(_near_sites(protected), made)


def _near_times(text: Column, nodes: Column, protected: Column) -> Column:
    """``struct<p, id, text>``: procedures with the time node of greatest start (then place) at or before them that ends at
    most ``TIME_REACH`` before. A sweep: a time that starts later and lasts as long hides the ones before it."""
    time = lambda n: let(F.instr(text, n["source_text"]) - 1, lambda at: F.struct(at.alias("at"), F.lit(0).alias("t"), n["node_pos"].alias("pos"), (at + F.length(n["source_text"]) + TIME_REACH).alias("till"), n["node_id"].alias("id"), n["source_text"].alias("text"), null_of(F.get(protected, F.lit(0))).alias("p")))
    times = F.filter(F.transform(F.filter(nodes, lambda n: n["node_type"] == "TIME_REF"), time), lambda x: x["at"] >= 0)
    none = F.lit(None).cast("string")
    points = F.transform(F.filter(protected, lambda p: p["node_type"] == "PROCEDURE"), lambda p: F.struct(p["start"].alias("at"), F.lit(1).alias("t"), p["pos"].alias("pos"), F.lit(0).alias("till"), none.alias("id"), none.alias("text"), p.alias("p")))

    def sweep(a: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            return F.when(x["t"] == 0, F.array_append(F.filter(s, lambda y: y["till"] > x["till"]), x)).otherwise(F.filter(s, lambda y: y["till"] >= x["at"]))

        def emit(s: Column, x: Column) -> Column:
            alive = F.filter(s, lambda y: y["till"] >= x["at"])
            return F.when((x["t"] == 1) & (F.size(alive) > 0), let(F.get(alive, F.size(alive) - 1), lambda y: F.struct(x["p"].alias("p"), y["id"].alias("id"), y["text"].alias("text"))))

        return F.array_compact(scan(a, none_of(a), step, emit)[1])

    empty = none_of(F.transform(points, lambda x: F.struct(x["p"].alias("p"), x["id"].alias("id"), x["text"].alias("text"))))
    return let(F.sort_array(F.concat(times, points)), lambda a: F.when(F.exists(a, lambda x: x["t"] == 0) & F.exists(a, lambda x: x["t"] == 1), sweep(a)).otherwise(empty))


def _time_edges(text: Column, nodes: Column, protected: Column) -> Column:
    def made(near: Column) -> Column:
        return _between(near, _ids_by_text(F.transform(near, lambda x: x["p"]["text"]), nodes), F.transform(near, lambda x: x["id"]),
                        lambda x, s, t: _wanted_edge(F.lit(10_000_000) + x["p"]["pos"], "OCCURS_AT", s, t, bounded_evidence(text, x["text"], x["p"]["text"]), W.TIME_REASON, 0.94))

    return let(_near_times(text, nodes, protected), made)


def _stale(nodes: Column, status: Column) -> Column:
    """Ids of general status nodes that the assertions replace."""
    def found(known: Column, phrases: Column) -> Column:
        return _values(F.filter(nodes, lambda n: (n["node_type"] == "GENERAL_HEALTH_STATUS") & (~F.array_contains(known, n["source_text"]) | F.exists(phrases, lambda e: F.contains(e, n["source_text"])))), "node_id")

    known = F.array_compact(F.array_union(_values(status, "item_text"), _values(status, "value_text")))
    return F.when(F.size(status) > 0, let(known, lambda k: let(F.array_compact(F.array_distinct(_values(status, "evidence_text"))), lambda e: found(k, e)))).otherwise(none_of(_values(nodes, "node_id")))


def _missing_status(nodes: Column, status: Column) -> Column:
    made = lambda kind, text, at: F.struct(F.lit(kind).alias("node_type"), text.alias("source_text"), at.alias("ord"))
    each = F.flatten(F.transform(status, lambda s: F.array(made("GENERAL_STATUS_ITEM", s["item_text"], s["pos"] * 2), made("GENERAL_STATUS_VALUE", s["value_text"], s["pos"] * 2 + 1))))
    key = lambda x: F.struct(x["node_type"].alias("a"), x["source_text"].alias("b"))
    return let(F.transform(nodes, key), lambda have: F.filter(firsts(each, key, lambda x: x["ord"]), lambda x: ~within(have, key(x))))


def _status_ends(nodes: Column, status: Column) -> Column:
    """``struct<s, source, target>``: status rows with their item's and value's nodes."""
    def by(kind: str, text: str) -> Column:
        return _ids_by_text(_values(status, text), F.filter(nodes, lambda n: n["node_type"] == kind))

    return _between(status, by("GENERAL_STATUS_ITEM", "item_text"), by("GENERAL_STATUS_VALUE", "value_text"), lambda s, a, b: F.struct(s.alias("s"), a.alias("source"), b.alias("target")))


def _frames(chunk: Column, ends: Column, edges: Column) -> Column:
    """A frame around a chunk's status nodes and edges, where a context word stands."""
    context = F.array_min(F.transform(F.filter(ends, lambda e: e["s"]["context_text"].isNotNull()), lambda e: F.struct(e["s"]["pos"].alias("pos"), e["s"]["context_text"].alias("text"))))["text"]
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    own = F.filter(edges, lambda e: e["edge_type"] == "STATUS_VALUE_IS")
    hit = let(F.transform(ends, lambda e: pair(e["source"], e["target"])), lambda p: _values(F.filter(own, lambda e: within(p, pair(e["source_node_id"], e["target_node_id"]))), "edge_id"))
    frame = F.struct(F.lit(1).alias("frame_pos"), F.concat(chunk, F.lit("_frame_status_1")).alias("frame_id"), F.lit("temporal_context").alias("frame_type"), context.alias("source_text"),
                     F.sort_array(F.array_union(_values(ends, "source"), _values(ends, "target"))).alias("node_ids"), F.sort_array(F.array_distinct(hit)).alias("edge_ids"), F.array(chunk).alias("chunk_ids"))
    return F.when(F.size(ends) > 0, F.when(context.isNotNull(), F.array(frame))).cast(FRAME_TYPE)


def overridden(graphs: DataFrame) -> DataFrame:
    """All overrides in their fixed order (J1 to J11), with ``frames`` and ``warnings``."""
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    g = graphs.withColumns({"nodes": F.sort_array(none("nodes", NODE_TYPE)), "edges": F.sort_array(none("edges", EDGE_TYPE)), "entities": none("entities", ENTITY_TYPE), "status": none("status", STATUS_TYPE)})
    nodes, edges, protected, status = (F.col(c) for c in ("nodes", "edges", "entities", "status"))
    g = g.withColumn("_gone", _values(_conflicts(nodes, protected), "node_id"))
    g = g.withColumns({"nodes": _nodes_without(_retyped(nodes, protected), F.col("_gone")), "edges": _without(edges, F.col("_gone"))})
    g = g.withColumn("_missing", _missing_protected(nodes, protected))
    g = g.withColumns({"nodes": append_nodes(nodes, F.col("_missing")), "warnings": F.concat(_warned(F.col("_gone"), "BOUNDARY", lambda n: F.concat(F.lit("removed "), n)), _warned(F.col("_missing"), "BOUNDARY", lambda n: F.concat(F.lit("added "), n["source_text"])))})
    g = g.withColumn("_wanted", F.concat(_site_edges(nodes, protected), _time_edges(F.col("text"), nodes, protected)))
    g = g.withColumn("edges", append_edges(edges, F.col("_wanted"))).withColumn("_stale", _stale(nodes, status))
    g = g.withColumns({"nodes": _nodes_without(nodes, F.col("_stale")), "edges": _without(edges, F.col("_stale"))})
    g = g.withColumn("nodes", F.when(F.size(status) > 0, append_nodes(nodes, _missing_status(nodes, status))).otherwise(nodes))
    empty = none_of(F.transform(status, lambda s: F.struct(s.alias("s"), F.lit("").alias("source"), F.lit("").alias("target"))))
    g = g.withColumn("_ends", F.when(F.size(status) > 0, _status_ends(nodes, status)).otherwise(empty))
    wanted = F.transform("_ends", lambda e: _wanted_edge(e["s"]["pos"], "STATUS_VALUE_IS", e["source"], e["target"], e["s"]["evidence_text"], W.STATUS_REASON, 0.98))
    g = g.withColumn("edges", append_edges(edges, wanted))
    g = g.withColumn("frames", _frames(F.col(K), F.col("_ends"), edges))
    return g.drop("_gone", "_missing", "_wanted", "_stale", "_ends")


# ---------------------------------------------------------------- anchor and checks


def _with_patient(nodes: Column) -> Column:
    """A graph without a patient gets an implicit one in front, under the first free id."""
    def made(ids: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(0), F.size(ids)), lambda i: F.concat(F.lit("n_patient_"), i.cast("string"))), lambda x: ~F.array_contains(ids, x))
        node_id = F.when(F.array_contains(ids, P.IMPLICIT_ID), F.get(free, F.lit(0))).otherwise(F.lit(P.IMPLICIT_ID))
        return F.concat(F.array(F.struct(F.lit(-1).alias("node_pos"), node_id.alias("node_id"), F.lit("PATIENT").alias("node_type"), F.lit(P.IMPLICIT_TEXT).alias("source_text"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"), F.lit(True).alias("implicit"))), nodes)

    lonely = (F.size(nodes) > 0) & ~F.coalesce(F.exists(nodes, lambda n: n["node_type"] == "PATIENT"), F.lit(False))
    return F.when(lonely, let(F.array_compact(_values(nodes, "node_id")), made)).otherwise(nodes)


def _types(nodes: Column, ids: Column) -> Column:
    """The type behind each id; of nodes with one id the last counts."""
    return lookup(ids, F.reverse(_values(nodes, "node_id")), F.reverse(_values(nodes, "node_type")))


def _legal(rules: Rules, side: int, edge_type: Column, node_type: Column, only: str | None = None) -> Column:
    """Whether an edge type allows a node type at an end (0 source, 1 target). With ``only``, types whose sources hold it."""
    allowed = {e: ends[side] for e, ends in rules.items() if only is None or only in ends[0]}
    table = F.create_map(*[c for e, kinds in allowed.items() for c in (F.lit(e), F.array(*[F.lit(k) for k in kinds]))]) if allowed else F.create_map(F.lit(""), F.array(F.lit("")))
    return F.coalesce(F.array_contains(F.try_element_at(table, edge_type), node_type), F.lit(False))


def anchored(graphs: DataFrame, rules: Rules) -> DataFrame:
    """The patient, re-anchored edges and default edges (K1 to K5)."""
    nodes, edges = F.col("nodes"), F.col("edges")
    g = graphs.withColumn("nodes", _with_patient(nodes))
    g = g.withColumn("_patient", F.array_min(F.transform(F.filter(nodes, lambda n: n["node_type"] == "PATIENT"), lambda n: F.struct(n["node_pos"].alias("pos"), n["node_id"].alias("id"))))["id"])
    patient = F.col("_patient")
    ends = F.arrays_zip(_types(nodes, _values(edges, "source_node_id")).alias("s"), _types(nodes, _values(edges, "target_node_id")).alias("t"))

    def moved(e: Column, x: Column) -> Column:
        move = e["edge_type"].isin(list(P.PATIENT_EDGES)) & x["s"].isNotNull() & ~_legal(rules, 0, e["edge_type"], x["s"]) & _legal(rules, 1, e["edge_type"], x["t"], "PATIENT")
        note = F.concat(F.lit(W.MOVED_REASON[0]), e["source_node_id"], F.lit(W.MOVED_REASON[1]), F.coalesce(e["reasoning"], F.lit("")))
        new = _set(e, _EDGE, reasoning=note, source_node_id=patient)
        return let(F.coalesce(move, F.lit(False)), lambda m: F.struct(F.when(m & patient.isNotNull(), new).otherwise(e).alias("e"), F.when(m & patient.isNotNull(), F.concat(e["edge_id"], F.lit(" moved from "), e["source_node_id"])).alias("was")))

    g = g.withColumn("_moved", F.zip_with(edges, ends, moved))
    g = g.withColumns({"edges": F.transform("_moved", lambda m: m["e"]), "warnings": F.concat("warnings", _warned(F.array_compact(_values(F.col("_moved"), "was")), "ANCHOR", lambda x: x))})
    # the types that a text calls for are worked out once for a chunk, not for each node
    text, kind = F.col("text"), F.col("chunk_type")
    disease = P.default_edge_type(F.lit("DISEASE"), F.lit(False), text, kind)
    allergy = P.default_edge_type(F.lit("ALLERGY"), F.lit(False), text, kind)
    g = g.withColumn("_top", let(_top(edges, "edge", "edge_pos"), lambda t: F.struct(t["number"].alias("number"), t["last"].alias("last"), (F.length(text) <= P.EVIDENCE_MOST).alias("short"))))
    table = F.create_map(*[F.lit(x) for kv in P.NODE_EDGES.items() for x in kv])

    def edge_type(n: Column, by_text: Column) -> Column:
        return (F.when(n["negated"] & n["node_type"].isin(list(P.NEGATABLE)), "NEGATED_FINDING").when(n["node_type"].isin(list(P.DISEASES)), by_text["disease"])
                .when(n["node_type"] == "ALLERGY", by_text["allergy"]).otherwise(F.try_element_at(table, n["node_type"])))

    kinds = let(F.struct(disease.alias("disease"), allergy.alias("allergy")), lambda d: F.transform(F.filter(nodes, lambda n: n["node_id"] != patient), lambda n: F.struct(n.alias("n"), edge_type(n, d).alias("kind"))))
    called = F.filter(kinds, lambda x: _legal(rules, 1, x["kind"], x["n"]["node_type"], "PATIENT"))
    key = lambda kind, node: F.struct(kind.alias("a"), node.alias("b"))
    have = F.transform(F.filter(edges, lambda e: e["source_node_id"] == patient), lambda e: key(e["edge_type"], e["target_node_id"]))
    g = g.withColumns({"_called": called, "_have": have})
    new = F.filter("_called", lambda x: ~within(F.col("_have"), key(x["kind"], x["n"]["node_id"])))

    def made(x: Column, i: Column) -> Column:
        no = F.startswith(x["kind"], F.lit("NEGATED"))
        return F.struct((F.col("_top.last") + i + 1).alias("edge_pos"), F.concat(F.lit("e_anchor_"), (F.col("_top.number") + i + 1).cast("string")).alias("edge_id"), x["kind"].alias("edge_type"), patient.alias("source_node_id"), x["n"]["node_id"].alias("target_node_id"),
                        (x["n"]["negated"] | no).alias("negated"), F.when(no, "excluded").otherwise(x["n"]["certainty"]).alias("certainty"), F.lit(None).cast("string").alias("context"), F.when(F.col("_top.short"), text).otherwise(x["n"]["source_text"]).alias("source_text"),
                        F.concat(F.lit(W.ANCHOR_REASON[0]), x["n"]["node_type"], F.lit(W.ANCHOR_REASON[1])).alias("reasoning"), F.lit(0.9).alias("confidence"))

    g = g.withColumn("edges", F.when(F.size("_called") > 0, F.concat(edges, F.transform(new, made))).otherwise(edges))
    return g.drop("_patient", "_moved", "_top", "_called", "_have")


def validated(graphs: DataFrame, rules: Rules) -> DataFrame:
    """Node texts, dangling edges and endpoint types (L1 to L3)."""
    nodes, edges, text = F.col("nodes"), F.col("edges"), F.col("text")

    def good(n: Column) -> Column:
        exempt = (n["node_type"] == "PATIENT") & (n["implicit"] | (n["source_text"] == P.IMPLICIT_TEXT))
        return F.coalesce(exempt, F.lit(False)) | F.coalesce(F.contains(text, n["source_text"]), F.lit(False))

    g = graphs.withColumn("_judged", F.transform(nodes, lambda n: F.struct(n.alias("n"), good(n).alias("ok"))))
    g = g.withColumns({"nodes": F.transform(F.filter("_judged", lambda x: x["ok"]), lambda x: x["n"]), "warnings": F.concat("warnings", F.transform(F.filter("_judged", lambda x: ~x["ok"]), lambda x: F.struct(F.lit("HARD-node").alias("code"), x["n"]["node_id"].alias("message"))))})
    g = g.withColumns({"_s": _types(nodes, _values(edges, "source_node_id")), "_t": _types(nodes, _values(edges, "target_node_id")), "_ids": _values(nodes, "node_id")})

    def checked(e: Column, ends: Column) -> Column:
        there = lambda name: within(F.col("_ids"), e[f"{name}_node_id"])
        lost = lambda name: F.concat_ws(" ", e["edge_id"], F.lit(name), F.coalesce(e[f"{name}_node_id"], F.lit("null")))
        s, t = ends["_s"], ends["_t"]
        wrong = ~(_legal(rules, 0, e["edge_type"], s) & _legal(rules, 1, e["edge_type"], t))
        return F.struct(e.alias("e"), F.when(~there("source"), F.struct(F.lit("HARD-dangling").alias("code"), lost("source").alias("message"))).when(~there("target"), F.struct(F.lit("HARD-dangling").alias("code"), lost("target").alias("message")))
                        .when(wrong, F.struct(F.lit("HARD-endpoint").alias("code"), F.concat_ws(" ", e["edge_id"], e["edge_type"], s, t).alias("message"))).alias("w"))

    g = g.withColumn("_judged", F.zip_with(edges, F.arrays_zip("_s", "_t"), checked))
    g = g.withColumns({"edges": F.transform(F.filter("_judged", lambda x: x["w"].isNull()), lambda x: x["e"]), "warnings": F.concat("warnings", F.array_compact(F.transform("_judged", lambda x: x["w"])))})
    return g.drop("_judged", "_s", "_t", "_ids")


def in_doubt(text: Column, edge: Column, threshold: float = THRESHOLD) -> Column:
    """Whether an edge of low (or null) confidence, or without evidence in the text, needs a review (L4)."""
    return ~F.coalesce((edge["confidence"] >= threshold) & F.contains(text, edge["source_text"]), F.lit(False))


def for_review(graphs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The edges in doubt as a table: requests for a reviewer."""
    return rows_of(graphs.withColumn("edges", F.filter("edges", lambda e: in_doubt(F.col("text"), e, threshold))), "edges")


VERDICT_TYPE = "array<struct<ord:int,verdict:string,verdict_reason:string,edge_id:string>>"


def nested_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts by chunk as an array; of several on an edge the last by ``pos`` counts, or without it the most cautious."""
    caution = F.when(F.col("verdict") == "invalid", 2).when(F.col("verdict") == "low_confidence", 1).otherwise(0)
    order = F.col("pos").cast("int") if "pos" in verdicts.columns else caution
    return verdicts.groupBy(K).agg(F.sort_array(F.collect_list(F.struct(order.alias("ord"), "verdict", "verdict_reason", "edge_id"))).cast(VERDICT_TYPE).alias("verdicts"))


def reviewed(graphs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verdicts applied (L5) from the array ``verdicts``: invalid edges go, ``low_confidence`` ones (and those in doubt without
    a verdict) are flagged."""
    last = F.reverse(F.array_sort("verdicts"))
    g = graphs.withColumn("_said", lookup(_values(F.col("edges"), "edge_id"), _values(last, "edge_id"), F.transform(last, lambda v: F.struct(v["verdict"].alias("v"), v["verdict_reason"].alias("r")))))
    judged = F.zip_with("edges", "_said", lambda e, s: F.struct(e.alias("e"), F.when(in_doubt(F.col("text"), e, threshold), F.coalesce(s["v"], F.lit("low_confidence"))).otherwise("valid").alias("v"), s["r"].alias("r")))
    g = g.withColumn("_judged", judged)
    warned = F.transform(F.filter("_judged", lambda x: x["v"] != "valid"), lambda x: F.struct(F.when(x["v"] == "invalid", "SOFT-invalid").otherwise("SOFT-low_conf").alias("code"), F.concat_ws(" ", x["e"]["edge_id"], x["r"]).alias("message")))
    kept = F.transform(F.filter("_judged", lambda x: x["v"] != "invalid"), lambda x: F.struct(*[x["e"][f].alias(f) for f in _EDGE], (x["v"] == "low_confidence").alias("low_confidence")))
    return g.withColumns({"edges": kept, "warnings": F.concat("warnings", warned)}).drop("_said", "_judged", "verdicts")
