"""Chunks to annotations, and proposed graphs to section graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions.tables import settled
from noteweave.functions.text import is_blank
from noteweave.operators import chunk_graph as C
from noteweave.operators import merge, section_graph
from noteweave.sources.packs import Pack

K = "chunk_id"


def line_chunks(cases: DataFrame) -> DataFrame:
    """Every line with text is a chunk, every five lines of a note a section."""
    rows = cases.select("case_id", F.posexplode(F.split("raw_text", "\n")).alias("i", "text")).filter(~is_blank(F.col("text")))
    n = F.col("i") + 1
    return rows.select(F.format_string("%s_l%05d", F.col("case_id"), n).alias(K), "case_id", ((F.col("i") / 5).cast("int") + 1).alias("section_index"), n.alias("chunk_index"), "text",
                       F.when(n % 7 == 0, "diagnosis_entry").otherwise("clinical_state").alias("chunk_type"))


def from_tables(propose: Callable[..., tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """A function on annotated chunks from one that makes tables of nodes and edges from chunks, entities and status rows."""
    def proposed(chunks: DataFrame) -> DataFrame:
        nodes, edges = propose(chunks.drop("entities", "status"), C.rows_of(chunks, "entities"), C.rows_of(chunks, "status"))
        return C.with_arrays(chunks, nodes=C.nested(nodes, "nodes", C.NODE_TYPE), edges=C.nested(edges, "edges", C.EDGE_TYPE))

    return proposed


def checked_rows(chunks: DataFrame, pack: Pack, rules: C.Rules, propose: Callable[[DataFrame], DataFrame], review_with: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks to overridden, anchored, validated and reviewed chunk graphs, one row each. ``propose`` adds ``nodes`` and
    ``edges`` to annotated chunks, ``review_with`` makes verdicts on a table of doubtful edges. Up to the review it is
    one projection; the verdicts come back by a join on the chunk."""
    graphs = settled(C.validated(C.anchored(C.overridden(propose(C.annotated(chunks, pack))), rules), rules), "graphs")
    return settled(C.reviewed(C.with_arrays(graphs, verdicts=C.nested_verdicts(review_with(C.for_review(graphs))))), "reviewed")


def checked_graph(chunks: DataFrame, pack: Pack, rules: C.Rules, propose: Callable[[DataFrame], DataFrame], review_with: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """``checked_rows`` as tables: ``nodes, edges, frames, warnings``, and the ``rows`` themselves."""
    rows = checked_rows(chunks, pack, rules, propose, review_with)
    return {"rows": rows} | {name: C.rows_of(rows, name) for name in ("nodes", "edges", "frames", "warnings")}


def merged_sections(rows: DataFrame) -> dict[str, DataFrame]:
    """Chunk graphs in rows to section graphs: ``nodes, edges, frames``. One shuffle, by section."""
    sections = settled(section_graph.section_rows(rows), "section_graphs")
    return {name: section_graph.rows_of(sections, name) for name in ("nodes", "edges", "frames")}


def section_graphs(chunks: DataFrame, graph: dict[str, DataFrame], coreference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Chunk graphs in tables to section graphs, with verdicts on coreference where there are some: ``nodes, edges, frames``."""
    order = merge.graph_order(chunks)
    order = settled(order, "order")
    resolved = settled(merge.resolve_entities(merge.collect_nodes(graph["nodes"], order)), "resolved")
    if coreference is not None:
        resolved = settled(merge.apply_coreference(resolved, coreference), "resolved")
    nodes, ids = merge.section_nodes(resolved)
    nodes, ids = settled(nodes, "entities"), settled(ids, "ids")
    edges = settled(merge.section_edges(merge.collect_edges(graph["edges"], order), ids), "section_edges")
    return {"nodes": nodes, "edges": edges, "frames": merge.section_frames(graph["frames"], order, ids, edges)}
