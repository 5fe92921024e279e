"""The end-to-end job: notes in, nested documents and section graphs out, by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions.tables import settled
from noteweave.jobs import graphs as G
from noteweave.jobs import notes_to_chunks as N
from noteweave.operators import chunk_graph, sections
from noteweave.operators.annotate import graphable_chunks
from noteweave.operators.chunks import build_chunks
from noteweave.sources import notes
from noteweave.sources.packs import Pack


def write_batch(documents: DataFrame, path: str, batch: str, fmt: str = "json") -> None:
    """Writes a batch's rows as its partition ``batch=...`` of a table of documents. A repeated run replaces its own partition,
    whole and at once, and leaves the others as they are; a batch without rows replaces nothing."""
    rows = documents.withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").format(fmt).save(path)


def run_notes(docs: DataFrame, pack: Pack, rules: chunk_graph.Rules, propose_chunks: Callable[[DataFrame], DataFrame], propose_graph: Callable[[DataFrame], DataFrame],
              review_with: Callable[[DataFrame], DataFrame], path: str, batch: str) -> dict[str, str]:
    """Notes (``doc_id, text``) to ``path/cases``, a nested document for each case, ``path/graphs``, one for each section's
    graph, and ``path/rejected``, what was left out and why. The proposals and verdicts come from functions or from
    tables of models' answers. Returns the three paths.

    Texts are distinct before anything is keyed by them; each stage that several others read is a written table, so a lost
    executor costs a stage's part and not the job.
    """
    good, bad = notes.validate_cases(notes.read_cases_table(docs))
    cases = settled(notes.dedupe_cases(good), "cases")
    rows = settled(N.labelled_sentences(cases, pack), "sentences")
    parts = settled(sections.with_text(sections.build_sections(rows), cases), "sections")
    chunks = settled(build_chunks(parts, propose_chunks(rows), chunk_type=pack.default_chunk_type), "chunks")
    graph = G.checked_rows(graphable_chunks(chunks).select("chunk_id", "case_id", "section_index", "chunk_index", "text", "chunk_type"), pack, rules, propose_graph, review_with)
    merged = G.merged_sections(graph)
    out = {name: f"{path}/{name}" for name in ("cases", "graphs", "rejected")}
    write_batch(notes.case_documents(cases, rows, parts, chunks), out["cases"], batch)
    write_batch(notes.section_graph_documents(merged["nodes"], merged["edges"], merged["frames"]), out["graphs"], batch)
    write_batch(bad.select("source_file", "reason"), out["rejected"], batch)
    return out
