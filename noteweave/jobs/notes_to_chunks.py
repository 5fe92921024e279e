"""Notes to sections and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from noteweave.functions.tables import settled
from noteweave.operators import chunks as C
from noteweave.operators import labels, sections, sentences
from noteweave.sources.notes import dedupe_cases, read_cases_table, validate_cases
from noteweave.sources.packs import Pack


def cases(docs: DataFrame) -> DataFrame:
    """Distinct notes with text, from a table."""
    return dedupe_cases(validate_cases(read_cases_table(docs))[0])


def labelled_sentences(notes: DataFrame, pack: Pack) -> DataFrame:
    return labels.inherit_labels(labels.label_by_rules(sentences.split_sentences(notes, pack), pack), pack)


def sections_of(notes: DataFrame, pack: Pack) -> DataFrame:
    return sections.with_text(sections.build_sections(labelled_sentences(notes, pack)), notes)


def stages_of(notes: DataFrame, pack: Pack) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, their labelled sentences and their sections (with text) as written tables: each is worked out once, however many
    steps read it."""
    notes = settled(notes, "notes")
    rows = settled(labelled_sentences(notes, pack), "sentences")
    return notes, rows, settled(sections.with_text(sections.build_sections(rows), notes), "sections")


def chunks_from(parts: DataFrame, rows: DataFrame, pack: Pack, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sections to chunks; ``propose`` makes the proposals (as ``build_chunks`` takes them) from labelled sentences."""
    return C.build_chunks(parts, propose(rows), chunk_type=pack.default_chunk_type)


def chunks_of(notes: DataFrame, pack: Pack, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Notes to chunks."""
    _, rows, parts = stages_of(notes, pack)
    return chunks_from(parts, rows, pack, propose)
