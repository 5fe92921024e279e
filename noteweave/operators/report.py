"""Counts and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.spans import gaps


def type_counts(dimension: DataFrame, **tables: tuple[DataFrame, str]) -> DataFrame:
    """``kind, name, n``: how often each type of each kind occurs, 0 for those of the dimension (``kind, name``)
    that don't, and those outside it too. ``tables``: kind=(table, type column)."""
    counted = [df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n") for kind, (df, c) in sorted(tables.items())]
    return dimension.join(reduce(DataFrame.unionByName, counted), ["kind", "name"], "full").select("kind", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def case_stats(cases: DataFrame, by: str = "text_hash", **counted: DataFrame) -> DataFrame:
    """The case's key, ``n_chars`` and ``n_<name>`` rows of each table for each case, 0 without any."""
    out = cases.select(by, F.length("raw_text").alias("n_chars"))
    for name, df in sorted(counted.items()):
        out = out.join(df.groupBy(by).agg(F.count("*").alias(f"n_{name}")), by, "left").na.fill(0, [f"n_{name}"])
    return out


def coverage(cases: DataFrame, spans: DataFrame, kind: Column) -> DataFrame:
    """Labelled pieces of each note and the rest of it (null label), blank stretches too."""
    own = spans.select("text_hash", F.col("start_char").alias("start"), F.col("end_char").alias("end"), kind.alias("label"))
    frame = cases.select("text_hash", F.lit(0).alias("start"), F.length("raw_text").alias("end"))
    return own.unionByName(gaps(own, frame, ["text_hash"]).select("text_hash", "start", "end", F.lit(None).cast("string").alias("label")))


def chunk_listing(chunks: DataFrame, by: list[str]) -> DataFrame:
    """For each section its number of chunks, their numbers in order, and the length they span."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.array_join(F.sort_array(F.collect_list("chunk_index")).cast("array<string>"), ", ").alias("chunk_list"), (F.max("end_char") - F.min("start_char")).alias("span_length"))


def section_listing(sections: DataFrame) -> DataFrame:
    """For each section its sentences (``S1, S2``) in order, and its length."""
    names = F.transform(F.array_sort("sentence_indices"), lambda i: F.concat(F.lit("S"), i.cast("string")))
    return sections.select("text_hash", "section_index", "section_id", F.array_join(names, ", ").alias("sentence_list"), (F.col("end_char") - F.col("start_char")).alias("span_length"))
