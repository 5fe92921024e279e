"""Notes in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.functions.text import case_id, is_blank, text_hash


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One note for each ``*.txt`` file, whole, with its file name. Hidden files (and, as Spark has it, those
    that start with an underscore) are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return keyed(raw.select(F.col("value").alias("raw_text"), F.col("_metadata.file_name").alias("source_file")))


def read_cases_table(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Notes from a table; ``source_file`` is the row's key."""
    return keyed(df.select(F.col(text).alias("raw_text"), F.col(key).cast("string").alias("source_file")))


def keyed(notes: DataFrame) -> DataFrame:
    h = text_hash(F.col("raw_text"))
    return notes.select(case_id(h).alias("case_id"), h.alias("text_hash"), "raw_text", "source_file")


def validate_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes with text, and the rejected ones (null or blank) with a reason."""
    blank = F.coalesce(is_blank(F.col("raw_text")), F.lit(True))
    return cases.filter(~blank), cases.filter(blank).withColumn("reason", F.when(F.col("raw_text").isNull(), "null text").otherwise("blank text"))


def dedupe_cases(cases: DataFrame) -> DataFrame:
    """One row for each distinct text, with the smallest source and the number of copies. Ids come from the
    text, so this goes before any window by case.

    Texts never enter an aggregate: copies are counted by their hashes, and the row of smallest source is told by its rank,
    which Spark also limits to one row a hash before the shuffle."""
    copies = cases.groupBy("text_hash").agg(F.count("*").alias("copies"))
    first = F.row_number().over(Window.partitionBy("text_hash").orderBy(F.col("source_file").asc_nulls_last()))
    rows = cases.withColumn("_first", first).filter("_first = 1").select("text_hash", "case_id", "raw_text", "source_file")
    return rows.join(copies, "text_hash").select("text_hash", "case_id", "raw_text", "source_file", "copies")


def case_links(cases: DataFrame) -> DataFrame:
    """Which case every source became."""
    return cases.select("source_file", "case_id", "text_hash")


def _nested(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    rest = order + [c for c in rest if c not in order]
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def case_documents(cases: DataFrame, sentences: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """One nested row for each case, ready for ``write.json``: its sentences, sections and chunks in order."""
    out = cases.select("case_id", "text_hash", "source_file")
    for df, order, name in ((sentences, ["index"], "sentences"), (sections, ["section_index"], "sections"), (chunks, ["section_index", "chunk_index"], "chunks")):
        out = out.join(_nested(df.drop("text_hash"), ["case_id"], order, name), "case_id", "left")
    return out


def section_graph_documents(nodes: DataFrame, edges: DataFrame, frames: DataFrame) -> DataFrame:
    """One nested row for each section graph."""
    by = ["case_id", "section_index"]
    out = _nested(nodes, by, ["node_id"], "nodes")
    for df, order, name in ((edges, ["edge_id"], "edges"), (frames, ["frame_id"], "frames")):
        out = out.join(_nested(df, by, order, name), by, "left")
    return out


def graph_elements(nodes: DataFrame, edges: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows for a viewer: a label cut to 22 characters with its mark, and classes by category (``node_type,
    category``), negation and certainty."""
    text = F.when(F.col("implicit") & (F.col("node_type") == "PATIENT"), "患者").otherwise(F.col("source_text"))
    label = F.when(F.length(text) > 22, F.concat(F.substring(text, 1, 22), F.lit("…"))).otherwise(text)
    negated = F.when(F.col("negated"), "negated")
    sure = F.when(F.col("certainty").isin("suspected", "uncertain"), "uncertain").when(F.col("certainty") == "excluded", "excluded")
    n = nodes.join(categories, "node_type", "left").select(
        "case_id", "section_index", F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"),
        F.concat(F.when(F.col("negated"), "¬ ").otherwise(""), label).alias("label"), F.concat_ws(" ", F.concat(F.lit("node ntype-"), F.coalesce("category", F.lit("unknown"))), negated, sure).alias("classes"))
    e = edges.select(
        "case_id", "section_index", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target"),
        F.concat(F.when(F.col("negated"), "¬ ").when(F.col("low_confidence"), "? ").otherwise(""), F.col("edge_type")).alias("label"), F.concat_ws(" ", F.lit("edge"), negated, F.when(F.col("low_confidence"), "low-conf")).alias("classes"))
    return n.unionByName(e)


def write_stage(df: DataFrame, path: str, stage: str) -> None:
    """Appends a stage's rows for audit."""
    df.withColumn("stage", F.lit(stage)).write.mode("append").partitionBy("stage").parquet(path)
