"""A training corpus from documents, in five stages.

Quality rules, MinHash near-dedup, benchmark decontamination, PII surrogates, byte-level BPE. Each stage
works on all that the one before kept, written as Parquet in the shared folder and read again, so a lost
executor costs one stage's tasks at most. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import bpe, decontam, neardup, pii, quality
from noteweave.llm.common import read, written

#: The surrogates' key. A real job passes its own secret.
PII_KEY = "surrogates of the pipeline"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the rules and removes the lines that too many documents of a source hold."""
    return quality.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id. Rows without an
    id stay; of rows equal in id and text one stays."""
    names = docs.columns
    kept = neardup.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    stays = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return stays.select(names).unionByName(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its edit budget, go."""
    marked = decontam.mark_leaks(docs, read(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("leaks") == 0).select(docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts."""
    return pii.replace_pii(docs, PII_KEY).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids, and the digest of what they decode to."""
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("ids", "n_tokens", "decoded_sha256"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii surrogates", pii_surrogates),
    ("byte-level bpe", byte_bpe),
]

#: SQL can't express the aligned leaks, the keyed surrogates or the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i + 1}")
    return docs
