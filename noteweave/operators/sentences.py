"""Notes to sentences with exact offsets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions.text import RARE_LINE_ENDS, is_blank, tiles
from noteweave.sources.packs import Pack


def split_sentences(cases: DataFrame, pack: Pack) -> DataFrame:
    """``case_id, text_hash, index, start_char, end_char, text`` of every sentence that isn't blank, numbered
    from 1. Line ends cut; ``\\n`` and ``\\r`` belong to no sentence, rarer ones stay at the end of theirs.
    The tiles of a text don't overlap, so their order is that of their starts, and the numbering needs no
    shuffle."""
    text = F.col("raw_text")
    far = [c for c in RARE_LINE_ENDS if ord(c) > 255]
    # Java tests a class of characters under 256 by a table and any other one many times slower; nearly all texts need none
    near = tiles(text, pack.sentence_pattern(rare="".join(c for c in RARE_LINE_ENDS if c not in far)))
    tiled = F.when(reduce(or_, [F.contains(text, F.lit(c)) for c in far]), tiles(text, pack.sentence_pattern())).otherwise(near)
    found = F.filter(tiled, lambda t: ~is_blank(t["text"]))
    return cases.select("case_id", "text_hash", F.posexplode(found).alias("i", "t")).select(
        "case_id", "text_hash", (F.col("i") + 1).alias("index"), F.col("t.start").alias("start_char"), F.col("t.end").alias("end_char"), F.col("t.text").alias("text"))


def number_sentences(spans: DataFrame) -> DataFrame:
    """Sentences from an outside tokenizer (``case_id, start_char, end_char, text``): blank ones dropped,
    distinct by span, numbered 1..n by start."""
    from pyspark.sql import Window

    distinct = spans.filter(~is_blank(F.col("text"))).dropDuplicates(["case_id", "start_char", "end_char"])
    return distinct.withColumn("index", F.row_number().over(Window.partitionBy("case_id").orderBy("start_char", "end_char")))
