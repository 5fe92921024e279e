"""Notes as they arrive: the same sections from a stream of files.

The stream is keyed and deduplicated by the text's hash in Spark's state store, so neither the sink nor other
notes are read again. A hash is remembered for a time after it arrived (``remember``), so the state is as large as that time's
notes and not as the stream's; a text that comes again later is taken as new. Arrival is the micro-batch's own time, so no
note is ever late. The notes' own operators have no state across notes: a batch job labels each micro-batch, and
writes it to the batch's own partition of the sink, which a repeated batch overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from noteweave.jobs.notes_to_chunks import labelled_sentences
from noteweave.operators.sections import build_sections
from noteweave.sources.notes import keyed, validate_cases
from noteweave.sources.packs import Pack


def stream_sections(spark: SparkSession, source: str, sink: str, checkpoint: str, pack: Pack, trigger: dict | None = None, remember: str = "30 days") -> StreamingQuery:
    """Adds the sections of new ``*.txt`` notes under ``source`` to the Parquet table ``sink``, partitioned by
    ``batch``."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(source).selectExpr("value AS raw_text", "_metadata.file_name AS source_file")
    new = validate_cases(keyed(raw))[0].withColumn("arrived", F.current_timestamp()).withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["text_hash"])

    def put(batch: DataFrame, number: int) -> None:
        build_sections(labelled_sentences(batch, pack)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
