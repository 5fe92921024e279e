"""Batch model calls: one contract for all.

``apply_model`` sends requests (rows) to a function in batches and gives its rows a fixed schema; what fails
becomes ``status='error'`` and never stops the job. Requests are known by their digest: equal ones are asked once, joins
carry digests and not texts, and with a ``store`` answers are kept in a table, so that a job that runs again asks only what
has no answer yet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TimedOut

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.functions.tables import settled


def render(template: str, **values: Column) -> Column:
    """A template with ``{name}`` slots as a column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def _stored(df: DataFrame, store: str | None, schema: T.StructType) -> DataFrame:
    """The answers of a store; none where it isn't there yet."""
    spark = df.sparkSession
    try:
        return spark.read.schema(schema).parquet(store) if store else spark.createDataFrame([], schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _caller(fn: Callable[[list[str]], list[dict]], names: list[str], retries: int, backoff: float, timeout: float | None) -> Callable[[list[str]], list[dict]]:
    """A function that gives each request of a batch an answer or an error (see ``apply_model``)."""
    def failed(error: Exception) -> dict:
        return {"status": "error", "error": (str(error) or type(error).__name__)[:200], **dict.fromkeys(names)}

    def fit(answer: dict) -> dict:
        if set(answer) != set(names):
            return failed(ValueError("the answer's fields are not the schema's"))
        return {"status": "ok", "error": None, **answer}

    def called(texts: list[str]) -> list[dict]:
        if timeout is None:
            got = fn(texts)
        else:
            pool = ThreadPoolExecutor(1)
            try:
                got = pool.submit(fn, texts).result(timeout)
            except TimedOut:
                raise TimeoutError(f"no answer within {timeout} seconds") from None
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        if len(got) != len(texts):
            raise ValueError("an answer is missing")
        return got

    def tried(texts: list[str]) -> list[dict]:
        for attempt in range(retries + 1):
            try:
                return [fit(a) for a in called(texts)]
            except Exception as error:  # any failure of the model is a row, not a failed job
                last = error
                if attempt < retries:
                    time.sleep(backoff * 2**attempt)
        return [failed(last)] if len(texts) == 1 else [a for t in texts for a in tried([t])]

    return tried


#: Characters of requests that are written out at once, whatever the batch.
REQUEST_CHARS = 1 << 24


def apply_model_within(df: DataFrame, context: str, items: str, item_key: str, slots: dict[str, str], template: str, fn: Callable[[list[str]], list[dict]], schema: T.StructType | str,
                       batch: int = 64, partitions: int | None = None, retries: int = 2, backoff: float = 0.0, timeout: float | None = None, parallel: int = 1) -> DataFrame:
    """As ``apply_model`` for requests that share a long context: a row has a text ``context`` and an array ``items`` of structs, and
    each item is a request, the template with ``{context}`` and its ``slots`` (slot: field of the item). The row's other columns,
    ``item_key`` (a field of the item), ``status``, ``error`` and the columns of ``schema``, one row for each item.

    The requests of a row are as many times as long as their context as there are items, so they are written out where they are
    asked, some at a time, and are neither shuffled nor stored: a row's text and items go there once. They aren't compared
    either: each is asked."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    tried = _caller(fn, schema.names, retries, backoff, timeout)
    keep = [c for c in df.columns if c not in (context, items)]
    item = df.schema[items].dataType.elementType
    out = T.StructType([*(df.schema[c] for c in keep), item[item_key], T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *schema.fields])

    def written_out(text: str | None, x: dict) -> str:  # slot by slot, as render does
        request = template
        for slot, field in slots.items():
            request = request.replace("{" + slot + "}", "" if x[field] is None else str(x[field]))
        return request.replace("{context}", text or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def answered(asked: list[tuple[dict, str]], pool: ThreadPoolExecutor) -> pa.RecordBatch:
            parts = [[r for _, r in asked[i : i + batch]] for i in range(0, len(asked), batch)]
            answers = [a for part in (pool.map(tried, parts) if parallel > 1 else map(tried, parts)) for a in part]
            return pa.RecordBatch.from_pylist([{**k, **a} for (k, _), a in zip(asked, answers, strict=True)], schema=arrow)

        with ThreadPoolExecutor(parallel) as pool:
            asked: list[tuple[dict, str]] = []
            size = 0
            for rows in batches:
                for i in range(rows.num_rows):
                    text, own = rows.column(context)[i].as_py(), {c: rows.column(c)[i].as_py() for c in keep}
                    for x in rows.column(items)[i].as_py() or ():
                        asked.append(({**own, item_key: x[item_key]}, written_out(text, x)))
                        size += len(asked[-1][1])
                        if len(asked) == batch * parallel or size > REQUEST_CHARS:
                            yield answered(asked, pool)
                            asked, size = [], 0
            if asked:
                yield answered(asked, pool)

    rows = df.select(*keep, context, items)
    return settled((rows.repartition(partitions) if partitions else rows).mapInArrow(run, out), "answers")


def apply_model(df: DataFrame, request: str, fn: Callable[[list[str]], list[dict]], schema: T.StructType | str, batch: int = 64, partitions: int | None = None,
                store: str | None = None, waves: int = 1, retries: int = 2, backoff: float = 0.0, timeout: float | None = None, parallel: int = 1) -> DataFrame:
    """``df`` with ``status`` ('ok' or 'error'), ``error`` and the columns of ``schema``.

    ``fn`` takes a list of requests and returns a dict for each. A batch that raises, or takes longer than ``timeout`` seconds, is
    tried ``retries`` times more, ``backoff`` seconds apart and twice as long each time, then row by row; only rows that
    still raise are errors, and so is an answer that doesn't fit the schema. At most ``partitions`` tasks run at a time with
    ``parallel`` batches each.

    The answers are written before they are used, so nothing is asked twice for being read twice. With ``store`` (a path that
    all can reach) good answers are appended to it after each of ``waves`` parts of the requests: a job that dies has lost one
    wave at most, and the next run asks for what is missing; errors are asked again.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names
    kept = T.StructType([T.StructField("_digest", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *schema.fields])

    tried = _caller(fn, names, retries, backoff, timeout)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            for frame in frames:
                texts, digests = frame[request].tolist(), frame["_digest"].tolist()
                answers = [a for part in pool.map(tried, [texts[i : i + batch] for i in range(0, len(texts), batch)]) for a in part]
                yield pd.DataFrame([{"_digest": d, **a} for d, a in zip(digests, answers, strict=True)], columns=kept.names)

    keyed = df.withColumn("_digest", F.sha2(F.coalesce(request, F.lit("")), 256))
    one = Window.partitionBy("_digest").orderBy(F.lit(0))
    asked = keyed.select("_digest", request).withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    missing = asked.join(_stored(df, store, kept).select("_digest"), "_digest", "left_anti")
    made = []
    for wave in range(waves):
        part = missing if waves == 1 else missing.filter(F.pmod(F.xxhash64("_digest"), F.lit(waves)) == wave)
        part = part.repartition(partitions) if partitions else part
        made.append(settled(part.mapInPandas(run, kept), "answers"))
        if store:
            made[-1].filter("status = 'ok'").write.mode("append").parquet(store)
    answers = made[0]
    for more in made[1:]:
        answers = answers.unionByName(more)
    if store:  # what this run got wrong is in none of the stored answers
        answers = _stored(df, store, kept).dropDuplicates(["_digest"]).unionByName(answers.filter("status <> 'ok'"))
    return keyed.join(answers, "_digest", "left").drop("_digest")
