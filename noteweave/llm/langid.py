"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fitting takes a bounded sample: for each language the ``per_lang`` documents of smallest hash of
their id (all of them where there are fewer), whole texts. A hot language is ranked in SALTS parts first, so
no task ranks more than ``per_lang`` of each part. Counts are summed by Spark, and the model (buckets x
languages log probabilities) has CELLS entries at most on any input, so it is broadcast: the more languages,
the fewer buckets. Scoring runs over all rows, a batch at a time in numpy: hash the n-grams of the batch,
gather their rows of the matrix, sum them by document. Priors are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.llm.common import read, written

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Entries of the model's matrix, at most; up to 512 languages have all buckets.
CELLS = 1 << 24
#: Documents of each language to learn from, at most.
PER_LANG = 500
#: Parts that the documents of one language are ranked in.
SALTS = 16
SMOOTHING = 0.5
#: Characters that are scored at once.
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_SEP = "\n" * max(ORDERS)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # buckets x languages


def buckets_for(n_langs: int) -> int:
    """A power of two: all buckets, or as many as the matrix has room for (one at least)."""
    return min(BUCKETS, 1 << max(0, (CELLS // max(1, n_langs)).bit_length() - 1))


def _grams(chars: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The bucket of the n-gram that starts at each character (the last ones run over the end into
    separators), one array for each order."""
    c = np.concatenate((chars, np.full(max(ORDERS), 10, dtype=np.uint32)))
    h = np.zeros(len(chars), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h ^ c[n - 1 : n - 1 + len(chars)]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield (h * np.uint32(0xC2B2AE35) >> np.uint32(17)) & np.uint32(buckets - 1)


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Characters of folded texts, and for each text with a letter: its place, start and end. A text
    longer than a chunk comes in several pieces that overlap by the longest n-gram less one."""
    made: list[str] = []
    spans: list[tuple[int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if not t or not _LETTER.search(t):
            continue
        t = t.lower()
        for at in range(0, len(t), CHUNK):
            piece = t[at : at + CHUNK + max(ORDERS) - 1]
            if size and size + len(piece) > CHUNK:
                yield np.frombuffer("".join(made).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), spans
                made, spans, size = [], [], 0
            spans.append((i, size, size + min(len(piece), CHUNK)))
            made += [piece, _SEP]
            size += len(piece) + len(_SEP)
    if spans:
        yield np.frombuffer("".join(made).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), spans


def choose(known: DataFrame, per_lang: int = PER_LANG, salts: int = SALTS) -> DataFrame:
    """``id, lang`` of the ``per_lang`` rows of smallest hash of each language, ranked by part and then once more
    among the parts' best."""
    hashed = known.select("id", "lang", F.xxhash64("id").alias("h"))
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(salts))).orderBy("h", "id")
    best = hashed.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= per_lang)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("rank") <= per_lang).select("id", "lang").distinct()


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learn from the rows with a non-null language and text. Without any, the model knows no language."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen = written(choose(known, per_lang), "chosen")
    langs = tuple(sorted(r["lang"] for r in chosen.select("lang").distinct().collect()))
    if not langs:
        return Model((), np.zeros((1, 0), dtype=np.float32))
    buckets = buckets_for(len(langs))
    ids = chosen.select(F.col("id").alias("cid"), F.col("lang").alias("clang"))
    sample = known.join(ids, known["id"].eqNullSafe(ids["cid"]) & (known["lang"] == ids["clang"]), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for name in sorted(set(names)):
                total = np.zeros(buckets, dtype=np.int64)
                for chars, spans in _chunks([t for t, x in zip(texts, names, strict=True) if x == name]):
                    inside = np.zeros(len(chars), dtype=bool)
                    for _, a, b in spans:
                        inside[a:b] = True
                    for g in _grams(chars, buckets):
                        total += np.bincount(g[inside], minlength=buckets)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    table = np.full((buckets, len(langs)), SMOOTHING)
    table[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(langs)})] += counts["n"]
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


def score(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and posterior of each text; ``und`` and 0 for null, for texts without a letter, and where no
    language has been learned."""
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    total = np.zeros((len(texts), len(model.langs)))
    seen = np.zeros(len(texts), dtype=bool)
    for chars, spans in _chunks(texts):
        bounds = np.array([x for _, a, b in spans for x in (a, b)])
        each = np.zeros((len(spans), len(model.langs)))
        for g in _grams(chars, len(model.logp)):
            for k in range(len(model.langs)):
                each[:, k] += np.add.reduceat(model.logp[:, k][g].astype(np.float64), bounds[: 2 * len(spans)])[::2]
        for (i, _, _), x in zip(spans, each, strict=True):
            total[i] += x
            seen[i] = True
    best = total.argmax(axis=1) if len(texts) else np.zeros(0, dtype=int)
    odds = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)) if len(texts) else total
    p = 1 / odds.sum(axis=1) if len(texts) else []
    return [model.langs[b] if s else "und" for b, s in zip(best, seen, strict=True)], [float(x) if s else 0.0 for x, s in zip(p, seen, strict=True)]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` (a learned language, or ``und`` where the text is null or has no
    letter, or nothing was learned) and ``score`` (its posterior, 0 for ``und``). Ties go to the first language by name.
    Columns of the input with these names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in keep if c != text), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score(batch.column(text).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep if c != text), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema])

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(doc_id: str):
    """Whether a document is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learned from those that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = fit(learn)
    return predict(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
