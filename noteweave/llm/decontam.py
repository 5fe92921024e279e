"""Benchmark decontamination by q-gram lemma filtering.

An item of m bytes that occurs in a text with at most k edits shares at least m + 1 - q(k + 1)
q-grams with it, on diagonals that lie within k of each other. So the shared q-grams of each item are
counted in overlapping bands of diagonals; the bands that reach the bound are verified by a banded
alignment, and what is within the edit budget is a leak. An item that is too short for its budget at q = Q takes the
largest q whose bound is at least one. An item shorter than Q bytes is looked for exactly, as a whole word.

The benchmark is the query set: it is read in blocks of bounded size, each of them broadcast and held
against all documents in one pass without a shuffle. Of several blocks, each has a job of its own, which writes the
leaks of the texts that have some by the text's digest, and its broadcast ends with it: one index lives at a
time. A text goes through in segments, and its hits in batches: what a worker holds is bounded by the block, a segment
and a batch, however long or repetitive the texts are. Counts of bands that no later hit can reach are settled and
dropped.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.llm.common import read, written

Q = 10
#: Edits allowed for each byte of an item.
EDIT_RATE = 0.08
#: Bytes of items in a block.
BLOCK_BYTES = 8_000_000
#: Bytes of text whose q-grams are held at once, and pairs of a text's and an item's q-gram.
CHUNK = 1_000_000
HITS = 2_000_000
_BITS = 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_U = np.uint64

LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("shared", T.IntegerType())]))


def fold(text: str | bytes) -> bytes:
    """UTF-8 with A-Z in lower case and every white space byte as a space: offsets stay."""
    raw = text.encode() if isinstance(text, str) else text
    return _FOLD[np.frombuffer(raw, dtype=np.uint8)].tobytes() if raw else b""


def gram_codes(b: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q bytes that start at each place."""
    if len(b) < q:
        return np.zeros(0, dtype=np.uint64)
    if q < Q:
        h = np.full(len(b) - q + 1, q, dtype=np.uint64)
        for j in range(q):
            h = (h ^ b[j : j + len(h)]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(32)
        return h
    two = b[:-1].astype(np.uint64) | b[1:].astype(np.uint64) << _U(8)
    four = two[:-2] | two[2:] << _U(16)
    h = four[:-4] | four[4:] << _U(32)
    h = h[: len(b) - Q + 1] * _U(0x9E3779B97F4A7C15) + two[8 : 8 + len(b) - Q + 1] * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


@dataclass
class Items:
    """A block of the benchmark and its q-grams, sorted by hash."""

    ids: list[int]
    texts: list[bytes]
    edits: np.ndarray
    q: np.ndarray
    least: np.ndarray
    codes: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    known: np.ndarray
    short: dict[bytes, list[int]]  # ids of the items without a q-gram, by their text


def index_items(rows: list[tuple[int, str]], rate: float = EDIT_RATE) -> Items:
    folded = [(i, fold(t).strip()) for i, t in rows if t is not None]
    rows = [(i, t) for i, t in folded if len(t) >= Q]
    short: dict[bytes, list[int]] = {}
    for i, t in folded:
        if 0 < len(t) < Q:
            short.setdefault(t, []).append(i)
    size = np.array([len(t) for _, t in rows], dtype=np.int64)
    edits = (size * rate).astype(np.int64)
    # the largest q with which the bound is still at least one
    q = np.minimum(Q, np.maximum(size // (edits + 1), 1))
    grams = [gram_codes(np.frombuffer(t, dtype=np.uint8), n) for (_, t), n in zip(rows, q.tolist(), strict=True)]
    codes = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
    item = np.repeat(np.arange(len(rows), dtype=np.int32), [len(g) for g in grams])
    offset = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, dtype=np.int32)
    order = np.argsort(codes, kind="stable")
    known = np.zeros(1 << _BITS, dtype=bool)
    known[(codes >> _U(64 - _BITS)).astype(np.int64)] = True
    return Items([i for i, _ in rows], [t for _, t in rows], edits, q, size + 1 - q * (edits + 1), codes[order], item[order], offset[order], known, short)


def align(item: bytes, text: bytes, k: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best occurrence of an item in a text whose start lies on one of the
    diagonals 0 .. len(text) - len(item); None if it takes more than k edits."""
    m, width = len(item), len(text) - len(item) + 1
    if (at := text.find(item)) >= 0:
        return 0, at, at + m
    one = 1 << 24  # an edit; the low bits carry the start
    t = np.frombuffer(text, dtype=np.uint8)
    row = np.arange(width, dtype=np.int64)
    step = row * one
    for i, c in enumerate(item):
        cur = row + (t[i : i + width] != c) * one
        cur[:-1] = np.minimum(cur[:-1], row[1:] + one)
        row = np.minimum.accumulate(cur - step) + step
        if i % 32 == 31 and int(row.min()) >> 24 > k:
            return None
    at = int(row.argmin())
    edits, start = int(row[at]) >> 24, int(row[at]) & (one - 1)
    return (edits, start, m + at) if edits <= k else None


def _hits(data: np.ndarray, items: Items, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, first entry in the index and number of entries, for the text's grams of q bytes that items have; in
    the order of places, in batches of some HITS entries."""
    for at in range(0, len(data) - q + 1, CHUNK):
        codes = gram_codes(data[at : at + CHUNK + q - 1], q)
        place = np.flatnonzero(items.known[(codes >> _U(64 - _BITS)).astype(np.int64)])
        found = codes[place]
        left, right = np.searchsorted(items.codes, found, "left"), np.searchsorted(items.codes, found, "right")
        some = right > left
        place, left, count = place[some] + at, left[some], (right - left)[some]
        batch = np.cumsum(count) // HITS
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(place)] if len(place) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield place[a:b], left[a:b], count[a:b]


def _distinct(key: np.ndarray, offset: np.ndarray, n_keys: int, n_offsets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted: a q-gram of an item counts once for a band, however often a run in the text
    repeats it."""
    if n_keys * n_offsets < 2**62:
        both = np.unique(key * n_offsets + offset)
        return both // n_offsets, both % n_offsets
    order = np.lexsort((offset, key))
    key, offset = key[order], offset[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])))
    return key[new], offset[new]


def _bands(data: np.ndarray, items: Items) -> list[tuple[int, int]]:
    """Item and band, for the bands in which as many of the item's q-grams have a hit as its bound asks for. Band b
    of an item holds the diagonals of steps b and b + 1, a step being as wide as the edits allow, and one."""
    if not len(items.texts):
        return []
    longest, out = max(map(len, items.texts)), []
    # diagonals of a text of n bytes lie between -longest and n
    low = -longest - 2
    span = len(data) - low + 2

    def settle(key: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
        band, n = key[first], np.diff(np.append(first, len(key)))
        band = band[n >= items.least[band // span]]
        out.extend(zip((band // span).tolist(), (band % span + low).tolist(), strict=True))

    for q in np.unique(items.q).tolist():
        key, offset = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for place, left, count in _hits(data, items, q):
            # nothing more comes to the bands that end before this batch's first place
            over = (key % span + low + 2) * (items.edits[key // span] + 1) + longest < int(place[0])
            settle(key[over])
            entry = np.repeat(left - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            item, at = items.item[entry].astype(np.int64), items.offset[entry].astype(np.int64)
            new = item * span + (np.repeat(place, count) - at) // (items.edits[item] + 1) - low
            key, offset = _distinct(np.concatenate((key[~over], new, new - 1)), np.concatenate((offset[~over], at, at)), len(items.texts) * span, longest)
        settle(key)
    return out


def shared_grams(item: bytes, text: bytes, start: int, k: int, q: int = Q) -> int:
    """How many of the item's q-grams the text has on a diagonal within k of ``start``."""
    own = gram_codes(np.frombuffer(item, dtype=np.uint8), q)
    window = b"\xff" * max(0, k - start) + text[max(0, start - k) : start + k + len(item)]
    codes = gram_codes(np.frombuffer(window + b"\xff" * (2 * k + len(item) - len(window)), dtype=np.uint8), q)
    hit = np.zeros(len(own), dtype=bool)
    for d in range(2 * k + 1):
        hit |= codes[d : d + len(own)] == own
    return int(hit.sum())


def _short(text: bytes, items: Items) -> list[tuple[int, int, int, int, int]]:
    """The first place of each short item that stands in the text as a whole word (between bytes that are neither
    letters, digits nor beyond ASCII)."""
    def goes_on(at: int, end: int) -> bool:
        return (at > 0 and _WORD[text[at - 1]] and _WORD[text[at]]) or (end < len(text) and _WORD[text[end - 1]] and _WORD[text[end]])

    out = []
    for t, ids in sorted(items.short.items()):
        at = text.find(t)
        while at >= 0 and goes_on(at, at + len(t)):
            at = text.find(t, at + 1)
        if at >= 0:
            out += [(i, at, at + len(t), 0, 0) for i in ids]
    return out


_WORD = [bytes([c]).isalnum() or c >= 128 for c in range(256)]


def leaks(texts: list[bytes], items: Items) -> list[list[tuple[int, int, int, int, int]]]:
    """For each folded text the leaks: item id, start, end (bytes), edits, shared q-grams."""
    out: list[list] = [_short(t, items) if items.short else [] for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    joined = b"\xff".join(texts) + b"\xff"
    best: dict[tuple[int, int], list] = {}
    for i, b in _bands(np.frombuffer(joined, dtype=np.uint8), items):
        m, k = len(items.texts[i]), int(items.edits[i])
        first = b * (k + 1) - k  # the first diagonal that the alignment may start on
        last = (b + 2) * (k + 1) - 1 + k
        for d in {min(max(int(np.searchsorted(starts, min(max(x, 0), len(joined) - 1), "right")) - 1, 0), len(texts) - 1) for x in (first, (first + last) // 2, last)}:
            a, e = int(starts[d]), int(starts[d]) + len(texts[d])
            lo, hi = first, last + m
            window = b"\xff" * max(0, a - lo) + joined[max(lo, a) : max(max(lo, a), min(hi, e))]
            window += b"\xff" * (hi - lo - len(window))
            if got := align(items.texts[i], window, k):
                edits, s, t = got
                s, t = max(lo + s, a) - a, min(lo + t, e) - a
                if s < t:
                    best.setdefault((d, i), []).append((edits, s, t))
    for (d, i), got in sorted(best.items()):
        taken: list[int] = []  # ends and starts of the leaks so far, which are disjoint
        for edits, s, t in sorted(got):
            p = bisect(taken, s)
            if p % 2 == 0 and (p == len(taken) or t <= taken[p]):
                taken[p:p] = [s, t]
                out[d].append((items.ids[i], s, t, edits, shared_grams(items.texts[i], texts[d], s, int(items.edits[i]), int(items.q[i]))))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if r.t is None:
            continue
        block.append((r.i, r.t))
        size += 4 * len(r.t)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The rows with ``leaks``: an array of ``item_id``, ``start`` and ``end`` (byte offsets in the
    UTF-8 text, end exclusive), ``edits`` and ``shared``. Empty where there are none.

    Null and empty texts hold no leaks; texts are searched whole; null and blank items are not looked for.
    Items of fewer than Q bytes are found exactly, where they first stand as a whole word, with 0 shared
    q-grams; ``shared`` counts grams of the item's own q. Repeated items are found each for itself, repeated rows alike. The leaks of one item in a text don't
    overlap: where a periodic text holds it in overlapping places, some of these are given.
    A column of the input named ``leaks`` is replaced.
    """
    docs = docs.drop("leaks")
    blocks = _blocks(benchmark, item_id, item_text)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return _search(docs, text, index_items(block, rate))[0]
    each = docs.select(F.col(text).alias("t")).filter("t IS NOT NULL")
    parts: list[DataFrame] = []
    while block is not None:
        marked, shared = _search(each, "t", index_items(block, rate))
        parts.append(written(marked.filter(F.size("leaks") > 0).select(F.sha2("t", 256).alias("_d"), "leaks").dropDuplicates(["_d"]), "leaks"))
        shared.unpersist()
        block, after = after, next(blocks, None) if after is not None else None
    found = reduce(DataFrame.unionByName, parts).groupBy("_d").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.sha2(docs[text], 256).alias("_of"))
    out = rows.join(found, rows["_of"] == found["_d"], "left")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.coalesce("leaks", F.array().cast(LEAK)).alias("leaks"))


def _search(docs: DataFrame, text: str, items: Items) -> tuple[DataFrame, Broadcast]:
    """The rows with their leaks of one block, and the broadcast of its index."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_BYTES bounds it
    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("leaks", LEAK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for whole in batches:
            sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in whole.column(text).cast(pa.large_binary() if pa.types.is_large_string(whole.column(text).type) else pa.binary())])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // CHUNK)) + 1).tolist(), whole.num_rows] if whole.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(a, b - a)
                found = leaks([fold(t or "") for t in batch.column(text).to_pylist()], shared.value)
                rows = [[dict(zip(("item_id", "start", "end", "edits", "shared"), x, strict=True)) for x in xs] for xs in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in names), pa.array(rows, arrow.field("leaks").type)], schema=arrow)

    return docs.mapInArrow(run, schema), shared


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each leak: ``doc_id``, ``item_id``, ``start``, ``end``, ``edits``, ``shared``."""
    return mark_leaks(docs.select(doc_id, text), benchmark, text).select(doc_id, F.explode("leaks").alias("l")).select(doc_id, "l.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in a document, within the edit budget."""
    return find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
