"""Packed exchange of hashes between chunks of documents and buckets of the hash space.

Two operators ask, for very many strings, which of them occur elsewhere too. A row for each string
would shuffle several times the input. Here documents are dealt to chunks by a hash of their id; a
chunk sends each bucket one row with its distinct hashes, sorted and as differences; the bucket answers
with one bit for each hash, in the same order. A chunk computes the same distinct hashes again when it
reads the answer, so no document ids go along. What a bucket receives is bounded by the number of
chunks, not of documents, for each string: copies and hot strings fold inside the chunk.

Chunks are dealt by the bytes of the texts, not by partitions: up to CHUNK_BYTES each (but for a longer text),
and there is a bucket for two to four chunks. So what a worker holds doesn't grow with the input: at 16 MB some
0.7 GB. The messages are chunks times buckets, 16 KB each at 30 GB of text; beyond some TB larger chunks on larger
workers keep them from getting small (each fourfold chunk makes them a sixteenth).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.llm.common import n_parts

_U = np.uint64


#: Bytes of text in a chunk: at most, on average, and at least where partitions ask for smaller ones.
CHUNK_BYTES = 16 << 20
LEAST_BYTES = 1 << 20


def n_chunks(docs: DataFrame, text: str, most: int = CHUNK_BYTES) -> int:
    """Two chunks for each shuffle partition, within the bounds of their size."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).collect()[0]["n"] or 0
    return max(1, math.ceil(total / min(most, max(LEAST_BYTES, total / (2 * n_parts(docs.sparkSession))))) if total else 1)


def bits(chunks: int) -> int:
    """Buckets as a power of two."""
    return max(1, math.floor(math.log2(chunks)) - 1) if chunks > 1 else 1


def chunked(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """``chunk``, ``doc_id``, ``text`` of the documents with an id; its shuffle is used by every round."""
    key = F.col(doc_id).cast("bigint")
    return docs.filter(F.col(doc_id).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("chunk"), key.alias("doc_id"), F.col(text).alias("text"))


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, all their low bytes first: high bytes are mostly zero
    then, which the shuffle's compression takes away."""
    d = np.diff(values.astype(np.uint64), prepend=_U(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(body: bytes) -> np.ndarray:
    d = np.frombuffer(body, dtype=np.uint8).reshape(8, -1).T.copy().view(np.uint64)[:, 0] if body else np.zeros(0, dtype=np.uint64)
    return np.cumsum(d, dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Any integers, by bytes of like weight."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(len(v), -1).T.tobytes() if len(v) else b""


def unplanes(body: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.frombuffer(body, dtype=np.uint8).reshape(k, -1).T.copy().view(dtype)[:, 0] if body else np.zeros(0, dtype=dtype)


def slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Bucket, start and end of the runs of a sorted array of bucket numbers."""
    if not len(bucket):
        return []
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    at = [0, *cut.tolist(), len(bucket)]
    return [(int(bucket[a]), a, b) for a, b in zip(at, at[1:], strict=False)]


def groups(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))


def spread(per_group: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value for each group as one for each element."""
    return np.repeat(per_group, np.diff(np.append(starts, n)))
