"""What several operators of this subpackage share: reading, scratch tables, words and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes between words: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression class, for Java and RE2.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it. Where that is unset, a local temporary folder serves a
    local master, as in tests (and is then set); on a cluster that is an error, for executors don't share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/noteweave-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what follows neither recomputes them nor
    depends on an executor that may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- numpy on bytes


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds), in place on a uint64 array."""
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


_BYTE = _table(11)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def join_texts(texts, sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by ``sep``; offsets of their starts, and the end."""
    raw = [(t if isinstance(t, bytes) else t.encode()) if t is not None else b"" for t in texts]
    ends = np.cumsum([0, *(len(r) + len(sep) for r in raw)])
    return np.frombuffer(sep.join(raw) + sep if raw else b"", dtype=np.uint8), ends


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a byte array that ends with white space."""
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


_TABLES: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (or other span, in order of start): a polynomial with a
    random coefficient for each byte value, from prefix sums over blocks of words. Spans of any length
    count whole."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + _BLOCK)))
        end = int(ends[at:to].max())
        if not _TABLES or len(_TABLES[0]) < end - base + 1:
            _TABLES[:] = [_powers(_R, end - base + _BLOCK), _powers(_RINV, end - base + _BLOCK)]
        total = np.zeros(end - base + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base:end]] * _TABLES[0][: end - base], out=total[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[b] - total[a]) * _TABLES[1][a]
        at = to
    out ^= (ends - starts).astype(np.uint64) << _U(40)
    return mix(out)


def gram_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes, by its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    p = np.random.default_rng(1000 + seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
    out = h[:m] * p[0]
    for k in range(1, n):
        out += h[k : k + m] * p[k]
    return mix(out)
