"""Byte-level BPE by tree reduction.

A text is cut by the vocabulary's pattern, and every match is encoded by itself. Encoding a match is
a reduction over a tree: halves are encoded recursively and neighbours are joined. A join re-encodes
a window around the seam and widens it until the tokens outside provably stay: a sequence of tokens is
the encoding of its bytes exactly if every two neighbours are the encoding of theirs, so it is enough
that the pairs at the window's two edges hold. Decoding concatenates up the same tree.

Every document is encoded by itself, so the job is one pass without a shuffle; a task holds one
Arrow batch of texts and a bounded cache of encoded matches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from noteweave.llm.common import read

#: Matches up to this many bytes are leaves of the tree.
LEAF = 24
#: Tokens up to this many are a leaf when decoding.
DECODE_LEAF = 512
#: Entries of a worker's cache of encoded matches; beyond it the cache starts anew.
CACHE = 300_000


class Codec:
    """Encoder and decoder for ranks in the tiktoken format (base64 token, space, rank by line)."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.decimal = {i: str(i) for i in self.tokens}
        self.matches = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, b: bytes) -> list[int]:
        """The plain rule: merge the neighbours of least rank, the leftmost first, as long as any merge."""
        ranks, parts = self.ranks, [b[i : i + 1] for i in range(len(b))]
        pairs = [ranks.get(b[i : i + 2]) for i in range(len(b) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def fit(self, left: int, right: int) -> bool:
        """Whether these two tokens are the encoding of their bytes."""
        key = left, right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            known = self.fits[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            seam = self.merge(b"".join(self.tokens[t] for t in left[len(left) - a :] + right[:b]))
            good_left = a == len(left) or self.fit(left[-a - 1], seam[0])
            good_right = b == len(right) or self.fit(seam[-1], right[b])
            if good_left and good_right:
                return left[: len(left) - a] + seam + right[b:]
            a, b = a if good_left else 2 * a, b if good_right else 2 * b

    def reduce(self, b: bytes) -> list[int]:
        if len(b) <= LEAF:
            return self.merge(b)
        half = len(b) // 2
        return self.join(self.reduce(b[:half]), self.reduce(b[half:]))

    def piece(self, match: str) -> tuple[int, ...]:
        b = match.encode()
        whole = self.ranks.get(b)
        return (whole,) if whole is not None else tuple(self.reduce(b))

    def encode(self, text: str | None) -> list[int]:
        cache, out = self.cache, []
        for m in self.matches(text or ""):
            ids = cache.get(m)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = self.piece(m)
                if len(m) < 64:
                    cache[m] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[str, Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """The worker's codec for a vocabulary, built once."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


KINDS = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """The rows with the outputs asked for: ``ids``, ``decoded`` (the ids' bytes), ``n_tokens``, and the
    hex digests ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256``.

    A null text is empty and has no tokens. Texts of any length are encoded whole. Rows keep their
    other columns; a column with an output's name is replaced. The text must be valid Unicode.
    """
    spark = docs.sparkSession
    with open(vocab_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # the vocabulary: its size doesn't grow with the data
    keep = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(o, KINDS[o]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own, arrow = codec(ranks.value, pattern), to_arrow_schema(schema)
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for t in batch.column(text):
                ids = own.encode(t.as_py())
                if "n_tokens" in made:
                    made["n_tokens"].append(len(ids))
                if "ids" in made:
                    made["ids"].append(ids)
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    back = own.decode(ids)
                    if "decoded" in made:
                        made["decoded"].append(back)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), *(pa.array(made[o], arrow.field(o).type) for o in outputs)], schema=arrow)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of what they decode to."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
