"""Substring dedup by fixed-block anchors.

The index is the non-overlapping blocks of seven words of every document. A window of thirteen words
always holds a whole block, wherever it lies. So every rolling window of seven words is probed against
the blocks: those that hit another document's block are anchors. Hits are extended to the windows of
thirteen words that hold an anchor, and for each such word sequence the smallest document is found;
runs of windows that a smaller document has are the maximal exact repeats, and are removed.

Three rounds over the chunks (see ``exchange``), all on one shuffle of the texts: probe, extend, remove.
Anchors are compared by 32 bits and the bucket (a false anchor only costs work), windows by 96 bits.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import exchange as X
from noteweave.llm.common import gram_hashes, join_texts, mix, read, word_hashes, word_spans

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
_U = np.uint64


class _Words:
    """The words of a chunk's documents, flat, in an order that its rows alone determine."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_numpy()
        self.texts = [(t.encode() if t else b"") for t in table.column("text").to_pylist()]
        self.ids = ids
        data, ends = join_texts(self.texts)
        starts, stops = word_spans(data)
        self.hash = word_hashes(data, starts, stops)
        self.row = np.searchsorted(ends, starts, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(ids)) if len(starts) else np.zeros(len(ids), dtype=np.int64)
        self.first = np.cumsum([0, *self.count])[:-1]

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are of one document."""
        m = max(0, len(self.row) - n + 1)
        return self.row[:m] == self.row[n - 1 : n - 1 + m]


class _Anchors:
    """A chunk's distinct rolling windows of seven words: value (bucket and 32 bits), whether one starts
    a block, whether two documents have it."""

    def __init__(self, w: _Words, bits: int):
        at = np.flatnonzero(w.whole(BLOCK))
        value = gram_hashes(w.hash, BLOCK)[at] >> _U(32 - bits)
        self.order = np.argsort(value, kind="stable")
        self.at = at
        value = value[self.order]
        self.starts = X.groups(value)
        row = w.row[at][self.order]
        block = ((at - w.first[w.row[at]]) % BLOCK == 0)[self.order]
        ids = w.ids[row]
        self.value = value[self.starts]
        self.block = np.logical_or.reduceat(block, self.starts) if len(value) else block
        self.many = np.minimum.reduceat(ids, self.starts) != np.maximum.reduceat(ids, self.starts) if len(value) else block
        self.bucket = (self.value >> _U(32)).astype(np.int64)

    def hits(self, answers: dict[int, bytes], n: int) -> np.ndarray:
        """Whether each of the chunk's n words starts an anchor."""
        good = np.zeros(len(self.value), dtype=bool)
        for b, a, e in X.slices(self.bucket):
            if b in answers:
                good[a:e] = np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8), count=e - a).astype(bool)
        out = np.zeros(n, dtype=bool)
        out[self.at[self.order]] = X.spread(good, self.starts, len(self.order))
        return out


class _Windows:
    """A chunk's windows of thirteen words that hold an anchor, distinct, with the smallest document."""

    def __init__(self, w: _Words, hits: np.ndarray):
        whole = w.whole(WINDOW)
        seen = np.concatenate(([0], np.cumsum(hits)))
        near = seen[np.arange(len(whole)) + WINDOW - BLOCK + 1] > seen[: len(whole)]
        at = np.flatnonzero(whole & near)
        one, two = _hash_at(w.hash, at, 2), _hash_at(w.hash, at, 3) >> _U(32)
        order = np.lexsort((two, one))
        self.at, one, two = at[order], one[order], two[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.starts = np.flatnonzero(new)
        self.one, self.two = one[self.starts], two[self.starts].astype(np.uint32)
        self.ids = w.ids[w.row[self.at]]
        self.least = np.minimum.reduceat(self.ids, self.starts) if len(at) else self.ids


def _hash_at(h: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    p = np.random.default_rng(1000 + seed).integers(1, 2**63, WINDOW, dtype=np.uint64) * _U(2) + _U(1)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(WINDOW):
        out += h[at + k] * p[k]
    return mix(out)


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: body for b, k, body in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True) if k == kind}


_SENT = "bucket int, chunk int, body binary, more binary, ids binary"
_ANSWER = "chunk int, bucket int, kind int, body binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary()), ("more", pa.binary()), ("ids", pa.binary())])
_ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of the documents: ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (runs of
    removed words, as struct<start, end> of word numbers) and ``kept_text``, the kept words joined by one
    space; with ``digest``, ``kept_sha256`` instead of the last two.

    A word goes if it is covered by a window of thirteen words whose sequence also starts in a document of
    a smaller id; windows are judged on the input. Null texts have no words. A row without an id is neither
    searched nor indexed, and keeps all its words. Rows of the same id don't count against each other.
    """
    n_chunks = X.n_chunks(docs, text)
    bits = X.bits(n_chunks)
    chunks = X.chunked(docs, doc_id, text, n_chunks)
    out_schema = "doc_id bigint, n_words bigint, n_removed bigint, " + ("kept_sha256 string" if digest else "removed array<struct<start:int,end:int>>, kept_text string")

    def probe(table: pa.Table) -> pa.Table:
        a = _Anchors(_Words(table), bits)
        flags = a.block.astype(np.uint8) | a.many.astype(np.uint8) << 1
        chunk = table.column("chunk")[0].as_py()
        return _table([(b, chunk, X.pack(a.value[s:e] & _U(0xFFFFFFFF)), flags[s:e].tobytes(), None) for b, s, e in X.slices(a.bucket)], _SENT_ARROW)

    def anchors(table: pa.Table) -> pa.Table:
        values = [X.unpack(x) for x in table.column("body").to_pylist()]
        flags = np.frombuffer(b"".join(table.column("more").to_pylist()), dtype=np.uint8)
        value = np.concatenate(values)
        order = np.argsort(value, kind="stable")
        starts = X.groups(value[order])
        n = np.diff(np.append(starts, len(value)))
        any_flag = np.bitwise_or.reduceat(flags[order], starts)
        good = np.empty(len(value), dtype=bool)
        good[order] = np.repeat((any_flag & 1 > 0) & ((n > 1) | (any_flag & 2 > 0)), n)
        return _answer(table, values, good, 1)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _SENT_ARROW)
        w = _Words(table)
        v = _Windows(w, _Anchors(w, bits).hits(_answers(answers, 1), len(w.hash)))
        chunk = table.column("chunk")[0].as_py()
        return _table([(b, chunk, X.pack(v.one[s:e]), X.planes(v.two[s:e]), X.planes(v.least[s:e])) for b, s, e in X.slices((v.one >> _U(64 - bits)).astype(np.int64))], _SENT_ARROW)

    def smallest(table: pa.Table) -> pa.Table:
        values = [X.unpack(x) for x in table.column("body").to_pylist()]
        one = np.concatenate(values)
        two = np.concatenate([X.unplanes(x, np.uint32) for x in table.column("more").to_pylist()])
        least = np.concatenate([X.unplanes(x, np.int64) for x in table.column("ids").to_pylist()])
        order = np.lexsort((two, one))
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        starts = np.flatnonzero(new)
        good = np.empty(len(one), dtype=bool)
        good[order] = X.spread(np.minimum.reduceat(least[order], starts), starts, len(one)) < least[order]
        return _answer(table, values, good, 2)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Words(table)
        v = _Windows(w, _Anchors(w, bits).hits(_answers(answers, 1), len(w.hash)))
        said, all_gone = _answers(answers, 2), np.zeros(len(v.one), dtype=bool)
        for b, s, e in X.slices((v.one >> _U(64 - bits)).astype(np.int64)):
            if b in said:
                all_gone[s:e] = np.unpackbits(np.frombuffer(said[b], dtype=np.uint8), count=e - s).astype(bool)
        n = len(v.at)
        gone = v.at[X.spread(all_gone, v.starts, n) | (v.ids > X.spread(v.least, v.starts, n))] if n else v.at
        step = np.zeros(len(w.hash) + 1, dtype=np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + WINDOW, -1)
        return _kept(w, np.cumsum(step)[:-1] > 0)

    def _kept(w: _Words, covered: np.ndarray) -> pa.Table:
        rows = []
        for i, raw in enumerate(w.texts):
            own = covered[w.first[i] : w.first[i] + w.count[i]]
            n = int(own.sum())
            kept = b" ".join(compress(raw.split(), ~own) if n else raw.split())
            if digest:
                rows.append((int(w.ids[i]), len(own), n, hashlib.sha256(kept).hexdigest()))
            else:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                rows.append((int(w.ids[i]), len(own), n, [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)], kept.decode()))
        last = [("kept_sha256", pa.string())] if digest else [("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())]
        return _table(rows, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), *last]))

    def plain(batches):
        for b in batches:
            w = _Words(pa.table({"doc_id": pa.array(np.zeros(b.num_rows, dtype=np.int64)), "text": b.column("text")}))
            t = _kept(w, np.zeros(len(w.hash), dtype=bool))
            t = t.set_column(0, "doc_id", pa.nulls(t.num_rows, pa.int64()))
            yield from t.to_batches()

    by_chunk = chunks.groupBy("chunk")
    first = by_chunk.applyInArrow(probe, _SENT).groupBy("bucket").applyInArrow(anchors, _ANSWER)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(extend, _SENT).groupBy("bucket").applyInArrow(smallest, _ANSWER)
    done = by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(remove, out_schema)
    return done.unionByName(docs.filter(F.col(doc_id).isNull()).select(F.col(text).alias("text")).mapInArrow(plain, out_schema))


def _answer(table: pa.Table, values: list[np.ndarray], good: np.ndarray, kind: int) -> pa.Table:
    """One row of bits for each row that a bucket received."""
    at = np.cumsum([0, *(len(v) for v in values)])
    return _table([(c, b, kind, np.packbits(good[at[i] : at[i + 1]]).tobytes()) for i, (c, b) in enumerate(zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), strict=True))], _ANSWER_ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, removed words and the digest of what is kept."""
    return remove_repeats(read(spark, sf_dir, "documents"), digest=True)


def oracle() -> str:
    return rf"""
    WITH w AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
    win AS (SELECT rid, doc_id, i, sha256(array_to_string(ws[i:i+{WINDOW - 1}], ' ')) AS g
            FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WINDOW - 2})) AS i)),
    gone AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
    cov AS (SELECT DISTINCT rid, i + o AS i FROM gone, range({WINDOW}) AS t(o)),
    word AS (SELECT rid, i, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
    kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN cov USING (rid, i) GROUP BY rid),
    lost AS (SELECT rid, count(*) AS n FROM cov GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)"""
