"""MinHash near-dedup by chosen paths: a set similarity join that recursively branches documents.

A document's set is its distinct shingles of five words. In each of several independent trees a document
goes to the children of its node that its selected tokens name: those whose hash, seeded by the path so
far, is under 1 / (BRANCH * set size), so 1 / BRANCH of them on average. Two similar sets select the same
tokens and stay together in some branch; unlike ones part. Small nodes are compared exhaustively; the
documents of larger nodes are compared with the node's leaders, and if that doesn't make the node one
component, all documents of such nodes are joined exactly, by a prefix filter. Every link is confirmed on
the full sets.

A pair at the threshold shares a node at depth three of one tree with a probability of 0.42 at least
(0.5 where the sets are as large), so TREES = 20 miss it with one of 2e-5 at most, however large its nodes.

The exact join orders a set's elements by the number of components that hold them, rarest first. Two similar
sets share one of their first n - ceil(0.75 n) + 1, and what is left behind their first shared one suffices
for a link. It runs twice: with one document for each element and component, so that most components grow
together, and then with all pairs of documents whose components still differ.

At scale: documents with equal sets are one class from the start, so copies neither branch nor pair. A class
is known by its set's 128 bits, never by a document's id, and has a number of its own. Nodes are counted before
anything is gathered, and only small ones are gathered. Sets are built again only for classes that have
candidates, and meet by joins whose hot partitions Spark splits. Components come from label propagation with
pointer jumping on tables in the shared folder; links that come later only join the labels there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.llm.common import _LOWER, gram_hashes, join_texts, mix, read, word_hashes, word_spans, written

SHINGLE = 5
#: Similarity of a link: 100 * intersection >= 75 * union.
SIMILAR = 75
TREES = 20
BRANCH = 0.7
DEPTH = 3
#: Nodes of up to so many classes are compared exhaustively.
SMALL = 32
#: Classes of a large node that all its members are compared with: by an order of all classes, and by an
#: order of the node's own.
LEADERS = 2
_U = np.uint64
_CHUNK = 1_000_000


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set as sorted distinct hashes. Words are runs without white space, with A-Z in lower
    case; a text of fewer words than a shingle has one element, and one without words none."""
    data, ends = join_texts(texts)
    data = _LOWER[data]
    starts, stops = word_spans(data)
    h = word_hashes(data, starts, stops)
    grams = gram_hashes(h, SHINGLE)
    bounds = np.searchsorted(starts, ends)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], b - a, seed=10 + b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed integers."""
    one, two = mix(s * _U(0x9E3779B97F4A7C15) + _U(1)).sum(dtype=np.uint64), mix(s * _U(0xC2B2AE3D27D4EB4F) + _U(7)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


_SEEDS = np.random.default_rng(77).integers(1, 2**63, TREES, dtype=np.uint64)


def branch(s: np.ndarray, paths: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The distinct paths that lead from the given ones to nodes ``depth`` levels down."""
    x = (s ^ (s >> _U(32))).astype(np.uint32)
    least = np.uint32(min(2**32 - 1, int(2**32 / (BRANCH * len(s)))))
    block = max(1, 2_000_000 // len(s))
    for _ in range(depth):
        made = []
        for i in range(0, len(paths), block):
            p = paths[i : i + block]
            v = x[None, :] ^ (p & _U(0xFFFFFFFF)).astype(np.uint32)[:, None]
            v *= np.uint32(0x85EBCA6B)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0xC2B2AE35)
            v ^= v >> np.uint32(16)
            r, c = np.nonzero(v <= least)
            made.append(mix(p[r] * _U(0x9E3779B97F4A7C15) + s[c]))
        paths = np.unique(np.concatenate(made)) if made else paths
    return paths


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([len(t.as_py() or "") for t in batch.column(text)]) if batch.num_rows else np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(sizes // _CHUNK)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``n``, ``s1``, ``s2`` and, once for each set of a piece, its paths."""
    for whole in batches:
        for batch in _pieces(whole, "text"):
            seen: set[tuple[int, int]] = set()
            n, ones, twos, paths = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                who = identity(s)
                n.append(len(s))
                ones.append(who[0])
                twos.append(who[1])
                paths.append(branch(s, _SEEDS).view(np.int64) if len(s) and who not in seen else None)
                seen.add(who)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "paths"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``z1``, ``z2`` (the set's identity) and ``body``, its elements."""
    for whole in batches:
        for batch in _pieces(whole, "text"):
            made = shingle_sets(batch.column("text").to_pylist())
            who = [identity(s) for s in made]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in who], pa.int64()), pa.array([x for _, x in who], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["doc_id", "z1", "z2", "body"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column("body")]
            rep, lab = (np.repeat(part.column(c).to_numpy(), [len(s) for s in sets]) for c in ("rep", "lab"))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(lab), pa.array(np.concatenate(sets))], names=["rep", "lab", "e"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = np.concatenate((s, t))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= SIMILAR * (len(s) + len(t) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs (a < b) of classes in small nodes whose sizes allow a link and whose components (``lab``) differ."""
    node = members.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "lab"))).alias("m"))
    after = lambda x, i: F.transform(F.filter(F.slice("m", i + 2, F.size("m")), lambda y: _sizes_fit(x["n"], y["n"]) & (x["lab"] != y["lab"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))
    return node.select(F.explode(F.flatten(F.transform("m", after))).alias("p")).select("p.*")


def _sizes_fit(n, m):
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR


def _nodes(placed: DataFrame) -> DataFrame:
    """``path, rep, n`` of the nodes of two classes or more, with the node's ``size`` and ``leaders``."""
    order = (F.xxhash64("rep"), F.xxhash64("rep", "path"))
    leader = [F.min(F.struct(h.alias("h"), F.col("rep"), F.col("n"))).alias(f"l{i}") for i, h in enumerate(order)]
    size = placed.groupBy("path").agg(F.count("*").alias("size"), *leader).filter(F.col("size") > 1)
    size = size.select("path", "size", F.when(F.col("size") > SMALL, F.array_distinct(F.array(*[F.struct(F.col(f"l{i}.rep").alias("rep"), F.col(f"l{i}.n").alias("n")) for i in range(LEADERS)]))).alias("leaders"))
    return placed.join(size, "path")


def _stars(nodes: DataFrame) -> DataFrame:
    """``a, b``: members of large nodes with their first leader."""
    star = nodes.filter(F.col("size") > SMALL).select("rep", "n", F.get("leaders", F.lit(0)).alias("l"))
    star = star.filter((F.col("rep") != F.col("l.rep")) & _sizes_fit(F.col("n"), F.col("l.n")))
    return star.select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    with_a = pairs.join(sets.withColumnsRenamed({"rep": "a", "body": "body_a"}), "a")
    with_b = with_a.join(sets.withColumnsRenamed({"rep": "b", "body": "body_b"}), "b")
    return with_b.select("a", "b", "body_a", "body_b").mapInArrow(_confirm, "a bigint, b bigint").distinct()


def _mixed(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """``rep, n, lab`` of the classes in large nodes that are not one component."""
    own = nodes.filter(F.col("size") > SMALL).join(label, nodes["rep"] == label["v"], "left").select("path", "rep", "n", F.coalesce("label", "rep").alias("lab"))
    mixed = own.groupBy("path").agg(F.min("lab").alias("low"), F.max("lab").alias("high")).filter("low < high").select("path")
    return own.join(mixed, "path", "left_semi").select("rep", "n", "lab").distinct()


def _prefixes(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """``rep, n, lab, e, pos``: the first elements of each set that several components hold. Their places
    count from 1, rarest first; those that one component holds come before them."""
    each = written(classes.select("rep", "lab").join(sets, "rep").mapInArrow(_elements, "rep bigint, lab bigint, e bigint"), "elements")
    held = each.groupBy("e", "lab").agg(F.lit(1).alias("one")).groupBy("e").agg(F.count("*").alias("held")).filter("held > 1")
    own = Window.partitionBy("rep")
    shared = each.join(held, "e").join(classes.select("rep", "n"), "rep")
    placed = shared.withColumn("pos", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "e")))
    return placed.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1).select("rep", "n", "lab", "e", "pos")


def _meeting(prefixes: DataFrame) -> DataFrame:
    """Pairs (a < b) of different components that share an element and can be similar enough."""
    x, y = (prefixes.select("e", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "lab", "pos")]) for s in "ab")
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) + 1
    fits = _sizes_fit(F.col("n_a"), F.col("n_b")) & (rest * (100 + SIMILAR) >= (F.col("n_a") + F.col("n_b")) * SIMILAR)
    same = x.join(y, (x["e"] == y["e"]) & (F.col("rep_a") < F.col("rep_b")) & (F.col("lab_a") != F.col("lab_b")) & fits)
    return same.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _exactly(nodes: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """The labels with all links among the classes of large nodes."""
    classes = written(_mixed(nodes, label), "mixed")
    if classes.isEmpty():
        return label
    prefixes = written(_prefixes(classes, sets), "prefixes")
    first = prefixes.groupBy("e", "lab").agg(F.min(F.struct("pos", "rep", "n")).alias("m")).select("m.rep", "m.n", "lab", "e", "m.pos")
    label = joined(label, _linked(written(_meeting(first), "pairs"), sets))
    now = prefixes.drop("lab").join(label, prefixes["rep"] == label["v"], "left").select("rep", "n", F.coalesce("label", "rep").alias("lab"), "e", "pos")
    return joined(label, _linked(written(_meeting(now), "pairs"), sets))


def components(links: DataFrame) -> DataFrame:
    """``v`` and ``label``, the smallest node that it reaches, for the nodes of links (a, b)."""
    both = written(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), "links")
    label = written(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(label.withColumnsRenamed({"v": "u", "label": "lu"}), "u").groupBy("v").agg(F.min("lu").alias("m"))
        low = label.join(near, "v").select("v", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        jump = low.join(label.select(F.col("v").alias("w"), F.col("label").alias("lw")), F.col("new") == F.col("w"), "left")
        nxt = written(jump.select("v", F.least("new", F.coalesce("lw", "new")).alias("label"), "old"), "labels")
        if nxt.filter("label <> old").isEmpty():
            return nxt.select("v", "label")
        label = nxt.select("v", "label")


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only links between different labels count, and they join whole
    components, so what is known is not worked out again."""
    of = lambda c: label.select(F.col("v").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    between = written(between.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if between.isEmpty():
        return label
    now = components(between).select(F.col("v").alias("was"), F.col("label").alias("now"))
    moved = label.join(now, label["label"] == now["was"], "left").select("v", F.coalesce("now", "label").alias("label"))
    alone = now.join(label, now["was"] == label["v"], "left_anti").select(F.col("was").alias("v"), F.col("now").alias("label"))
    return written(moved.unionByName(alone), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of the documents: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    of its group of linked documents), ``kept`` (whether that is its own).

    Null texts and texts without words have empty sets and are linked with nothing, so they are kept. A row
    without an id is linked with nothing either; its component is null and it is kept. Rows of one id are
    each judged by their text: two texts of one id are linked only if they are similar. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketch = written(rows.mapInArrow(_sketch, "doc_id bigint, n bigint, s1 bigint, s2 bigint, paths array<bigint>"), "sketch")
    real = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.any_value("paths", F.lit(True)).alias("paths"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers that the table keeps
    nodes = written(_nodes(classes.select("rep", "n", F.explode("paths").alias("path"))), "nodes")
    wanted = classes.join(nodes.select("rep").distinct(), "rep", "left_semi").select("rep", "least", "s1", "s2")
    bodies = rows.join(wanted.select("least").distinct(), rows["doc_id"] == F.col("least"), "left_semi").mapInArrow(_sets, "doc_id bigint, z1 bigint, z2 bigint, body binary")
    bodies = wanted.join(bodies, (F.col("least") == F.col("doc_id")) & (F.col("s1") == F.col("z1")) & (F.col("s2") == F.col("z2")))
    sets = written(bodies.groupBy("rep").agg(F.any_value("body").alias("body")), "sets")
    label = components(_linked(_stars(nodes), sets))
    label = joined(label, _linked(written(_level(nodes, label), "pairs"), sets))
    label = _exactly(nodes, sets, label)
    known = classes.select("rep", "s1", "s2", "least").join(label, classes["rep"] == label["v"], "left").select("s1", "s2", "least", F.coalesce("label", "rep").alias("lab"))
    least = known.groupBy("lab").agg(F.min("least").alias("component"))
    known = known.join(least, "lab").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "component")
    out = sketch.select("doc_id", "n", "s1", "s2")
    out = out.join(known, (out["s1"] == known["c1"]) & (out["s2"] == known["c2"]) & out["doc_id"].isNotNull() & (out["n"] > 0), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _level(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs of classes to compare: all in small nodes, members and leaders in large ones; but for those
    whose components the links so far make one, for they can't change anything."""
    own = nodes.join(label, nodes["rep"] == label["v"], "left").withColumn("lab", F.coalesce("label", "rep")).drop("v", "label")
    own = written(own, "nodes")
    star = own.filter(F.col("size") > SMALL)
    sides = [star.select("rep", "n", "lab", F.get("leaders", F.lit(i)).alias("l")).filter((F.col("rep") != F.col("l.rep")) & _sizes_fit(F.col("n"), F.col("l.n"))) for i in range(LEADERS)]
    both = sides[0].unionByName(sides[1]).select("rep", "lab", F.col("l.rep").alias("other")).distinct()
    other = label.select(F.col("v").alias("other"), F.col("label").alias("lab2"))
    both = both.join(other, "other", "left").filter(F.col("lab") != F.coalesce("lab2", "other"))
    return _pairs(own.filter(F.col("size") <= SMALL)).unionByName(both.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component, and whether it is the one kept."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def oracle() -> str:
    return r"""
    WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s
           FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
    FROM w LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)"""
