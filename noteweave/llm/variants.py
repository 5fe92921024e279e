"""Spelling variants: words one edit apart, by merging the light subtrees of the vocabulary's trie.

The words stand in a trie. At every node the child that leads to most words is heavy, the others are light; a word
passes at most log2(words) light children. Two words that differ by one edit part at one node, and at most one of
them goes on by the heavy child there, so it is enough to merge light subtrees, small into large: at each light step a
word is entered again with the step's character

- replaced by the heavy one, which may end where a word of the heavy subtree ends;
- replaced by a wildcard, which may end where other light subtrees' words do;
- skipped, or with the heavy character put before it, which may end where any word below the node does.

Coinciding ends are the pairs, each found once: a step is skipped only if the next character is another one, so that
the words part at this very node.

Everything is a DataFrame step over the vocabulary, which is counted once by a partial aggregation. A node is known by a
64-bit hash of its path; a collision only lets two nodes share their heavy character and can't lose or add a pair,
for ends are compared as whole strings. Wildcard ends meet in groups no larger than the alphabet and give each
member the group's size and its best other word, so pairs are never multiplied out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.functions.text import scan
from noteweave.llm.common import read, written

RUN = r"[A-Za-z\u00C0-\u00FF]+"
#: Least length and count of a word of the vocabulary, and how much commoner its form must be.
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: One run in so many (by its hash with the document) loses a character.
ERRATA = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Not in any run.
_WILD = "*"


def runs(text: Column) -> Column:
    """The runs of letters of a text as an array, A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(RUN), F.lit(0))


def without_errata(each: DataFrame) -> DataFrame:
    """``word`` for each ``_id, _run``: the run, but for one in ``ERRATA`` that loses the character its hash points at."""
    hashed = each.withColumn("_h", F.crc32(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), "_run")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return hashed.select(F.when(F.col("_h") % ERRATA == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", errata: bool = True) -> DataFrame:
    """``word, n``: the words of ``MIN_LENGTH`` code points and more that occur ``MIN_COUNT`` times and more.

    A null text has no words; a null id counts as an empty one in the errata's hash. Repeated rows count each.
    """
    each = docs.select(F.col(doc_id).alias("_id"), F.explode(runs(F.col(text))).alias("_run")).filter(F.length("_run") >= MIN_LENGTH)
    found = without_errata(each) if errata else each.select(F.col("_run").alias("word"))
    return found.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def light_steps(words: DataFrame) -> DataFrame:
    """``id, at, heavy``: for each word (``id, word``) the places where it leaves its node by a light child or ends
    there, and the node's heavy character."""
    letters = F.concat(F.split("word", ""), F.array(F.lit("")))  # the end is a step too, never the heavy one
    nodes = scan(letters, F.xxhash64(F.lit("")), lambda h, c: F.xxhash64(h, c), lambda h, c: F.struct(h.alias("node"), c.alias("by")))[1]
    steps = written(words.select("id", F.posexplode(nodes).alias("at", "s")).select("id", "at", "s.node", "s.by"), "steps")
    children = steps.groupBy("node", "by").agg(F.count("*").alias("size"))
    heavy = children.groupBy("node").agg(F.max(F.when(F.col("by") != "", F.struct("size", "by")))["by"].alias("heavy"), F.count("*").alias("children")).filter("children > 1")
    return steps.join(heavy.select("node", "heavy"), "node").filter("by <> heavy").select("id", "at", "heavy")


def one_edit(words: DataFrame) -> DataFrame:
    """``word, n_near, n, form``: how many words of ``words`` (``word, n``; distinct) differ from each by one
    inserted, deleted or replaced code point, and the most frequent of them (ties: the first in code-point order)
    with its count. Words that have none are left out."""
    ids = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    light = light_steps(ids).join(ids, "id")
    to, by, rest = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 1, F.lit(1)), F.substring("word", F.col("at") + 2, F.length("word"))
    probes = F.array_compact(F.array(
        F.when(by != "", F.struct(F.concat("_to", "heavy", "_rest").alias("end"), F.lit(False).alias("wild"))),
        F.when(by != "", F.struct(F.concat("_to", F.lit(_WILD), "_rest").alias("end"), F.lit(True).alias("wild"))),
        F.when((by != "") & (F.substring("_rest", 1, 1) != by), F.struct(F.concat("_to", "_rest").alias("end"), F.lit(False).alias("wild"))),
        F.struct(F.concat("_to", "heavy", by, "_rest").alias("end"), F.lit(False).alias("wild"))))
    ends = written(light.withColumns({"_to": to, "_rest": rest}).select("word", "n", F.explode(probes).alias("p")).select("word", "n", "p.end", "p.wild"), "ends")

    met = ends.filter("NOT wild").join(ids.select(F.col("word").alias("end"), F.col("n").alias("end_n")), "end")
    pair = F.array(F.struct("word", F.col("end").alias("form"), F.col("end_n").alias("n")), F.struct(F.col("end").alias("word"), F.col("word").alias("form"), "n"))
    pairs = met.select(F.explode(pair).alias("p")).select("p.word", F.lit(1).cast("bigint").alias("near"), F.struct((-F.col("p.n")).alias("less"), F.col("p.form").alias("form")).alias("best"))

    same = Window.partitionBy("end")
    ranked = same.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))
    groups = ends.filter("wild").withColumns({"_size": F.count("*").over(same), "_1": F.first(best).over(ranked), "_2": F.nth_value(best, 2).over(ranked)}).filter("_size > 1")
    groups = groups.select("word", (F.col("_size") - 1).alias("near"), F.when(F.col("_1.form") == F.col("word"), F.col("_2")).otherwise(F.col("_1")).alias("best"))

    found = pairs.unionByName(groups).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("n"), F.col("best.form").alias("form"))


def follow(links: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: each word's last form. Every round doubles the way, and a form is
    ``RATIO`` times commoner than its word, so five rounds reach through 32 steps, more than any corpus has."""
    roots = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            return roots
        roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def group_variants(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for distinct ``word, n``: the near word of largest count is the form
    if its count is ``RATIO`` times the word's and more; the root is the end of the forms, the word itself without
    one. An empty table gives an empty result."""
    words = written(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    near = written(one_edit(words), "near").withColumnsRenamed({"n": "_n", "form": "_form"})
    own = words.join(near, "word", "left")
    is_form = F.col("_n") >= F.col("n") * RATIO
    own = written(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("_form")).alias("form"), F.when(is_form, F.col("_n")).alias("form_n")), "forms")
    return own.join(follow(own.filter("form IS NOT NULL")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words, form and root."""
    return group_variants(vocabulary(read(spark, sf_dir, "documents").select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")


def oracle() -> str:
    """The checksum is worked out byte by byte; pairs come from all ways to delete one character."""
    letter = r"[A-Za-z\x{00C0}-\x{00FF}]+"
    return rf"""
    WITH RECURSIVE tbl AS (SELECT [list_reduce([CAST(i AS UBIGINT)] || list_transform(range(8), lambda x: CAST(0 AS UBIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) FOR i IN range(256)] AS t),
    r AS (SELECT doc_id, translate(x, '{_UPPER}', '{_LOWER}') AS w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{letter}')) AS x FROM documents) WHERE length(x) >= {MIN_LENGTH} GROUP BY ALL),
    b AS (SELECT doc_id, w, k, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, '')]) AS bs FROM r),
    h AS (SELECT w, k, xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(bs, lambda x: CAST(x AS UBIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) AS h FROM b, tbl),
    e AS (SELECT CASE WHEN h % {ERRATA} = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, k FROM h),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM e WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
    d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
    p AS (SELECT a.word AS u, b.word AS w FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.x = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.x = v.word),
    m AS (SELECT u, count(*) AS n_near, min((-n, word)) AS best FROM p JOIN v ON p.w = v.word GROUP BY u),
    f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {RATIO} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {RATIO} * n THEN -best[1] END AS form_n FROM v LEFT JOIN m ON u = word),
    way AS (SELECT word, word AS top, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.top WHERE f.form IS NOT NULL)
    SELECT f.word, form, (SELECT arg_max(top, k) FROM way WHERE way.word = f.word) AS root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f"""
