"""Quality rules: rules on one document, and the frequency of its lines across a host's documents.

Lines are normalised and hashed, the documents that hold a line are counted for each host, and lines above the
host's limit go: LINE_SHARE of the host's documents, and MIN_LINE_DOCS at least, so that a small host has a limit too. The
document of smallest id that holds a line keeps it, and so do its copies: a much copied document isn't boilerplate to
itself, and of a large group of near copies one stays whole. A document that loses too many of its words is rejected. Only
DataFrame functions.

At scale: what is shuffled are line hashes, never texts; the counts are aggregated before the
shuffle and again by host and line, so that neither a hot host nor a hot line meets in one task;
the join that looks the frequent lines up is one whose hot partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.common import SPACE_CLASS, let, read, words, written

#: A line that more than this share of a host's documents hold, and more than so many of them, is boilerplate.
LINE_SHARE = 0.1
MIN_LINE_DOCS = 5
#: A document that loses more than this share of its words to boilerplate is depleted.
MAX_LOST = (1, 2)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _repeats(w: Column) -> Column:
    """Words in windows of eight that are found twice or more in the array of words."""
    def covered(at: Column) -> Column:  # at: the windows' places, in order
        return F.aggregate(
            F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(2**30))), lambda a, b: F.least(b - a, F.lit(WINDOW))),
            F.lit(0).cast("bigint"), lambda n, x: n + x)

    def places(s: Column) -> Column:  # s: windows by hash and place
        return F.sort_array(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["i"]))

    def windows(h: Column) -> Column:  # h: hashes of words; of two, four and eight after three rounds
        def pairs(x: Column, n: int) -> Column:
            return F.zip_with(F.slice(x, F.lit(1), F.size(x) - n), F.slice(x, F.lit(n + 1), F.size(x) - n), lambda a, b: F.xxhash64(a, b))

        return let(let(let(h, lambda x: pairs(x, 1)), lambda x: pairs(x, 2)), lambda x: pairs(x, 4))

    def exact(h: Column) -> Column:  # the windows whose 64 bits repeat, told apart by 64 more
        more = windows(F.transform(w, lambda x: F.xxhash64(F.lit(7), x)))
        placed = F.zip_with(F.zip_with(h, more, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.sequence(F.lit(1), F.size(h)), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return let(F.sort_array(placed), lambda s: let(places(s), covered))

    none = F.lit(0).cast("bigint")
    return F.when(F.size(w) <= WINDOW, none).otherwise(
        let(windows(F.transform(w, lambda x: F.xxhash64(x))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact(h))))


def base_metrics(text: Column) -> Column:
    """A struct of the rules' figures for one text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE_CLASS + "+", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeats(w).alias("n_repeat_words")))


def normal_line(line: Column) -> Column:
    """A line in lower case (A-Z), digits as 0, runs of white space as one space, trimmed."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.trim(F.regexp_replace(low, SPACE_CLASS + "+", " "))


def _texts(docs: DataFrame, host: str, text: str, doc_id: str) -> DataFrame:
    """``host, text`` (never null), its two hashes ``t1, t2`` and ``id``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(host).alias("host"), t.alias("text"), F.xxhash64(t).alias("t1"), F.hash(t).alias("t2"), F.col(doc_id).alias("id"))


def _lines(texts: DataFrame) -> DataFrame:
    """For each host, distinct text and distinct normalised line of it: the words ``n`` of all such lines in the
    text, its smallest id ``first`` and its documents ``docs``. Copies of a text fold before the shuffle as far as they
    meet there."""
    line = F.transform(F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda x: let(normal_line(x), lambda y: F.struct(F.xxhash64(y).alias("line"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n"))))

    def runs(s: Column) -> Column:  # s: the lines by hash; equal lines have equally many words
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1)["line"] != F.get(s, i)["line"]))
        return let(first, lambda p: F.zip_with(p, F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.size(s))), lambda a, b: F.struct(F.get(s, a)["line"].alias("line"), (F.get(s, a)["n"] * (b - a)).alias("n"))))

    folded = let(F.sort_array(line), lambda s: F.when(F.size(s) > 0, runs(s)))
    each = texts.select("host", "t1", "t2", "id", F.explode(folded).alias("l"))
    return each.select("host", "t1", "t2", "id", "l.line", "l.n").groupBy("host", "t1", "t2", "line").agg(F.max("n").alias("n"), F.min("id").alias("first"), F.count("*").alias("docs"))


def _often(texts: DataFrame, lines: DataFrame, min_docs: int, share: float) -> DataFrame:
    """``host, line, n_docs, keeper`` of the lines above their host's limit."""
    # the words are named here too so that both uses of the lines have one shuffle
    counted = lines.groupBy("host", "line").agg(F.sum("docs").alias("n_docs"), F.max("n").alias("n_words"), F.min("first").alias("keeper"))
    above = counted.filter((F.col("n_docs") > min_docs) & (F.col("n_words") > 0))
    size = texts.groupBy("host").agg(F.count("*").alias("_size")).withColumnRenamed("host", "_of")
    return above.join(size, above["host"].eqNullSafe(size["_of"])).filter(F.col("n_docs") > F.col("_size") * share).select("host", "line", "n_docs", "keeper")


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """``host``, ``line`` (hash of the normalised line), ``n_docs`` and ``keeper`` (smallest id) of the lines that
    more than ``min_docs`` documents of the host hold, and more than ``share`` of them. A null host is a host."""
    texts = _texts(docs, host, text, doc_id)
    return _often(texts, _lines(texts), min_docs, share)


def lost_words(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """For each distinct host and text that holds frequent lines, but for those that it keeps: ``host, t1, t2``, the
    hashes of those lines, and the number of words in them."""
    texts = _texts(docs, host, text, doc_id)
    lines = _lines(texts)
    often = _often(texts, lines, min_docs, share).select(F.col("host").alias("h"), F.col("line").alias("l"), "keeper")
    hit = lines.join(often, lines["host"].eqNullSafe(often["h"]) & (lines["line"] == often["l"])).filter(~F.col("first").eqNullSafe(F.col("keeper")) | F.col("first").isNull())
    return hit.groupBy("host", "t1", "t2").agg(F.collect_set("line").alias("lines"), F.sum("n").alias("lost"))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(docs: DataFrame, row: Column, host: str, text: str, doc_id: str, min_docs: int, share: float, max_lost: tuple[int, int]) -> DataFrame:
    """``row``, ``host, t1, t2``, ``m`` (the metrics), ``lines``, ``lost``, ``base_failed`` and ``kept``."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(row.alias("row"), F.col(host).alias("host"), F.xxhash64(t).alias("t1"), F.hash(t).alias("t2"), base_metrics(F.col(text)).alias("m"))
    lost = lost_words(docs, host, text, doc_id, min_docs, share).withColumnsRenamed({"host": "_h", "t1": "_t1", "t2": "_t2", "lost": "_lost"})
    out = own.join(lost, own["host"].eqNullSafe(lost["_h"]) & (own["t1"] == lost["_t1"]) & (own["t2"] == lost["_t2"]), "left")
    failed = (F.col("m.n_words") < MIN_WORDS) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * MAX_REPEAT_PERCENT)
    out = out.select("row", "host", "t1", "t2", "m", "lines", F.coalesce("_lost", F.lit(0)).cast("bigint").alias("lost"), failed.alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") * max_lost[1] <= F.col("m.n_words") * max_lost[0]))


def judge(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE, max_lost: tuple[int, int] = MAX_LOST) -> DataFrame:
    """The rows, without their text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_lost_words`` (words in frequent lines that the document doesn't
    keep) and ``kept``. Columns of the input with these names are replaced.

    Empty and null texts have no words, so they fail the base rules. Each row counts as a document;
    copies are judged alike. A document without an id keeps no frequent line. An empty table
    gives an empty result.
    """
    results = (*METRICS, "base_failed", "n_lost_words", "kept")
    names = [c for c in docs.columns if c != text and c not in results]
    out = _judged(docs, F.struct(*[docs[c] for c in names]) if names else F.struct(F.lit(0)), host, text, doc_id, min_docs, share, max_lost)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *[F.col("m").getField(c).alias(c) for c in METRICS], "base_failed", F.col("lost").alias("n_lost_words"), "kept")


def apply_rules(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE, max_lost: tuple[int, int] = MAX_LOST) -> DataFrame:
    """The documents that the rules keep, with their columns, their frequent lines (but those they keep) removed
    from the text. What is left of a text keeps its other lines as they were, joined by line ends."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[host].alias("_source"), docs[text].alias("_text"))
    # the verdicts are written without the texts, for a filter on figures in one plan would compute them twice
    verdict = _judged(docs, F.lit(0), host, text, doc_id, min_docs, share, max_lost)
    kept = written(verdict.select("host", "t1", "t2", "lines", "kept"), "verdicts").filter("kept").dropDuplicates(["host", "t1", "t2"])
    t = F.coalesce("_text", F.lit(""))
    rows = rows.withColumns({"_a": F.xxhash64(t), "_b": F.hash(t)})
    out = rows.join(kept, rows["_source"].eqNullSafe(kept["host"]) & (rows["_a"] == kept["t1"]) & (rows["_b"] == kept["t2"]))
    stay = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains(F.col("lines"), F.xxhash64(normal_line(x)))), "\n")
    cleaned = F.when(F.col("lines").isNull(), F.col("_text")).otherwise(stay)
    return out.select("_row", cleaned.alias("_clean")).select(*[F.col("_clean").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and the verdict."""
    return judge(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def oracle() -> str:
    normal = r"trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'))"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
    win AS (SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g
            FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WINDOW - 2})) AS i)),
    rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
    cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
            FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
    ln AS (SELECT rid, source, text, line FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY rid),
    nl AS (SELECT rid, source, text, {normal} AS line FROM ln),
    first AS (SELECT source, text, min(doc_id) AS first FROM d GROUP BY source, text),
    host AS (SELECT source, count(*) AS size FROM d GROUP BY source),
    often AS (SELECT nl.source, line, min(doc_id) AS keeper FROM nl JOIN d USING (rid) JOIN host ON nl.source IS NOT DISTINCT FROM host.source
              GROUP BY nl.source, line HAVING count(DISTINCT rid) > greatest({MIN_LINE_DOCS}, {LINE_SHARE} * any_value(size))),
    lost AS (SELECT rid, sum(len(string_split(nl.line, ' '))) AS n FROM nl JOIN often ON nl.source IS NOT DISTINCT FROM often.source AND nl.line = often.line
             JOIN first f ON f.source IS NOT DISTINCT FROM nl.source AND f.text = nl.text WHERE f.first IS NULL OR f.first <> keeper GROUP BY rid),
    m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                 CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
                 CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words
          FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND n_lost_words * {MAX_LOST[1]} <= n_words * {MAX_LOST[0]} AS kept FROM f"""
