"""Span operators: islands, overlap merging, gaps, containment, adjacency, nearest on the left.

All take flat tables with ``start`` and ``end`` and a list of key columns ``by``; every join has the key
as an equality, and every window is over one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """Numbers the runs of rows with equal adjacent ``value``, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    return df.withColumn("_new", changed).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def merge_overlaps(df: DataFrame, by: list[str], pos: str, carry: list[str]) -> DataFrame:
    """Overlapping spans become their union with the first one's ``carry``; touching spans stay apart."""
    w = Window.partitionBy(*by).orderBy("start", pos)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    marked = marked.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct(*carry), F.struct("start", pos)).alias("_first")
    out = marked.groupBy(*by, "_isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), first)
    return out.select(*by, "start", "end", *[F.col(f"_first.{c}").alias(c) for c in carry])


def gaps(spans: DataFrame, frame: DataFrame, by: list[str]) -> DataFrame:
    """What disjoint spans leave uncovered of each frame's ``start`` to ``end``: ``by``, ``start``, ``end``,
    ``tail`` (whether it is the last stretch). A frame without spans is one tail."""
    spans = spans.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"))
    w = Window.partitionBy(*by).orderBy("_s")
    rows = frame.select(*by, F.col("start").alias("_from"), F.col("end").alias("_to")).join(spans, by, "left")
    rows = rows.withColumn("_since", F.coalesce(F.lag("_e").over(w), F.col("_from"))).withColumn("_last", F.lead("_s").over(w).isNull())
    inner = F.struct(F.col("_since").alias("start"), F.coalesce("_s", "_since").alias("end"), F.lit(False).alias("tail"))
    tail = F.struct(F.coalesce("_e", "_from").alias("start"), F.when(F.col("_last"), F.col("_to")).otherwise(F.coalesce("_e", "_from")).alias("end"), F.lit(True).alias("tail"))
    return rows.select(*by, F.explode(F.array(inner, tail)).alias("_g")).select(*by, "_g.*").filter("start < end")


def drop_contained(df: DataFrame, by: list[str], ord_col: str) -> DataFrame:
    """Drops spans that lie inside an earlier one of the same key (earlier: by start, then longer, then
    ``ord_col``). Equal spans keep the first."""
    w = Window.partitionBy(*by).orderBy("start", (F.col("end") - F.col("start")).desc(), ord_col).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(w)
    return df.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def adjacent(left: DataFrame, right: DataFrame, by: list[str], least: int, most: int) -> DataFrame:
    """Pairs where right starts ``least`` to ``most`` after left ends: ``l_`` and ``r_`` columns. Left names the
    places where right may start, and an equality join finds those that do."""
    a = left.select(*by, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in by])
    b = right.select(*by, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    a = a.withColumn("_at", F.explode(F.sequence(F.col("l_end") + least, F.col("l_end") + most)))
    return a.join(b.withColumn("_at", F.col("r_start")), [*by, "_at"]).drop("_at")


def nearest_left(points: DataFrame, spans: DataFrame, by: list[str], key: str, within: int, tie: str, width: int | None = None) -> DataFrame:
    """As-of join with tolerance: for each point (column ``at``, named by ``key``) the span of greatest start
    at or before it whose end lies no more than ``within`` before it; ties go to the greatest ``tie``.

    A prefix scan in two levels: places are cut into buckets of ``width`` (``within`` if not given), and points and spans
    of a key and bucket are sorted together, so that a hot key is many small sorts; what a bucket begins with is the last
    span of the buckets before it, told by a window over one row for each bucket. Only where that last span has ended too
    early and an earlier, longer one has not, the point is joined with the spans that outlast their successor and reach
    its bucket."""
    width = width or max(within, 1)
    rest = [c for c in spans.columns if c not in by]
    bucket = lambda at: F.floor(at / width).alias("_b")
    s = spans.select(*by, F.col("start").cast("bigint").alias("_at"), F.col(tie).alias("_tie"), (F.col("end") + within).cast("bigint").alias("_till"), F.struct(*rest).alias("_span"))
    s = s.select("*", bucket(F.col("_at")))
    p = points.select(*by, F.col("at").cast("bigint").alias("_at"), F.col(key).alias("_key"), F.col("at").alias("_point"))
    p = p.select("*", bucket(F.col("_at")))
    one = F.struct("_at", "_tie", "_till", "_span")
    # one row for each bucket that holds a span or a point: the last span and the furthest end before it
    held = s.groupBy(*by, "_b").agg(F.max_by(one, F.struct("_at", "_tie")).alias("_own"), F.max("_till").alias("_reach"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    asked = p.select(*by, "_b").distinct()
    carried = held.join(asked, [*by, "_b"], "full").withColumns({"_carried": F.last("_own", ignorenulls=True).over(before), "_top0": F.max("_reach").over(before)}).select(*by, "_b", "_carried", "_top0")
    order = Window.partitionBy(*by, "_b").orderBy("_at", F.col("_span").isNull(), "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = s.unionByName(p, allowMissingColumns=True).withColumns({"_in": F.last(F.when(F.col("_span").isNotNull(), one), ignorenulls=True).over(order), "_top1": F.max("_till").over(order)})
    seen = seen.filter("_span IS NULL").select(*by, "_b", "_at", "_key", "_point", "_in", "_top1").join(carried, [*by, "_b"])
    seen = seen.withColumns({"_last": F.coalesce("_in", "_carried"), "_top": F.greatest("_top0", "_top1")}).filter("_top >= _at")
    near = seen.filter("_last._till >= _at").select(*by, "_key", "_point", F.col("_last._span").alias("_span"))
    # spans that end behind their successor, in each bucket that they reach beyond the successor's start
    following = Window.partitionBy(*by, "_b").orderBy("_at", "_tie")
    head = s.groupBy(*by, "_b").agg(F.min_by("_till", F.struct("_at", "_tie")).alias("_head"))
    after = Window.partitionBy(*by).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    head = head.withColumn("_head", F.first("_head", ignorenulls=True).over(after))
    outlast = s.withColumn("_next", F.lead("_till").over(following)).join(head, [*by, "_b"]).filter("_till > coalesce(_next, _head)")
    outlast = outlast.select(*by, F.col("_at").alias("_from"), "_tie", "_till", "_span", F.explode(F.sequence("_b", F.floor(F.col("_till") / width))).alias("_b"))
    lost = seen.filter("_last._till < _at").select(*by, "_b", "_at", "_key", "_point").join(outlast, [*by, "_b"]).filter("_from <= _at AND _till >= _at")
    lost = lost.groupBy(*by, "_key", "_point").agg(F.max_by("_span", F.struct("_from", "_tie")).alias("_span"))
    return near.unionByName(lost).select(*by, F.col("_key").alias(key), F.col("_point").alias("at"), *[F.col(f"_span.{c}").alias(f"near_{c}") for c in rest])


def outside(points: DataFrame, spans: DataFrame, by: list[str], at: str) -> DataFrame:
    """The points that lie in none of the spans of their key."""
    s = spans.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("start").alias("_s"), F.col("end").alias("_e"))
    same: Column = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    return points.join(s, same & (F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")), "left_anti")


def containment_pairs(texts: DataFrame, by: list[str], text: str, most: int = 4) -> DataFrame:
    """Pairs of distinct texts of one key where the longer contains the shorter and is at most ``most`` longer:
    ``short_text``, ``long_text``. Each text emits itself trimmed by up to ``most`` characters at its ends,
    and an equality join finds the texts that are one of these: work in proportion to the texts."""
    distinct = texts.select(*by, F.col(text).alias("t")).filter(F.col("t").isNotNull()).distinct()
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n - i).alias("j")) for n in range(1, most + 1) for i in range(n + 1)])
    trims = distinct.select(*by, F.col("t").alias("long_text"), F.explode(cuts).alias("c")).filter(F.length("long_text") > F.col("c.i") + F.col("c.j"))
    trims = trims.select(*by, "long_text", F.expr("substring(long_text, c.i + 1, length(long_text) - c.i - c.j)").alias("t")).distinct()
    return trims.join(distinct, [*by, "t"]).select(*by, F.col("t").alias("short_text"), "long_text")
