"""Section labels of sentences: by rules, inherited, proposed, reviewed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.tables import settled
from noteweave.functions.text import needed_literal
from noteweave.sources.packs import Pack


def rule_label(text: Column, pack: Pack) -> Column:
    """The label of the highest priority whose expressions hit; of equal priorities the first in the pack;
    null without a hit. The rules are few, so they are one expression in the projection: no join."""
    ranked = sorted(enumerate(pack.sections), key=lambda x: (-x[1][1], x[0]))
    out = None
    for _, (name, _, patterns) in ranked:
        hit = None
        for p in patterns:
            one, literal = F.rlike(text, F.lit(pack.flags + p)), needed_literal(pack.flags + p)
            one = F.contains(text, F.lit(literal)) & one if literal else one  # a plain search spares most texts the expression
            hit = one if hit is None else hit | one
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def label_by_rules(sentences: DataFrame, pack: Pack) -> DataFrame:
    return sentences.withColumn("rule_label", rule_label(F.col("text"), pack))


#: Characters of a literal by which a rule is looked up, and rules without a literal that go in one expression.
GRAM = 4
BLOCK_RULES = 200


def label_by_rule_table(sentences: DataFrame, rules: DataFrame) -> DataFrame:
    """The same from a table of rules (``section_id, priority, rule_order, regex``) of any size.

    A rule stands under the first ``GRAM`` characters of a literal that all its matches hold; the sentences name theirs, and an
    equality join finds the rules whose literal the sentence holds: only these compile and try their expressions.
    Rules without such a literal are tried on every sentence, in blocks of one expression each."""
    keyed = settled(rules.select("section_id", "priority", "rule_order", "regex", F.udf(needed_literal)("regex").alias("literal")), "rules")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - GRAM + 1), lambda i: F.substring("text", i, F.lit(GRAM))))
    places = sentences.filter(F.length("text") >= GRAM).select("text_hash", "index", "text", F.explode(grams).alias("_gram"))
    indexed = keyed.filter(F.length("literal") >= GRAM).withColumn("_gram", F.substring("literal", 1, GRAM))
    tried = places.join(indexed, "_gram").filter(F.contains(F.col("text"), F.col("literal"))).filter("text rlike regex")
    best = F.struct("priority", (-F.col("rule_order")).alias("order"), "section_id")
    hits = [tried.select("text_hash", "index", best.alias("best"))]
    block: list = []

    def flush() -> None:
        if block:
            each = [F.when(F.rlike(F.col("text"), F.lit(r["regex"])), F.struct(F.lit(r["priority"]).alias("priority"), F.lit(-r["rule_order"]).alias("order"), F.lit(r["section_id"]).alias("section_id"))) for r in block]
            hits.append(sentences.select("text_hash", "index", F.array_max(F.array(*each)).alias("best")).filter("best IS NOT NULL"))
            block.clear()

    for r in keyed.filter(F.length("literal") < GRAM).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_RULES:
            flush()
    flush()
    found = reduce(DataFrame.unionByName, hits).groupBy("text_hash", "index").agg(F.max("best")["section_id"].alias("rule_label"))
    return sentences.join(found, ["text_hash", "index"], "left")


def inherit_labels(labelled: DataFrame, pack: Pack) -> DataFrame:
    """``section_id``: the rule's label, else the last one before it in the note, else the default."""
    if not pack.inherit:
        return labelled.withColumn("section_id", F.coalesce("rule_label", F.lit(pack.default_first)))
    w = Window.partitionBy("text_hash").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return labelled.withColumn("section_id", F.coalesce(F.last("rule_label", ignorenulls=True).over(w), F.lit(pack.default_first)))


def ingest_labels(proposals: DataFrame, domain: DataFrame, label: str = "section_id") -> tuple[DataFrame, DataFrame]:
    """The proposals whose label is in the domain (column ``name``), and the rejected ones."""
    names = domain.select(F.col("name").alias("_name")).distinct()
    return proposals.join(names, F.col(label) == F.col("_name"), "left_semi"), proposals.join(names, F.col(label) == F.col("_name"), "left_anti")


def overlay_labels(initial: DataFrame, reviews: DataFrame, by: tuple[str, ...] = ("case_id", "index")) -> DataFrame:
    """Reviewed labels over initial ones: the last review of a sentence (by ``pos``) counts; without one the
    initial label stays and the reasoning is empty. ``changed_in_review`` tells whether they differ."""
    last = reviews.groupBy(*by).agg(F.max_by(F.struct("section_id", "reasoning"), "pos").alias("_r"))
    out = initial.join(last, list(by), "left")
    reviewed = F.coalesce("_r.section_id", "section_id")
    return out.select(*by, F.col("section_id").alias("initial_section_id"), F.col("reasoning").alias("initial_reasoning"), reviewed.alias("reviewed_section_id"),
                      F.coalesce("_r.reasoning", F.lit("")).alias("reviewed_reasoning"), (reviewed != F.col("section_id")).alias("changed_in_review"))


def changed_counts(labels: DataFrame, by: str = "case_id") -> DataFrame:
    return labels.groupBy(by).agg(F.sum(F.col("changed_in_review").cast("bigint")).alias("n_changed"))
