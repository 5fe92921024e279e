"""Proposed entities and relations made to agree with the annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions.spans import adjacent, first_of
from noteweave.functions.text import matches
from noteweave.sources import clinical as W
from noteweave.sources.packs import Pack

#: Characters that a left extension of an entity is made of, and how many of them.
EXTENSION = "[一-龥A-Za-z0-9-]"
EXTENSION_MOST = 12
_BIG = 1_000_000


def left_extensions(text, entity, most: int = EXTENSION_MOST):
    """The entity's occurrences with what runs into them from the left, up to ``most`` characters, as a scan
    from the left finds them (each takes as much as it can, and the next starts behind it)."""
    quoted = F.regexp_replace(entity, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.regexp_extract_all(text, F.concat(F.lit(f"{EXTENSION}{{1,{most}}}"), quoted), F.lit(0))


def suppressed_texts(chunks: DataFrame, entities: DataFrame, status: DataFrame, pack: Pack, key: str = "chunk_id") -> DataFrame:
    """``key, text`` of what an analysis must not name by itself: tokens inside a protected entity, its left
    extensions in the text, and status phrases with their parts."""
    inner = [entities.filter(F.contains(F.col("text"), F.lit(t)) & (F.col("text") != t)).select(key, F.lit(t).alias("text")) for t in pack.inner_tokens]
    long = chunks.select(key, F.col("text").alias("_t")).join(entities.select(key, F.col("text").alias("_e")).distinct(), key)
    left = long.select(key, "_e", F.explode(left_extensions(F.col("_t"), F.col("_e"))).alias("text")).filter("text <> _e").select(key, "text")
    phrase = status.select(key, F.col("evidence_text").alias("text"))
    parts = []
    for column, table in (("value_text", pack.composites.get("value", {})), ("item_text", pack.composites.get("item", {}))):
        parts += [status.filter(F.col(column) == k).select(key, F.lit(v).alias("text")) for k, vs in table.items() for v in vs]
    return reduce(DataFrame.unionByName, [left, phrase, *inner, *parts]).distinct()


def drop_suppressed(entities: DataFrame, relations: DataFrame, suppressed: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Entities that aren't suppressed, and the relations whose two ends aren't."""
    gone = lambda name: suppressed.select(key, F.col("text").alias(name))
    kept = relations.join(gone("subject_text"), [key, "subject_text"], "left_anti").join(gone("object_text"), [key, "object_text"], "left_anti")
    return entities.join(gone("text"), [key, "text"], "left_anti"), kept


def one_per_text(entities: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One entity for each text: the first place, the last one's values."""
    rest = [c for c in entities.columns if c not in (key, "pos", "text")]
    return entities.groupBy(key, "text").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*rest), "pos").alias("_v")).select(key, "pos", "text", *[f"_v.{c}" for c in rest])


def insert_missing(entities: DataFrame, chunks: DataFrame, protected: DataFrame, status: DataFrame, pack: Pack, key: str = "chunk_id") -> DataFrame:
    """The entities with those that the annotations call for: protected ones, the subject where there are
    status rows and the text names it, status items and values; in this order behind the given ones."""
    made = lambda df, text, order, note: df.select(key, order.alias("pos"), text.alias("text"), note.alias("description"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"))
    subject = chunks.filter(F.contains(F.col("text"), F.lit(pack.subject))).select(key).join(status.select(key).distinct(), key, "left_semi")
    asked = [
        made(protected, F.col("text"), F.lit(_BIG) + F.col("pos"), F.concat(F.lit(W.PROTECTED_NOTE[0]), F.col("node_type"), F.lit(W.PROTECTED_NOTE[1]))),
        made(subject, F.lit(pack.subject), F.lit(2 * _BIG), F.lit(W.SUBJECT_NOTE)),
        made(status, F.col("item_text"), F.lit(3 * _BIG) + F.col("pos") * 2, F.lit(W.ITEM_NOTE)),
        made(status, F.col("value_text"), F.lit(3 * _BIG + 1) + F.col("pos") * 2, F.lit(W.VALUE_NOTE)),
    ]
    wanted = first_of(reduce(DataFrame.unionByName, asked), [key, "text"], ["pos"])
    return entities.unionByName(wanted.join(entities.select(key, "text"), [key, "text"], "left_anti").select(entities.columns))


def body_site_pairs(protected: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``l_`` (site) and ``r_`` (procedure) columns of a site and a procedure at most two characters after it."""
    return adjacent(protected.filter("node_type = 'BODY_SITE'"), protected.filter("node_type = 'PROCEDURE'"), [key], 0, 2)


def add_relations(relations: DataFrame, entities: DataFrame, protected: DataFrame, status: DataFrame, pack: Pack, key: str = "chunk_id") -> DataFrame:
    """The relations with subject to item, item to value and procedure to site; one of each subject, object
    and relation, the first."""
    def made(df, subject, obj, relation, evidence, order):
        return df.select(key, order.alias("pos"), subject.alias("subject_text"), obj.alias("object_text"), relation.alias("relation"), evidence.alias("evidence_text"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"))

    item, value, s = F.col("item_text"), F.col("value_text"), F.lit(pack.subject)
    known = status.join(entities.filter(F.col("text") == pack.subject).select(key).distinct(), key, "left_semi")
    more = [
        made(known, s, item, F.concat(F.lit(W.HAS_ITEM[0]), item, F.lit(W.HAS_ITEM[1])), F.col("evidence_text"), F.lit(_BIG) + F.col("pos") * 2),
        made(status, item, value, F.concat(item, F.lit(W.HAS_VALUE[0]), value, F.lit(W.HAS_VALUE[1])), F.col("evidence_text"), F.lit(_BIG + 1) + F.col("pos") * 2),
        made(body_site_pairs(protected, key), F.col("r_text"), F.col("l_text"), F.concat(F.col("r_text"), F.lit(W.HAS_SITE[0]), F.col("l_text"), F.lit(W.HAS_SITE[1])), F.concat("l_text", "r_text"), F.lit(2 * _BIG) + F.col("r_pos") * 1000 + F.col("l_pos")),
    ]
    return first_of(reduce(DataFrame.unionByName, [relations, *more]), [key, "subject_text", "object_text", "relation"], ["pos"])


def proposed_entities(chunks: DataFrame, pattern: str, key: str = "chunk_id") -> DataFrame:
    """A rule in place of a model's analysis: the matches of a pattern, one for each text."""
    found = chunks.select(key, F.posexplode(matches(F.col("text"), pattern)).alias("pos", "m"))
    rows = found.select(key, "pos", F.col("m.text").alias("text"), F.concat(F.lit("at "), F.col("m.start").cast("string")).alias("description"), F.lit(False).alias("negated"), F.lit("confirmed").alias("certainty"))
    return one_per_text(rows, key)
