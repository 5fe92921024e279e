"""Rule packs as tables: written to rows, read from files or tables, checked row by row.

A row is ``kind, name, priority, rule_order, value, extra``:

======== ============ ======== =================== =========== ==========
kind     name         priority rule_order          value       extra
======== ============ ======== =================== =========== ==========
setting  field        0        0                   its value
section  section id   priority the section's place expression
cue      type         0        place               expression
lexicon  node type    0        place               term        source
suffix   node type    0        place               expression  source
leading               0        place               expression
site                  0        place               term
status   item         pair     the rule's place    expression  value
inner                 0        place               term
part     item, value  0        place               whole       its part
negation list         0        place               word
======== ============ ======== =================== =========== ==========
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.sources.packs import Pack

SCHEMA = "kind string, name string, priority int, rule_order int, value string, extra string"
KINDS = ("setting", "section", "cue", "lexicon", "suffix", "leading", "site", "status", "inner", "part", "negation")
_EXPRESSIONS = {"section", "cue", "suffix", "leading", "status"}
_SETTINGS = ("name", "terminators", "soft_terminators", "default_first", "inherit", "status_context", "subject", "default_chunk_type", "flags")
_NEGATION = {"triggers", "terminators", "breakers", "separators", "boundaries", "clause_stops", "lead", "whole_words"}
#: A pack is an expression in each plan. Rules beyond this many characters belong in tables (``label_by_rule_table``,
#: ``large_lexicon_spans``), which take any number.
MOST_CHARACTERS = 1 << 20


def pack_rows(pack: Pack) -> list[tuple]:
    """A pack's rows, as ``SCHEMA`` has them."""
    out = [("setting", f, 0, 0, str(getattr(pack, f)), None) for f in _SETTINGS]
    out += [("section", s, p, i, r, None) for i, (s, p, rs) in enumerate(pack.sections) for r in rs]
    out += [("cue", k, 0, i, r, None) for i, (r, k) in enumerate(pack.cues)]
    for kind, table in (("lexicon", pack.lexicon), ("suffix", pack.suffixes)):
        out += [(kind, k, 0, i, t, s) for i, (t, k, s) in enumerate(table)]
    for kind, values in (("leading", pack.leading), ("site", pack.sites), ("inner", pack.inner_tokens)):
        out += [(kind, None, 0, i, v, None) for i, v in enumerate(values)]
    out += [("status", item, j, i, r, value) for i, (r, pairs) in enumerate(pack.status) for j, (item, value) in enumerate(pairs)]
    out += [("part", name, 0, i, whole, part) for name, table in pack.composites.items() for whole, parts in table.items() for i, part in enumerate(parts)]
    for name, words in pack.negation.items():
        out += [("negation", name, 0, 0, str(words), None)] if isinstance(words, (bool, str)) else [("negation", name, 0, i, w, None) for i, w in enumerate(words)]
    return out


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows from JSON lines."""
    return spark.read.schema(SCHEMA).json(path)


def check_rules(rules: DataFrame, node_types: Collection[str] | None = None, sections: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that can be used, and the others with a ``reason``: an unknown kind, list or setting; no value; a node type or
    section id out of its domain, where one is given; an expression that doesn't compile. Sections of one priority
    keep their order in the pack (``ties`` lists them)."""
    pattern = rules.sparkSession._jvm.java.util.regex.Pattern

    reason = F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind").when(F.col("value").isNull() | ((F.col("value") == "") & (F.col("kind") != "setting")), "no value")
    reason = reason.when((F.col("kind") == "setting") & ~F.coalesce(F.col("name").isin(*_SETTINGS), F.lit(False)), "unknown setting").when((F.col("kind") == "negation") & ~F.coalesce(F.col("name").isin(*_NEGATION), F.lit(False)), "unknown list")
    if node_types is not None:
        reason = reason.when(F.col("kind").isin("lexicon", "suffix") & ~F.coalesce(F.col("name").isin(*node_types), F.lit(False)), "unknown node type")
    if sections is not None:
        reason = reason.when((F.col("kind") == "section") & ~F.coalesce(F.col("name").isin(*sections), F.lit(False)), "unknown section")
    judged = rules.withColumn("reason", reason)
    broken = []
    for r in judged.filter(F.col("reason").isNull() & F.col("kind").isin(*sorted(_EXPRESSIONS))).select("value").distinct().toLocalIterator():
        try:
            pattern.compile(r["value"])
        except (Py4JJavaError, IllegalArgumentException):
            broken.append((r["value"],))
    bad = rules.sparkSession.createDataFrame(broken, "_broken string")
    judged = judged.join(bad, (F.col("value") == F.col("_broken")) & F.col("kind").isin(*sorted(_EXPRESSIONS)), "left")
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col("_broken").isNotNull(), "expression doesn't compile"))).drop("_broken")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def ties(rules: DataFrame) -> DataFrame:
    """``priority, sections``: priorities that several sections share; the first in the pack wins."""
    return rules.filter("kind = 'section'").groupBy("priority").agg(F.sort_array(F.collect_set(F.struct("rule_order", "name"))).alias("s")).filter("size(s) > 1").select("priority", F.transform("s", lambda x: x["name"]).alias("sections"))


def load_pack(rules: DataFrame) -> Pack:
    """A pack from checked rows. Their size is measured first: more than ``MOST_CHARACTERS`` is an error, as a pack becomes part
    of each plan; larger tables have operators of their own."""
    size = rules.agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("n")).first()["n"]
    if size > MOST_CHARACTERS:
        raise ValueError(f"{size} characters of rules: use the operators on tables")
    of: dict[str, list] = defaultdict(list)
    for r in sorted(rules.collect(), key=lambda r: (r["kind"], r["rule_order"] or 0, r["priority"] or 0)):
        of[r["kind"]].append(r)
    given = {r["name"]: r["value"] for r in of["setting"]}
    sections: dict = {}
    for r in of["section"]:
        sections.setdefault((r["rule_order"], r["name"], r["priority"]), []).append(r["value"])
    status: dict = {}
    for r in of["status"]:
        status.setdefault((r["rule_order"], r["value"]), []).append((r["name"], r["extra"]))
    parts: dict = {}
    for r in of["part"]:
        parts.setdefault(r["name"], {}).setdefault(r["value"], []).append(r["extra"])
    negation: dict = {}
    for r in of["negation"]:
        negation.setdefault(r["name"], []).append(r["value"])
    whole = {k: v[0] == "True" if k == "whole_words" else v[0] if k in ("clause_stops", "lead") else tuple(v) for k, v in negation.items()}
    return Pack(**{k: v == "True" if k == "inherit" else v for k, v in given.items()}, sections=tuple((n, p, tuple(rs)) for (_, n, p), rs in sections.items()), cues=tuple((r["value"], r["name"]) for r in of["cue"]),
                lexicon=tuple((r["value"], r["name"], r["extra"]) for r in of["lexicon"]), suffixes=tuple((r["value"], r["name"], r["extra"]) for r in of["suffix"]), leading=tuple(r["value"] for r in of["leading"]), sites=tuple(r["value"] for r in of["site"]),
                status=tuple((v, tuple(pairs)) for (_, v), pairs in status.items()), inner_tokens=tuple(r["value"] for r in of["inner"]), composites={n: {w: tuple(ps) for w, ps in t.items()} for n, t in parts.items()}, negation=whole)
