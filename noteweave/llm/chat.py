"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) in their order into one
string: text is escaped, every other part leaves a numbered placeholder, and its reference and the
number of tokens that the placeholder expands to are recorded beside the string. The turns of a
conversation make one string that reads back without loss.

The template is ``<s>{role}[INST] {body} [/INST]</s>`` for each turn. The control strings ``<s>``,
``</s>``, ``[INST]``, ``[/INST]`` and ``<|`` can't come from a text: a backslash becomes ``\\b``,
and ``\\-`` goes behind the first character of a control string. Undoing both is exact, for after
escaping every backslash begins one of the two.

Only DataFrame functions; one shuffle, by conversation. A conversation is one row of the result, so
the turns of one conversation meet in one task, which holds their text (as the row must anyway).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions.text import scan, slices
from noteweave.llm.common import read

CONTROL = r"(<)(/?s>|\|)|(\[)(/?INST\])"
#: Tokens that one unit of an attachment expands to: a tile of an image, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 1024}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def _backslashes(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\b"))


def _controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$3\\-$2$4")


def escape(text: Column) -> Column:
    return _controls(_backslashes(text))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\-"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def visit_parts(parts: Column, unit_tokens: dict[str, int] = UNIT_TOKENS) -> tuple[Column, Column]:
    """The body of a turn, and its attachments in order: ``array<struct<slot, type, ref, tokens>>``.

    A part of an unknown or null type counts as text; null text is empty; null units are one. The control
    strings are escaped in what the text parts between two attachments make together, so that no
    string is put together from several parts: while the parts are joined, a placeholder is a backslash string
    that no escaped text can hold.
    """
    tokens = F.create_map(*[F.lit(x) for kv in sorted(unit_tokens.items()) for x in kv])
    kinds = list(unit_tokens)
    is_attached = lambda p: F.coalesce(p["type"].isin(kinds), F.lit(False))
    attachments = F.transform(F.filter(parts, is_attached), lambda p, i: F.struct(
        (i + 1).alias("slot"), p["type"].alias("type"), p["ref"].alias("ref"),
        (F.coalesce(p["units"], F.lit(1)) * tokens[p["type"]]).cast("bigint").alias("tokens")))
    pieces = scan(
        parts, F.lit(0), lambda n, p: n + F.when(is_attached(p), 1).otherwise(0),
        lambda n, p: F.when(is_attached(p), F.concat(F.lit("\\p"), p["type"], F.lit(":"), (n + 1).cast("string"), F.lit(";"))).otherwise(_backslashes(F.coalesce(p["text"], F.lit("")))))[1]
    body = F.regexp_replace(_controls(F.array_join(pieces, "")), r"\\p([^:;]+):([0-9]+);", "<|$1:$2|>")
    return F.coalesce(body, F.lit("")), attachments


def format_chat(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: ``formatted``, ``loss_turns`` (for each turn, whether its body
    bears loss), ``loss_spans`` (``start`` and ``end`` in code points of ``formatted``, 0-based, end exclusive, of the
    bodies that bear loss), ``attachments`` (all turns', with the turn's place) and ``expanded_tokens``. A turn is
    its ``parts``, or without that column its text as one text part; either goes through the visitor.

    Turns go by ``order``, then role, then text, nulls first, so ties have one result. A null text is
    empty, a null role is an empty role, a null key is a conversation of its own; repeated rows are
    repeated turns. An empty table gives an empty result. Other columns of the input are ignored.
    """
    one = F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))) if not parts else F.col(parts)
    body, attached = visit_parts(F.coalesce(one, F.array()).cast(PARTS))
    who = F.coalesce(F.col(role), F.lit(""))
    turn = F.struct(
        F.col(order).alias("order"), who.alias("role"), F.col(text).alias("text") if not parts else F.to_json(F.col(parts)).alias("text"),
        F.concat(F.lit("<s>"), escape(who), F.lit("[INST] ")).alias("head"), body.alias("body"),
        who.isin(list(loss_roles)).alias("loss"), attached.alias("attached"))
    tail = " [/INST]</s>"
    ordered = turns.select(F.col(key).alias(key), turn.alias("t")).groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spans = scan(F.col("ts"), F.lit(0), lambda at, t: at + F.length(t["head"]) + F.length(t["body"]) + len(tail),
                 lambda at, t: F.when(t["loss"], F.struct((at + F.length(t["head"])).alias("start"), (at + F.length(t["head"]) + F.length(t["body"])).alias("end"))))[1]
    return ordered.select(
        key,
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.transform("ts", lambda t: t["loss"]).alias("loss_turns"),
        F.array_compact(spans).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["attached"], lambda a: F.struct((i + 1).alias("turn_no"), a["slot"].alias("slot"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.transform("ts", lambda t: t["attached"])), F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def loss_spans(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """The spans under the loss mask, one row each: key, ``start`` and ``end``."""
    return formatted.select(key, F.explode("loss_spans").alias("s")).select(key, "s.*")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(slices(formatted, spans), unescape), "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``, unescaped."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    at = lambda p: F.instr(p, "[INST] ")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(p, F.lit(4), at(p) - 4)).alias("role"),
        unescape(F.substring(p, at(p) + 7, F.length(p) - at(p) - 6 - len(" [/INST]"))).alias("text")))


EXTRA_ID = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, read back and digested."""
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    out = format_chat(turns).select("conv_id", "formatted", "expanded_tokens", loss_text(F.col("formatted"), F.col("loss_spans")).alias("lost"), read_back(F.col("formatted")).alias("back"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("bigint").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "expanded_tokens")


def oracle() -> str:
    esc = lambda c: rf"regexp_replace(replace({c}, '\', '\b'), '(<)(/?s>|\|)|(\[)(/?INST\])', '\1\3\\-\2\4', 'g')"
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, text AS raw FROM conversations
      UNION ALL SELECT {EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}', '{EXTRA_TEXT}'
      UNION ALL SELECT {EXTRA_ID}, 1, 'assistant', '{EXTRA_TEXT}', '{EXTRA_TEXT}')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, raw NULLS FIRST)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, raw NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length({esc('role')}) + length({esc('text')}) + {len('<s>[INST]  [/INST]</s>')}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
    FROM t GROUP BY conv_id"""
