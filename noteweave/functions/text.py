"""Text columns: keys, white space, matches with offsets. Offsets are 0-based code points, end exclusive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, listed, so that one class serves any regular expression engine.
WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Line ends that never belong to a sentence, and the rarer ones that stay at its end.
LINE_ENDS = "\n\r"
RARE_LINE_ENDS = "\x0b\x0c\x1c\x1d\x1e" + "".join(map(chr, (0x85, 0x2028, 0x2029)))


def quote(literal: str) -> str:
    """A literal as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


_SPECIAL = set(".^$*+?{}[]|()")


def needed_literal(pattern: str) -> str:
    """The longest run of characters that every match of an expression holds, by reading it from the left: a run ends at anything
    that isn't a plain character; a quantifier takes the last character off. Expressions with alternatives or flags at their top level have none
    (empty)."""
    runs, run, depth, i = [""], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            follows = pattern[i + 1 : i + 2]
            if follows in set("xu0ckQEN"):
                return ""  # a character or a name written out
            literal = follows if follows and not follows.isalnum() else None
            i += 2
        elif c == "[":
            i += 2 if pattern[i + 1 : i + 2] != "^" else 3
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            literal, i = None, i + 1
        elif c == "|" and depth == 0:
            return ""
        elif c == "(":
            if depth == 0 and pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
                return ""
            depth, literal, i = depth + 1, None, i + 1
        elif c == ")":
            depth, literal, i = depth - 1, None, i + 1
        elif c in "*?{+":
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return ""
            run, literal, i = run[:-1] if depth == 0 else run, None, i + 1
        else:
            literal, i = (c if c not in _SPECIAL else None), i + 1
        if literal is None or depth:
            runs.append(run)
            run = ""
        else:
            run += literal
    return max([*runs, run], key=len)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))  # from both ends; an expression would be tried at every character


def is_blank(c: Column) -> Column:
    return ~F.rlike(c, F.lit(f"[^{WS}]"))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def case_id(hash_col: Column) -> Column:
    """For display; join on the whole hash, for twelve digits collide at some ten million notes."""
    return F.concat(F.lit("case_"), F.substring(hash_col, 1, 12))


def section_key(case: Column, section: Column) -> Column:
    return F.format_string("%s_sec%03d", case, _index(section))


def chunk_key(case: Column, section: Column, chunk: Column) -> Column:
    return F.format_string("%s_sec%03d_chk%03d", case, _index(section), _index(chunk))


def node_key(case: Column, section: Column, node: Column) -> Column:
    return F.format_string("%s_sec%03d_nd%04d", case, _index(section), _index(node))


def edge_key(case: Column, section: Column, edge: Column) -> Column:
    return F.format_string("%s_sec%03d_ed%04d", case, _index(section), _index(edge))


def graph_key(case: Column, section: Column) -> Column:
    return F.format_string("%s_sec%03d_graph", case, _index(section))


def _index(i: Column) -> Column:
    """An index from 1 up; anything else is an error."""
    return F.when(i >= 1, i).otherwise(F.raise_error(F.concat(F.lit("index must be 1 or more: "), F.coalesce(i.cast("string"), F.lit("null")))).cast("int"))


#: Items that a scan gathers at once, and characters of a block of text.
BLOCK = 256
TEXT_BLOCK = 2048


def scan(items: Column, state: Column, step, emit) -> tuple[Column, Column]:
    """A left fold that also gives a value for each item: ``emit(state, item)``, with the state before it, and
    ``step(state, item)``, the state after it. The values are gathered block by block: appending to one array would
    copy it once for each item. Returns the last state and the values."""
    def inner(a: Column, x: Column) -> Column:
        return F.struct(step(a["s"], x).alias("s"), F.array_append(a["out"], emit(a["s"], x)).alias("out"))

    def outer(a: Column, block: Column) -> Column:
        return let(F.aggregate(block, F.struct(a["s"].alias("s"), none.alias("out")), inner), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out")))

    none = F.filter(F.array(emit(state, F.get(items, F.lit(0)))), lambda x: F.lit(False))
    count = F.size(items)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(count - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    done = F.aggregate(blocks, F.struct(state.alias("s"), F.filter(F.array(none), lambda x: F.lit(False)).alias("out")), outer)
    return done["s"], F.flatten(done["out"])


def _fold(pieces: Column) -> Column:
    """Each piece's start, if the pieces make up the text."""
    return scan(pieces, F.lit(0), lambda at, p: at + F.length(p), lambda at, p: at)[1]


def slices(text: Column, spans: Column) -> Column:
    """The text of each span (``start``, ``end``). The text is cut into blocks first, for a substring of a long
    text is counted from its beginning."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / TEXT_BLOCK).cast("int")), lambda i: F.substring(text, i * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)))

    def cut(b: Column, s: Column) -> Column:
        first = F.floor(s["start"] / TEXT_BLOCK).cast("int")
        several = F.slice(b, first + 1, F.floor(F.greatest(s["end"] - 1, s["start"]) / TEXT_BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(several, ""), s["start"] - first * TEXT_BLOCK + 1, s["end"] - s["start"])

    return let(blocks, lambda b: F.transform(spans, lambda s: cut(b, s)))


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start, end, text>>``, by the gaps between them. Any pattern without
    empty matches will do, look-around and anchors too."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
    at = F.transform(F.array(F.struct(pieces.alias("p"), found.alias("f"))), lambda s: F.transform(F.array(_fold(s["p"])), lambda o: F.transform(s["f"], lambda m, i: F.struct(
        F.get(o, 2 * i + 1).alias("start"), (F.get(o, 2 * i + 1) + F.length(m)).alias("end"), m.alias("text"))))[0])[0]
    return F.when(F.rlike(text, F.lit(pattern)), at).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def sql_string(value: str) -> str:
    """A literal of SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(text: str, pattern: str) -> str:
    """``matches`` as SQL text, for expressions over many patterns: those are handed to Spark as one text and not
    node by node. ``text`` is the SQL of a column."""
    p = sql_string(pattern)
    empty = "cast(array() as array<struct<start:int,end:int,text:string>>)"
    block = f"transform(sequence(0, cast(floor(greatest(size(p) - 1, 0) / {BLOCK}) as int)), i -> slice(p, i * {BLOCK} + 1, {BLOCK}))"
    inner = "aggregate(b, named_struct('s', a.s, 'out', cast(array() as array<int>)), (c, x) -> named_struct('s', c.s + length(x), 'out', array_append(c.out, c.s)))"
    fold = f"flatten(aggregate({block}, named_struct('s', 0, 'out', cast(array() as array<array<int>>)), (a, b) -> transform(array({inner}), r -> named_struct('s', r.s, 'out', array_append(a.out, r.out)))[0]).out)"
    pieces = f"flatten(zip_with(split({text}, {p}, -1), f, (g, m) -> array(g, coalesce(m, ''))))"
    placed = f"transform(array({pieces}), p -> transform(array({fold}), o -> transform(f, (m, i) -> named_struct('start', get(o, 2 * i + 1), 'end', get(o, 2 * i + 1) + length(m), 'text', m)))[0])[0]"
    literal = needed_literal(pattern)
    if literal and quote(literal) == pattern:  # the pieces between tell the places
        n = len(literal)
        step = inner.replace("c.s + length(x)", f"c.s + length(x) + {n}")
        starts = f"flatten(aggregate({block}, named_struct('s', 0, 'out', cast(array() as array<array<int>>)), (a, b) -> transform(array({step}), r -> named_struct('s', r.s, 'out', array_append(a.out, r.out)))[0]).out)"
        placed = f"transform(array(split({text}, {p}, -1)), p -> transform(slice({starts}, 2, size(p) - 1), o -> named_struct('start', o - {n}, 'end', o, 'text', {sql_string(literal)})))[0]"
        return f"CASE WHEN contains({text}, {sql_string(literal)}) THEN {placed} ELSE {empty} END"
    holds = f"contains({text}, {sql_string(literal)})" if literal else f"rlike({text}, {p})"
    return f"CASE WHEN {holds} THEN transform(array(regexp_extract_all({text}, {p}, 0)), f -> {placed})[0] ELSE {empty} END"


def tiles(text: Column, pattern: str) -> Column:
    """As ``matches`` for a pattern whose matches cover the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.array(found), lambda f: F.zip_with(f, _fold(f), lambda p, a: F.struct(a.alias("start"), (a + F.length(p)).alias("end"), p.alias("text"))))[0]


def literal_matches(text: Column, term: str) -> Column:
    return matches(text, quote(term))
