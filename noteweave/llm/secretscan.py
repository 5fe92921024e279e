"""Secret scans: fixed patterns, and literals that source or configuration text assigns to sensitive names.

A text is lexed into names, string literals, operators and line ends. Assignments in source code, dictionary and JSON entries,
INI, properties and YAML lines, subscripts, pairs in calls, markup elements, attributes named by another attribute, and
command-line flags become pairs of a name and literals or other names. Names are constants of the text: a sensitive name
hands its score on to the names that it is set from, so a literal is judged by the most sensitive name it reaches, in
whatever order the lines stand. A literal is a secret if that name's score and its own (length, variety, digits beside
letters; placeholders, words and places count against it) reach a threshold.

Each document is scanned by itself: one pass, no shuffle. Scores move along assignments in a worklist; they have few
levels, so each name is handled a few times however many aliases there are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from noteweave.llm.common import read

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so this is a run of 24 and more
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

#: Points for the words of a name.
STRONG = {"password", "passwd", "pwd", "passphrase", "passcode", "pass", "pw", "secret", "token", "apikey", "credential", "credentials", "privatekey", "secretkey", "accesskey", "authtoken"}
STRONG_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("master", "key"), ("shared", "key"), ("account", "key"), ("connection", "string")}
MEDIUM = {"auth", "key", "cred", "creds", "authorization", "bearer", "salt", "cookie", "session", "signature", "pin", "psk"}
#: Words that make a name one about a secret.
ABOUT = {"count", "max", "min", "length", "len", "size", "limit", "url", "uri", "file", "filename", "path", "dir", "name", "field", "label", "type", "expiry", "expires", "ttl", "timeout", "public", "policy", "hint", "prompt", "format", "regex", "pattern", "column", "header", "endpoint", "id", "index", "scope", "version", "message", "error", "title", "text", "primary", "foreign"}
THRESHOLD = 3
LEAST_LITERAL = 6

_MAYBE = re.compile(r"pass|pwd|pw|secret|token|key|auth|cred|salt|cookie|session|signature|pin|psk|bearer|connection", re.I | re.A)
_TOKEN = re.compile(r"""
  (?P<str>(?<!\w)[rRbBfFuU]{0,2}(?P<q>\"\"\"|'''|"|'|`)(?P<body>(?:(?<=\"\"\")(?:[^\\]|\\.)*?(?=\"\"\")|(?<=''')(?:[^\\]|\\.)*?(?=''')|(?:[^"'`\\\n]|\\.|(?!(?P=q))["'`])*))(?P=q))
 |(?P<name>[$@]?[A-Za-z_]\w*(?:(?:\.|-|::|->)[A-Za-z_]\w*)*)
 |(?P<op>:=|=>|==|!=|<=|>=|<-|[=:+,;(){}\[\]<>\\])
 |(?P<end>\n)
 |(?P<rest>[^\s"'`=:+,;(){}\[\]<>\\]+|["'`])
""", re.X | re.S)
_SET = {"=", ":", ":=", "=>", "<-"}
_VALUE = re.compile(r"""[ \t]*([^\s"'`,;(){}\[\]<>#]+)""")
_LINE_END = re.compile(r"[ \t]*[,;]?[ \t]*(?:[#;].*)?(?:\r?\n|$)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]{0,63})>([^<>\s]{6,})</\1>")
_NAMED = re.compile(r"""\b(?:key|name)\s{0,9}=\s{0,9}(["'])([\w.-]{1,64})\1\s{1,9}value\s{0,9}=\s{0,9}(["'])((?:(?!\3)[^\n<>])*)\3""", re.I)
_FLAG = re.compile(r"""(?<![\w-])--([A-Za-z][\w-]{0,63})[ \t]+(?!-)["']?([^\s"'`,;()<>]+)""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_KEY = re.compile(r"[$@]?[A-Za-z_][\w.-]{0,63}")
_PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|dummy|sample|redacted|^your|your[-_]|^insert|^todo|^none$|^null$|^true$|^false$|^undefined$|^default$|^(.)\1*$|[<{%$]\w*[({<]|^\$|^%|^<.*>$|\*{3}|x{4}|\.{3}")
_PLACE = re.compile(r"^(?:[a-z][a-z+.-]*://|\.{0,2}/|[A-Za-z]:\\)")


class Literal(NamedTuple):
    start: int
    end: int
    text: str


def name_score(name: str) -> int:
    """3 for a name of a secret, 2 for one that may be, 0 for others and for names of something about a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or any(w in ABOUT for w in words):
        return 0
    if any(w in STRONG for w in words) or any(p in STRONG_PAIRS for p in zip(words, words[1:], strict=False)):
        return 3
    return 2 if any(w in MEDIUM for w in words) else 0


def literal_score(text: str) -> int:
    """Points for what looks drawn at random, against what looks written or stands for something else."""
    if len(text) < LEAST_LITERAL or _PLACEHOLDER.search(text):
        return -9
    if _PLACE.search(text) and "@" not in text:
        return -9
    n = len(text)
    spread = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    mixed = bool(re.search(r"[0-9]", text)) and bool(re.search(r"[A-Za-z]", text))
    spaced = bool(re.search(r"\s", text))
    dotted = not mixed and bool(re.fullmatch(r"[A-Za-z_]+(?:[._-][A-Za-z_]+)+", text))
    return mixed + (n >= 16) + (spread >= 3.5) - 3 * spaced - 3 * dotted


def pairs(text: str) -> tuple[dict[str, list[Literal]], dict[str, set[str]]]:
    """The literals that each name of a text is set to, and the names that it is set from."""
    literals: dict[str, list[Literal]] = defaultdict(list)
    origins: dict[str, set[str]] = defaultdict(set)
    tokens = [(m.lastgroup if m.lastgroup not in ("q", "body") else "str", m) for m in _TOKEN.finditer(text)]

    def literal(m: re.Match) -> Literal:
        return Literal(m.start("body"), m.end("body"), m["body"])

    def target(i: int) -> str | None:  # the name that ends before token i
        while i >= 2 and tokens[i][0] == tokens[i - 1][0] == "op" and tokens[i - 1][1]["op"] + tokens[i][1]["op"] == "[]":
            i -= 2  # an array's brackets
        if i < 0:
            return None
        kind, m = tokens[i]
        if kind == "name":
            return m["name"]
        if kind == "str" and _KEY.fullmatch(m["body"]):
            return m["body"]
        if kind == "op" and m["op"] == "]" and i >= 2:
            before, inner = tokens[i - 1]
            if before == "str" and _KEY.fullmatch(inner["body"]):
                return inner["body"]
        return None

    for i, (kind, m) in enumerate(tokens):
        if kind == "op" and m["op"] in _SET:
            names = [t for t in (target(i - 1),) if t]
            if m["op"] == "=" and i >= 3 and tokens[i - 2][0] == "op" and tokens[i - 2][1]["op"] == ":":
                names += [t for t in (target(i - 3),) if t]  # name: type = value
            if names:
                _value(text, tokens, i, m, names, literals, origins, literal)
        elif kind == "op" and m["op"] == "(" and i + 3 < len(tokens):
            (a, x), (b, y), (c, z) = tokens[i + 1 : i + 4]
            if a == "str" and b == "op" and y["op"] == "," and c == "str" and _KEY.fullmatch(x["body"]):
                literals[x["body"]].append(literal(z))  # call("name", "value")
    for m in _ELEMENT.finditer(text):
        literals[m[1]].append(Literal(m.start(2), m.end(2), m[2]))
    for m in _NAMED.finditer(text):
        literals[m[2]].append(Literal(m.start(4), m.end(4), m[4]))
    for m in _FLAG.finditer(text):
        literals[m[1]].append(Literal(m.start(2), m.end(2), m[2]))
    return literals, origins


def _value(text, tokens, i, m, names, literals, origins, literal) -> None:
    """What stands behind the operator ``i``: strings and names up to the end of the statement, or a bare value."""
    j, depth = i + 1, 0
    if j < len(tokens) and tokens[j][0] != "str":
        v = _VALUE.match(text, m.end())
        line_ends = v is not None and _LINE_END.match(text, v.end())
        close = v is not None and m["op"] == "=" and v.start(1) == m.end() and text[m.start() - 1 : m.start()].strip()
        if v and (line_ends or close) and (m["op"] != ":" or v.start(1) > m.end() or line_ends):
            for n in names:
                literals[n].append(Literal(v.start(1), v.end(1), v[1]))
    while j < len(tokens):
        kind, t = tokens[j]
        if kind == "end":
            before = tokens[j - 1][1]
            if not (depth or (tokens[j - 1][0] == "op" and before["op"] in ("+", "\\", "="))):
                return
        elif kind == "op":
            op = t["op"]
            if op in "([{":
                depth += 1
            elif op in ")]}":
                depth -= 1
                if depth < 0:
                    return
            elif op == ";" or (op == "," and depth == 0) or op in _SET:
                return  # what is nested behind a further operator has names of its own
        elif kind == "str":
            for n in names:
                literals[n].append(literal(t))
        elif kind == "name":
            follows = tokens[j + 1][1] if j + 1 < len(tokens) and tokens[j + 1][0] == "op" else None
            if follows is None or follows["op"] not in ("(", "=", ":=", "=>"):
                for n in names:
                    origins[n].add(t["name"])
        j += 1


def named_secrets(text: str) -> set[tuple[int, int]]:
    """Start and end of the literals whose name and looks reach the threshold."""
    if not _MAYBE.search(text):
        return set()
    literals, origins = pairs(text)
    best = {n: name_score(n) for n in {*literals, *origins}}
    work = [n for n, s in best.items() if s and n in origins]
    while work:
        n = work.pop()
        for source in origins[n]:
            if source in best and best[source] < best[n]:
                best[source] = best[n]
                if source in origins:
                    work.append(source)
    return {(x.start, x.end) for n, s in best.items() if s for x in literals.get(n, ()) if s + literal_score(x.text) >= THRESHOLD}


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of the fixed patterns, and of all spans, in order. Named literals inside a pattern's span
    add nothing to it and are left out."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    out: list[tuple[int, int, int]] = []
    reach, k = -1, 0  # the furthest end of the patterns that start no later
    for s, e in sorted(named_secrets(text)):
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][2])
            k += 1
        if reach < e:
            out.append((s, 3, e))
    return base, sorted(base + out)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULTS = {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType()}


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with ``n_assign, n_access, n_hex`` (spans of each pattern), ``base_sha256`` (digest of
    these spans) and ``spans``, all spans as ``kind:start:end`` in code points, joined by commas.

    A null text is empty; a text without a span has an empty list and its digest. Columns with the results'
    names are replaced. Repeated rows are scanned alike.
    """
    keep = [c for c in docs.columns if c != text and c not in RESULTS]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, t) for c, t in RESULTS.items())])
    own = max(docs.columns, key=len) + "_"  # longer than any column's name
    rows = docs.select(*keep, docs[text].alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            made: list[list] = [[] for _ in RESULTS]
            for t in batch.column(own):
                base, spans = scan(t.as_py())
                n = Counter(k for _, k, _ in base)
                for column, value in zip(made, (n[0], n[1], n[2], hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), *(pa.array(v, arrow.field(c).type) for c, v in zip(RESULTS, made, strict=True))], schema=arrow)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans."""
    return scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
