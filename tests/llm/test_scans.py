"""Cross-tokenizer alignment and secret scans against brute force."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from noteweave.llm import crosstok, secretscan

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _spells(own, ids, table):
    return b"".join(table[i] for i in ids)


def _groups(own, text):
    """Groups by walking over both tokenizations of the whole text."""
    if not text:
        return []
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    raw = b" " + text.encode()
    if _spells(own, a, own.a_bytes) != raw or _spells(own, b, own.b_bytes) != raw:
        return []
    out, x, y, at_a, at_b = [], [], [], 0, 0
    i = j = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += len(own.a_bytes[a[i]])
            x.append(a[i])
            i += 1
        else:
            at_b += len(own.b_bytes[b[j]])
            y.append(b[j])
            j += 1
        if at_a == at_b:
            out.append((x, y))
            x, y = [], []
    return out


def _want(own, rows):
    groups = [_groups(own, t) for _, t in rows]
    links = [[(p, q) for x, y in g for p in x for q in y] for g in groups]
    held = Counter(p for ls in links for p in set(ls))
    top = Counter()
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for (i, _), g, ls in zip(rows, groups, links, strict=True):
        s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(ls), sum(held[p] == top[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(s.encode()).hexdigest() if g else ""))
    return sorted(map(repr, out))


ODD = ["", None, "  x  y ", "a▁b c d", " a b", "x\x00y z", "日本 語 と", "aaaa" * 500, "<|endoftext|> <s> </s> <unk> <0x41>", "é f", "ﬁ x ﬁ", "a\tb c\n d", "🙂🙂 🙂a", "=-=-" * 300, "\x85 x", "a b c", "same text", "same text", "x" * 120_000 + " y", "▁", " "]


@pytest.mark.parametrize("block", [crosstok.BLOCK_BYTES, 300])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(crosstok, "BLOCK_BYTES", block)
    own = crosstok.Aligner(open(A, "rb").read(), open(B, "rb").read())
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table] + [(None if t == "" else 10_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS block", "'r' AS rows", "2 AS n_a", "'p' AS pairs", "3 AS at").repartition(3)
    out = crosstok.align_documents(df, A, B)
    assert set(out.columns) == {"doc_id", "block", "rows", "pairs", "at", *crosstok.RESULTS}
    got = sorted(repr(tuple(r)) for r in out.select("doc_id", *crosstok.RESULTS).collect())
    assert got == _want(own, rows)
    assert crosstok.align_documents(df.filter("false"), A, B).collect() == []


def test_products_in_small_steps_and_a_bounded_cache(monkeypatch):
    files = open(A, "rb").read(), open(B, "rb").read()
    own, small = crosstok.Aligner(*files), crosstok.Aligner(*files)
    texts = ["=-=-" * 200, "日本語" * 50, "the cat the cat", "zq" * 40]
    at, n = own.texts(texts)
    want = [x.tolist() for x in own.links(at, n)]
    monkeypatch.setattr(crosstok, "LINKS", 7)
    monkeypatch.setattr(crosstok, "CACHE", 2)
    at, n = small.texts(texts)
    assert [x.tolist() for x in small.links(at, n)] == want
    small.texts(["one two three four"])
    assert len(small.known) == 4  # the cache began anew


def test_a_block_is_aligned_part_by_part(monkeypatch):
    """What a worker holds at once are a part's pieces, however large the block, and the cache is bounded inside it."""
    own, small = (crosstok.Aligner(open(A, "rb").read(), open(B, "rb").read()) for _ in range(2))
    texts = [f"word{i} the cat {i % 7} sat" for i in range(60)] + ODD
    want = own.aligned(texts)
    monkeypatch.setattr(crosstok, "PART_BYTES", 100)
    monkeypatch.setattr(crosstok, "PIECES", 3)
    monkeypatch.setattr(crosstok, "CACHE", 20)
    seen, links = [], small.links
    monkeypatch.setattr(small, "links", lambda at, n: seen.append((len(n), len(small.known))) or links(at, n))
    got = small.aligned(texts)
    assert got[1] == want[1] and all((x == y).all() for x, y in zip((got[0], *got[2:]), (want[0], *want[2:]), strict=True))
    assert len(seen) > 10 and max(n for n, _ in seen) < 30 and max(k for _, k in seen) < 100


def test_token_groups(spark):
    own = crosstok.Aligner(open(A, "rb").read(), open(B, "rb").read())
    rows = [(i, t) for i, t in enumerate(ODD[:12])]
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in crosstok.token_groups(spark.createDataFrame(rows, "doc_id int, text string"), A, B).collect()}
    assert got == {i: _groups(own, t) for i, t in rows}


# ---------------------------------------------------------------- secrets


def _found(text):
    return [(secretscan.KINDS[k], text[s:e]) for s, k, e in secretscan.scan(text)[1]]


NAMED = {
    "pwd='tr0ub4dor&3'": ["tr0ub4dor&3"],
    'DEFAULT = "s3cr3tValue99"\nuser = "bobby1234"\nclientPassphrase = DEFAULT\n': ["s3cr3tValue99"],
    '{"auth": {"privateKey": "MIIabc0123456789xyz", "user": "bobby12345"}}': ["MIIabc0123456789xyz"],
    "export DB_PASS=abc123def\n": ["abc123def"],
    "db:\n  pass: abc123def   # of the test\n": ["abc123def"],
    "<passphrase>correcthorse1</passphrase>": ["correcthorse1"],
    '<add key="AccountKey" value="abcDEF123456=="/>': ["abcDEF123456=="],
    "run --pass s3cr3tpw --name bob123456": ["s3cr3tpw"],
    'conf["signing_key"] = base64.b64decode("QUJDREVGR0hJSktM123")': ["QUJDREVGR0hJSktM123"],
    'setenv("DB_PASSWD_", "pa55word!")': ["pa55word!"],
    'secret_key: str = "aaabbbccc111222"': ["aaabbbccc111222"],
    'a = b\nb = c\nc = "zzz999yyy888"\nx_token = a\na = x_token': ["zzz999yyy888"],
    "private_key = (" + '"ab12cd",\n' * 300 + ")": ["ab12cd"] * 300,
    'char secret_word[] = "xyzzy42plugh";': ["xyzzy42plugh"],
    'token_count = "1234567890abc"': [],
    'auth = "${VAULT_AUTH}"\npass = "changeme1"\npwd = "<your-password>"': [],
    "It's a token of love, don't you think: author's key=none": [],
    'url = "https://host/abc123"\npassword_url = url': [],
    "pwd = pwd": [],
}


def test_named_literals():
    for text, want in NAMED.items():
        assert [x for k, x in _found(text) if k == "literal"] == want, text


def test_propagation_equals_a_closure():
    import random

    rng = random.Random(9)
    names = ["alpha", "beta", "gamma", "delta", "omega", "db_pass", "auth"]
    for _ in range(200):
        lines = [f"{rng.choice(names)} = {rng.choice(names)}" if rng.random() < 0.6 else f'{rng.choice(names)} = "v{rng.randint(100000, 999999)}abcdefghij"' for _ in range(8)]
        text = "\n".join(lines)
        given = [re.fullmatch(r'(\w+) = ("?)(\w+)"?', x).groups() for x in lines]
        reach = {n: {n} for n in names}  # the names that a name's value may end up in
        for _ in names:
            for target, quoted, source in given:
                if not quoted:
                    reach[source] |= reach[target]
        assigned = {t for t, _, _ in given}
        want = [v for t, quoted, v in given if quoted and any(secretscan.name_score(n) and (n in assigned) for n in reach[t])]
        assert sorted(x for k, x in _found(text) if k == "literal") == sorted(want), text


def _base(text):
    out = []
    for order, (kind, pattern, least, group) in enumerate((("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0))):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x for _, _, x in sorted(out)]


BASE = ["password=abc", "Password : 'abcdef\"", "TOKEN=" + "a" * 30, "api_key=secret=token=abcdef", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "tokeſ=abcdef", "toKen=abcdef", "é" * 5 + "0123456789abcdef01234567", "secret\t=abcdef", "passwdpassword=xx password=token", None, "", "f" * 100_000]


def test_patterns_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()] + [(None, t) for t in BASE] + [(7, t) for t in NAMED]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS spans", "1 AS _scanned", "2 AS start")
    out = secretscan.scan_secrets(df).select("doc_id", *secretscan.RESULTS).collect()
    want = []
    for i, t in rows:
        base = _base(t)
        n = Counter(x.split(":")[0] for x in base)
        every = base + [f"literal:{s}:{e}" for s, k, e in secretscan.scan(t)[1] if k == 3]
        every.sort(key=lambda x: (int(x.split(":")[1]), secretscan.KINDS.index(x.split(":")[0])))
        want.append(repr((i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(every))))
    assert sorted(repr(tuple(r)) for r in out) == sorted(want)
    assert secretscan.scan_secrets(df.filter("false")).collect() == []


def test_long_and_unclosed_texts_are_linear():
    for text in ('password="' * 20_000, '"""' * 50_001, "(a: " * 50_000, "a=" * 100_000, 'k="' + "\\" * 100_001, "<pass>" * 30_000, "--pass " * 30_000, "name='x' " * 30_000, "'" * 100_001, "a" + "[]" * 50_000 + " = 'x'"):
        secretscan.scan(text)
