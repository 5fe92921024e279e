"""Spelling variants against brute force on small cases."""

import random
import zlib
from collections import Counter

from noteweave.llm import variants


def _brute(counts):
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= variants.RATIO * n else None
        out[w] = [n, len(others), form, counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w] = (*row, root)
    return out


def _rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    for alphabet, sizes in (("ab", (1, 7)), ("abcéÿ", (2, 6)), ("xyz×", (6, 9))):
        counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))): rng.choice([1, 2, 7, 50, 300]) for _ in range(300)}
        got = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3))
        assert _rows(got) == _brute(counts)


def test_chains_ties_and_very_long_words(spark):
    long = "q" * 60_000 + "x"
    counts = {"abcdef": 1, "abcdeg": 5, "abcdgg": 25, "abcggg": 125, "abgggg": 625, "aggggg": 3125, "mmmmmm": 1, "mmmmmn": 9, "mmmmma": 9, long: 40, long + "x": 5, long[1:]: 8, long[:-1] + "y": 200}
    got = _rows(variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert got == _brute(counts)
    assert got["abcdef"][4] == "aggggg" and got["mmmmmm"][2] == "mmmmma"


def test_words_of_documents(spark):
    rng = random.Random(5)
    bits = ["Wonder", "wonder", "wander", "Éclairs", "éclairs", "x", "abc", "÷÷÷÷÷÷", "日本語日本語", "wonders", "naïveté's"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(60))) for i in range(200)] + [(7, None), (None, "wonder wonder"), (8, "")]
    rows += rows[:3]
    want = Counter()
    for i, t in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                want[w] += 1
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "'z' AS word", "1 AS n", "2 AS _h", "3 AS _id")
    got = {r.word: r.n for r in variants.vocabulary(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5} and any(w not in ("wonder", "wander") for w in got)
    assert variants.group_variants(variants.vocabulary(df.filter("false"))).collect() == []
