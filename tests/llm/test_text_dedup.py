"""Near, substring and suffix-array dedup against brute force, and their edge cases."""

import hashlib
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteweave.llm import exchange, neardup, substring, suffix

SCHEMA = "doc_id bigint, text string, kept string, chunk int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["É", "日本", "straße"]
    docs = []
    for i in range(n):
        kind = rng.random()
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if docs and kind < 0.5:
            words = rng.choice(docs).split()
            for _ in range(rng.randint(0, 6)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
        if docs and kind > 0.8:
            other = rng.choice(docs).split()
            words = words[:30] + other[5:40] + words[30:]
        docs.append(rng.choice([" ", "  ", "\n"]).join(words))
    ids = list(range(1, n + 1))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


EDGE = [(1, "a b c"), (2, "A  b\tC"), (3, None), (4, ""), (5, " \n"), (None, "a b c"), (None, None), (6, "a b c d"), (7, "x " * 3000), (8, "x " * 3000), (9, "solo"), (9, "solo")]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_truth(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                label[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        group = [sets[b][0] for b in range(len(sets)) if find(b) == find(a)]
        least = None if i is None else min(group)
        out.append((i, len(s), least, True if i is None else i == least))
    return out


@pytest.mark.parametrize("rows", [corpus(1), corpus(2), EDGE], ids=["one", "two", "edge"])
def test_near_duplicates_equal_brute_force(spark, rows):
    got = [tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(near_truth(rows), key=repr)


def test_near_duplicates_of_large_nodes(spark):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(120):  # a group of near copies larger than a small node
        w = list(base)
        w[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(["the", "same", "passage", "of", "eight", "words", "in", "all"] + [f"d{i}-{k}" for k in range(20)])) for i in range(80)]
    got = [tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(near_truth(rows))


def test_near_duplicates_linked_to_one_member_of_a_large_node(spark):
    rng = random.Random(6)
    base = [f"t{k}" for k in range(200)]

    def edited(words, n, name):
        return [f"{name}-{k}" if k in at else w for at in [set(rng.sample(range(5, 195), n))] for k, w in enumerate(words)]

    # the smallest hash leads every large node: the leader has copies, but most members are similar to the base alone
    ids = [r.i for r in spark.range(300).selectExpr("id AS i").orderBy(F.xxhash64("i")).collect()]
    leader = edited(base, 4, "lead")
    texts = [leader, *[edited(leader, 1, f"copy{i}") for i in range(29)], *[edited(base, 4, f"own{i}") for i in range(90)], base, *[edited(base, 4, f"own{i}") for i in range(90, 150)]]
    texts += [[f"s{k}" for k in range(140)] + [f"d{i}-{k}" for k in range(30)] for i in range(80)]  # one template, unlike otherwise
    rows = [(i, " ".join(w)) for i, w in zip(ids, texts, strict=False)]
    got = [tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(near_truth(rows))


def removed_words(rows, n=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k : k + n])] < i:
                    gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("rows", [corpus(3), EDGE], ids=["random", "edge"])
def test_substring_dedup_equals_brute_force(spark, rows):
    got = [tuple(r) for r in substring.remove_repeats(frame(spark, rows), digest=True).collect()]
    assert sorted(got, key=repr) == sorted(removed_words(rows), key=repr)
    whole = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted(hashlib.sha256(r.kept_text.encode()).hexdigest() for r in whole) == sorted(x[3] for x in removed_words(rows))
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in whole)


def removed_bytes(rows, n=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        if i is not None:
            for k in range(len(b) - n + 1):
                first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, dtype=bool)
        if i is not None:
            for k in range(len(b) - n + 1):
                if first[b[k : k + n]] < i:
                    gone[k + 1 : k + 1 + n] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(x for k, x in enumerate(b) if not gone[k + 1])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("rows", [corpus(4), EDGE + [(20, "é" * 60), (21, "é" * 60 + "!"), (22, "a" * 200), (23, "a" * 49)]], ids=["random", "edge"])
def test_suffix_dedup_equals_brute_force(spark, rows):
    got = [tuple(r) for r in suffix.remove_repeats(frame(spark, rows), digest=True).collect()]
    assert sorted(got, key=repr) == sorted(removed_bytes(rows), key=repr)
    whole = suffix.remove_repeats(frame(spark, rows)).collect()
    assert sorted(hashlib.sha256(r.kept).hexdigest() for r in whole) == sorted(x[4] for x in removed_bytes(rows))


@pytest.mark.parametrize("operator", [neardup.near_duplicates, substring.remove_repeats, suffix.remove_repeats])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).collect() == []


def test_suffix_array_and_prefixes(monkeypatch):
    rng = random.Random(1)
    for dense in (0, 64, 10**9):  # symbol by symbol, as it comes, suffix by suffix
        monkeypatch.setattr(suffix, "DENSE", dense)
        for _ in range(200):
            part = [rng.randint(1, rng.choice([1, 2, 4, 20, 90_000])) for _ in range(rng.randint(0, 80))]
            t = [*(part * rng.choice([1, 1, 3])), 0]
            a = np.array(t, dtype=np.uint16 if max(t) < 2**16 else np.int64)
            sa = suffix.suffix_array(a)
            assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            shared = suffix.permuted_prefixes(a, sa)
            for x, y in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
                assert shared[y] == next(k for k in range(len(t)) if t[x + k] != t[y + k])


def test_suffix_array_of_long_runs():
    t = np.array([1] * 300_000 + [2] + [1] * 300_000 + [3, 1, 2] * 50_000 + [0], dtype=np.uint16)
    sa = suffix.suffix_array(t)
    shared = suffix.permuted_prefixes(t, sa)
    text = t.astype(np.uint8).tobytes()
    for k in range(1, len(t), 9973):
        x, y = int(sa[k - 1]), int(sa[k])
        assert text[x : x + int(shared[y])] == text[y : y + int(shared[y])] and t[x + shared[y]] < t[y + shared[y]]


def test_suffix_array_of_many_symbols_takes_no_step_for_each_suffix():
    rng = np.random.default_rng(5)
    part = rng.permutation(7_000) + 1
    for t in (np.concatenate((np.tile(part, 3), rng.integers(1, 7_001, 9_000), [0])), np.concatenate((np.full(5_000, 90_000), part, np.full(5_000, 90_000), [0]))):
        steps = 0

        def count(frame, event, arg):
            nonlocal steps
            steps += event == "line"
            return count

        before = sys.gettrace()
        sys.settrace(count)
        try:
            sa = suffix.suffix_array(t)
        finally:
            sys.settrace(before)
        assert steps < len(t) // 10
        rank = np.empty(len(t), dtype=np.int64)
        rank[sa] = np.arange(len(t))
        assert sorted(sa.tolist()) == list(range(len(t))) and sa[0] == len(t) - 1
        own = list(zip(t[sa[1:]].tolist(), rank[sa[1:] + 1].tolist(), strict=True))  # first symbol, place of the rest
        assert own == sorted(own)


def test_suffix_dedup_with_hot_anchors_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(exchange, "LEAST_BYTES", 300)
    rng = random.Random(21)
    rows = corpus(6) + [(1000 + i, "".join(rng.choice("ab ") for _ in range(30)) + "All rights reserved by the owners of this page" + "".join(rng.choice("xy ") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(2000, "q" * 3000), (2001, "q" * 2500 + "!" + "q" * 100)]
    got = [tuple(r) for r in suffix.remove_repeats(frame(spark, rows), digest=True).collect()]
    assert sorted(got) == sorted(removed_bytes(rows))
    got = [tuple(r) for r in substring.remove_repeats(frame(spark, rows), digest=True).collect()]
    assert sorted(got) == sorted(removed_words(rows))
