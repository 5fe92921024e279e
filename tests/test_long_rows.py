"""Long rows, large tables and hot keys: the steps that must stay in proportion to their input, against brute force."""

import random
import re
import time

from pyspark.sql import functions as F

from noteweave.functions import spans as SP
from noteweave.functions.arrays import firsts, lookup, outlasting, runs
from noteweave.operators import annotate, chunks, labels
from noteweave.sources import notes
from noteweave.sources.packs import GENERIC, ZH_CLINICAL


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def chunk(spark, text):
    return spark.createDataFrame([("c0", text)], "chunk_id string, text string")


def test_array_helpers(spark):
    rng = random.Random(1)
    data = [([(rng.choice("abcde"), i, rng.randint(0, 99)) for i in range(rng.randint(0, 8))], [rng.choice("abcdefg") if rng.random() < 0.9 else None for _ in range(rng.randint(0, 9))]) for _ in range(150)]
    df = spark.createDataFrame(data, "t array<struct<key:string,ord:int,value:int>>, k array<string>")
    key, value = lambda x: x["key"], lambda x: x["value"]
    out = df.select("t", "k", lookup(F.col("k"), F.transform("t", key), F.transform("t", value)).alias("l"), firsts(F.col("t"), key, lambda x: -x["ord"]).alias("f"), outlasting(F.col("t"), value).alias("o"), runs(F.sort_array("t"), key).alias("r"))
    for r in out.collect():
        first, last, kept, cut = {}, {}, [], {}
        for x in r.t:
            first.setdefault(x.key, x.value)
            last[x.key] = x
            cut.setdefault(x.key, []).append(x)
            if not kept or x.value > kept[-1].value:
                kept.append(x)
        assert r.l == [first.get(k) for k in r.k] and r.f == sorted(last.values(), key=lambda x: -x.ord)
        assert r.o == kept and [len(x) for x in r.r] == [len(cut[k]) for k in sorted(cut)]


def test_negation_of_a_line_of_a_megabyte(spark):
    unit = "not from here, but no rain; without " + "plain words of some sort " * 8
    text = unit * (1_000_000 // len(unit))
    begin = time.time()
    got = rows(annotate.negation_spans(chunk(spark, text), GENERIC), "start", "end", "text")
    assert time.time() - begin < 120 and len(got) >= len(text) // len(unit) and all(text[s:e] == t for s, e, t in got)


def test_negation_with_thousands_of_triggers_equals_one_unit(spark):
    unit = "无发热、咳嗽等，未见异常但考虑感染。"
    one = set(rows(annotate.negation_spans(chunk(spark, unit), ZH_CLINICAL), "start", "end", "text", "trigger"))
    many = set(rows(annotate.negation_spans(chunk(spark, unit * 2000), ZH_CLINICAL), "start", "end", "text", "trigger"))
    assert many == {(s + k * len(unit), e + k * len(unit), t, w) for s, e, t, w in one for k in range(2000)} and len(one) == 4


def test_a_hundred_thousand_spans_in_a_chunk(spark):
    text = "the that is with the nation. " * 20_000
    got = rows(annotate.entity_spans(chunk(spark, text), GENERIC).groupBy("node_type").agg(F.count("*").alias("n")), "node_type", "n")
    one = rows(annotate.entity_spans(chunk(spark, "the that is with the nation. "), GENERIC).groupBy("node_type").agg(F.count("*").alias("n")), "node_type", "n")
    assert dict(got) == {k: n * 20_000 for k, n in one} and sum(dict(got).values()) > 70_000
    assert rows(annotate.status_assertions(chunk(spark, text), GENERIC), "item_text", "value_text") == [("that", "is")]


def test_large_lexicon_of_a_hundred_thousand_terms(spark):
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(100_000)})
    texts = [" ".join(rng.choice(terms) if rng.random() < 0.2 else "".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(30)) for _ in range(50)]
    table = spark.createDataFrame([(t, "SIGN", "x") for t in terms], "term string, node_type string, source string")
    known, want = set(terms), []
    for i, text in enumerate(texts):
        for n in range(5, 10):
            busy: dict = {}
            for at in range(len(text) - n + 1):
                w = text[at : at + n]
                if w in known and busy.get(w, 0) <= at:
                    want.append((f"c{i}", at, w))
                    busy[w] = at + n
    got = annotate.large_lexicon_spans(spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string"), table)
    assert sorted(rows(got, "chunk_id", "start", "text")) == sorted(want)


def test_rule_table_of_fifty_thousand_rules(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50_000)]
    rules = [(f"s{i % 7}", i % 5, i, w if i % 3 else rf"{w}\s*[0-9]+") for i, w in enumerate(words)] + [("any", 9, 60_000, "[0-9]{4}"), ("low", 0, 60_001, "(?i)ZEBRA|yak"), ("esc", 8, 60_002, r"\x7a{3}")]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "7"]) for _ in range(3)) for _ in range(60)] + ["", "1234", "a Zebra", "yak", "zzz", "abc"]
    sentences = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "text_hash string, index int, text string")
    got = dict(rows(labels.label_by_rule_table(sentences, spark.createDataFrame(rules, "section_id string, priority int, rule_order int, regex string")), "index", "rule_label"))
    compiled = [(s, p, o, re.compile(r)) for s, p, o, r in rules]
    for i, t in enumerate(texts):
        hit = [(p, -o, s) for s, p, o, r in compiled if r.search(t)]
        assert got[i] == (max(hit)[2] if hit else None), t


def test_needed_literals_occur_in_every_match():
    cases = {"abc": "abc", "ab*cde": "cde", "a(bc)d+e": "a", "x|y": "", "(?i)abc": "", r"a\.bc[xyz]q": "a.bc", r"\d+foo": "foo", "foo{2}bar": "bar", "foo{": "", r"a\x41b": "", "[]a]bcd": "bcd", "(?:a|b)cd": "cd"}
    assert {p: labels.needed_literal(p) for p in cases} == cases


def test_nearest_left_on_a_hot_key(spark):
    rng = random.Random(11)
    spans = [("hot" if rng.random() < 0.7 else f"k{i % 5}", s, s + rng.choice([0, 0, 3, 30, 900]), i) for i, s in enumerate(rng.randrange(20_000) for _ in range(1500))]
    points = [("hot" if rng.random() < 0.7 else f"k{i % 6}", i, rng.randrange(-50, 21_000)) for i in range(1500)]
    s, p = spark.createDataFrame(spans, "k string, start int, end int, pos int"), spark.createDataFrame(points, "k string, id int, at int")
    want = []
    for k, i, at in points:
        fit = [x for x in spans if x[0] == k and x[1] <= at and at - x[2] <= 7]
        if fit:
            want.append((i, max(fit, key=lambda x: (x[1], x[3]))[3]))
    for width in (None, 1000):
        assert sorted(rows(SP.nearest_left(p, s, ["k"], "id", 7, "pos", width), "id", "near_pos")) == sorted(want)


def test_dedupe_keeps_texts_out_of_aggregates(spark):
    df = spark.createDataFrame([("b", "x" * 9), ("a", "x" * 9), ("a", "x" * 9), (None, "x" * 9), (None, "y")], "doc_id string, text string")
    out = notes.dedupe_cases(notes.read_cases_table(df))
    assert sorted(rows(out, "raw_text", "source_file", "copies")) == [("x" * 9, "a", 4), ("y", None, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("raw_text" not in line for line in plan.split("\n") if "Aggregate" in line)


def _first_spans(text, asked):
    """By plain searches, as the rule says."""
    out = []
    for proposal, bare, loose, even, loose_even in asked:
        at, size = text.find(proposal), len(proposal)
        if at < 0 and bare != proposal:
            at, size = text.find(bare), len(bare)
        if at < 0 and loose_even and loose_even != even and loose_even in " ".join(text.split()):
            at, size = text.find(loose), len(loose)
            if at >= 0 and text[at + size : at + size + 1] and text[at + size] in chunks.TRAILING:
                size += 1
        out.append({"start": at, "end": at + size} if at >= 0 else None)
    return out


def test_alignment_of_twenty_thousand_proposals_in_a_megabyte(spark, monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    small = " ".join(rng.choice(words) + rng.choice(["", ".", "; "]) for _ in range(400))
    asked = []
    for _ in range(300):
        at = rng.randrange(len(small))
        t = small[at : at + rng.randint(1, 60)] + rng.choice(["", ";", "!?", " ", "#"])
        bare, even = t.strip(), " ".join(t.split())
        asked.append([t, bare, bare.rstrip(chunks.TRAILING), even, even.rstrip(chunks.TRAILING)])
    want = _first_spans(small, asked)
    for limit in (chunks.INDEX_FROM, 0):  # plain searches, and the index
        monkeypatch.setattr(chunks, "INDEX_FROM", limit)
        assert chunks._align(small, " ".join(small.split()), asked) == want
    monkeypatch.undo()
    text = " ".join(rng.choice(words) for _ in range(160_000))
    starts = sorted(rng.sample(range(len(text) - 60), 20_000))
    section = spark.createDataFrame([("h", 1, "case", "prose", 0, text)], "text_hash string, section_index int, case_id string, section_id string, start_char int, text string")
    proposals = spark.createDataFrame([("h", 1, i, text[a : a + 50], "event", "s") for i, a in enumerate(starts)], "text_hash string, section_index int, chunk_index int, text string, chunk_type string, standalone_summary string")
    begin = time.time()
    good, bad = chunks.align_proposals(section, proposals)
    got = {r.chunk_index: (r.start, r.end) for r in good.collect()}
    assert time.time() - begin < 120 and len(text) > 900_000 and got == {i: (text.find(text[a : a + 50]), text.find(text[a : a + 50]) + 50) for i, a in enumerate(starts)}
