"""Requests to models and what becomes of their answers: for each call the rows that ask, the schema of an answer, and
what stands in where a call fails or its answer is not allowed.

A model is a batch function for ``apply_model``; templates are data with slots in braces. Answers made elsewhere can be
joined instead: they have the request's key, ``status`` and the schema's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.tables import settled
from noteweave.functions.text import slices, strip
from noteweave.operators.chunks import KEY, SHORT, build_chunks
from noteweave.operators.labels import ingest_labels, inherit_labels, label_by_rules, overlay_labels
from noteweave.operators.model import apply_model, apply_model_within, render
from noteweave.operators.overrides import EDGE, NODE, K
from noteweave.sources.packs import Pack

Model = Callable[[list[str]], list[dict]]
#: Characters of a reason that a reviewer sees.
REASON = 120


# The schemas of answers.
LABEL = "section_id string, reasoning string"
REVIEW = "items array<struct<index:int,section_id:string,reasoning:string>>"
CHUNKS = "chunks array<struct<text:string,chunk_type:string,standalone_summary:string>>"
ANALYSIS = "entities array<struct<text:string,description:string,negated:boolean,certainty:string>>, relations array<struct<subject_text:string,object_text:string,relation:string,evidence_text:string,negated:boolean,certainty:string>>"
GRAPH = "nodes array<struct<node_id:string,node_type:string,source_text:string,negated:boolean,certainty:string>>, edges array<struct<edge_id:string,edge_type:string,source_node_id:string,target_node_id:string,negated:boolean,certainty:string,context:string,source_text:string,reasoning:string,confidence:double>>"
VERDICT = "verdict string, verdict_reason string"
COREFERENCE = "are_coreferent boolean, reason string"


def _ok(answers: DataFrame) -> DataFrame:
    return answers.filter("status = 'ok'")


# ---------------------------------------------------------------- sentences


def label_sentences(sentences: DataFrame, cases: DataFrame, pack: Pack, domain: DataFrame, fn: Model, template: str, around: int | None = None, **calls) -> DataFrame:
    """``text_hash, index, section_id, by``: the model's label where it gives one of the domain's, else the rules'.
    The request has ``{start}``, ``{end}``, ``{sentence}`` and ``{context}``: the whole note, or ``around`` characters of it on either
    side. A note meets its sentences once, in one row, and is cut there by blocks. ``calls`` go to ``apply_model``.

    With the whole note and no ``store`` the requests are written out where they are asked (``apply_model_within``), for all of them together are
    as many times as long as the notes as these have sentences."""
    own = sentences.groupBy("text_hash").agg(F.collect_list(F.struct("index", "start_char", "end_char", "text")).alias("_s")).join(cases.select("text_hash", "raw_text"), "text_hash")
    if around is None and not calls.keys() & {"store", "waves"}:
        slots = {"start": "start_char", "end": "end_char", "sentence": "text"}
        said, _ = ingest_labels(_ok(apply_model_within(own, "raw_text", "_s", "index", slots, template, fn, LABEL, **calls)), domain)
    else:
        if around is None:
            each = own.select("text_hash", "raw_text", F.explode("_s").alias("s")).withColumn("_around", F.col("raw_text"))
        else:
            windows = F.transform("_s", lambda s: F.struct(F.greatest(s["start_char"] - around, F.lit(0)).alias("start"), (s["end_char"] + around).alias("end")))
            each = own.select("text_hash", F.explode(F.zip_with("_s", slices(F.col("raw_text"), windows), lambda s, t: F.struct(s.alias("s"), t.alias("t")))).alias("x")).select("text_hash", "x.s", F.col("x.t").alias("_around"))
        asked = each.select("text_hash", "s.index", render(template, start=F.col("s.start_char"), end=F.col("s.end_char"), sentence=F.col("s.text"), context=F.col("_around")).alias("request"))
        said, _ = ingest_labels(_ok(apply_model(asked, "request", fn, LABEL, **calls)), domain)
    ruled = inherit_labels(label_by_rules(sentences, pack), pack).select("text_hash", "index", F.col("section_id").alias("_rule"))
    both = ruled.join(said.select("text_hash", "index", "section_id"), ["text_hash", "index"], "left")
    return both.select("text_hash", "index", F.coalesce("section_id", "_rule").alias("section_id"), F.when(F.col("section_id").isNotNull(), "model").otherwise("rule").alias("by"))


def review_labels(labels: DataFrame, sentences: DataFrame, fn: Model, template: str) -> DataFrame:
    """Initial labels (``text_hash, index, section_id, reasoning``) of whole notes reviewed: as ``overlay_labels`` gives
    them. The request has ``{labels}``, a line for each sentence. Where a call fails, the initial labels stay."""
    own = labels.join(sentences.select("text_hash", "index", "start_char", "end_char", "text"), ["text_hash", "index"])
    line = F.concat(F.lit("- S"), F.col("index"), F.lit(" ["), F.col("start_char"), F.lit(":"), F.col("end_char"), F.lit("] label=`"), F.col("section_id"), F.lit("`  text="), F.col("text"),
                    F.lit("  reason="), F.substring(F.replace(F.coalesce("reasoning", F.lit("")), F.lit("\n"), F.lit(" ")), 1, REASON))
    notes = own.groupBy("text_hash").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    answers = _ok(apply_model(notes.select("text_hash", render(template, labels=F.col("_lines")).alias("request")), "request", fn, REVIEW))
    reviews = answers.select("text_hash", F.posexplode("items").alias("pos", "i")).select("text_hash", "i.index", "i.section_id", "i.reasoning", "pos")
    return overlay_labels(labels, reviews, ("text_hash", "index"))


# ---------------------------------------------------------------- chunks


def split_sections(sections: DataFrame, fn: Model, template: str, chunk_type: str = "clinical_state") -> DataFrame:
    """All chunks of the sections, from a model's proposals; short sections aren't asked about, and those whose call
    fails stay whole. The request has ``{section}`` and ``{text}``."""
    long = sections.filter(F.length(strip(F.col("text"))) >= SHORT)
    answers = settled(apply_model(long.select(*KEY, render(template, section=F.col("section_id"), text=F.col("text")).alias("request")), "request", fn, CHUNKS), "answers")
    proposals = _ok(answers).select(*KEY, F.posexplode("chunks").alias("chunk_index", "c")).select(*KEY, "chunk_index", "c.*")
    return build_chunks(sections, proposals, answers.filter("status <> 'ok'").select(*KEY), chunk_type)


# ---------------------------------------------------------------- graphs


def _warned(answers: DataFrame, message: str) -> DataFrame:
    return answers.filter("status <> 'ok'").select(K, F.lit("MODEL").alias("code"), F.lit(message).alias("message"))


# The warnings of a failed analysis and of a failed mapping.
NO_ANALYSIS = "C-3a 语义分析 LLM 调用失败"
NO_GRAPH = "C-3b 本体映射 LLM 调用失败"


def analyse_chunks(annotated: DataFrame, fn: Model, template: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and warnings from annotated chunks (``chunk_id, annotated``); a failed call gives a warning
    and no rows. The request has ``{chunk}``."""
    answers = settled(apply_model(annotated.select(K, render(template, chunk=F.col("annotated")).alias("request")), "request", fn, ANALYSIS), "analysis")
    rows = lambda c: _ok(answers).select(K, F.posexplode(c).alias("pos", "x")).select(K, "pos", "x.*")
    return rows("entities"), rows("relations"), _warned(answers, NO_ANALYSIS)


def map_graph(annotated: DataFrame, entities: DataFrame, relations: DataFrame, fn: Model, template: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings from analysed chunks, those with entities. The request has ``{chunk}``, ``{entities}``
    and ``{relations}``, a line for each."""
    def lines(df: DataFrame, line: Column, name: str) -> DataFrame:
        return df.groupBy(K).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias(name))

    known = annotated.join(lines(entities, F.concat(F.lit("- "), F.col("text"), F.lit(": "), F.col("description")), "_e"), K)
    known = known.join(lines(relations, F.concat(F.lit("- "), F.col("subject_text"), F.lit(" > "), F.col("object_text"), F.lit(": "), F.col("relation")), "_r"), K, "left")
    request = render(template, entities=F.col("_e"), relations=F.col("_r"), chunk=F.col("annotated"))
    answers = settled(apply_model(known.select(K, request.alias("request")), "request", fn, GRAPH), "graph")
    rows = lambda c, pos: _ok(answers).select(K, F.posexplode(c).alias(pos, "x")).select(K, (F.col(pos) + 1).alias(pos), "x.*")
    return rows("nodes", "node_pos").withColumn("implicit", F.lit(False)).select(NODE), rows("edges", "edge_pos").select(EDGE), _warned(answers, NO_GRAPH)


def edge_requests(edges: DataFrame, chunks: DataFrame, template: str) -> DataFrame:
    """A request for each edge to review, with ``{chunk}``, ``{edge}``, ``{evidence}`` and ``{confidence}``. An edge without
    an answer has low confidence (``apply_verdicts``)."""
    joined = edges.join(chunks.select(K, F.col("text").alias("_t")), K)
    return joined.select(K, "edge_id", render(template, chunk=F.col("_t"), edge=F.col("edge_type"), evidence=F.col("source_text"), confidence=F.col("confidence")).alias("request"))


def coreference_verdicts(pairs: DataFrame, fn: Model, template: str) -> DataFrame:
    """The pairs with ``are_coreferent`` (false where the call fails) and ``reason``. The request has ``{short}`` and
    ``{long}``; equal pairs of several sections are asked once."""
    asked = pairs.withColumn("request", render(template, short=F.col("short_text"), long=F.col("long_text")))
    out = apply_model(asked, "request", fn, COREFERENCE)
    return out.select(*pairs.columns, F.coalesce("are_coreferent", F.lit(False)).alias("are_coreferent"), F.coalesce("reason", F.concat(F.lit("error: "), F.col("error"))).alias("reason"))
