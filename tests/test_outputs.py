"""The whole job: notes to documents and graphs, twice."""

import json

from noteweave.jobs import outputs
from noteweave.jobs import standins as X
from noteweave.sources.clinical import CLINICAL_EDGES
from noteweave.sources.packs import GENERIC


def test_two_runs_equal_one(spark, tmp_path):
    docs = [(1, "The plation that was for the nation. It was on the table with the others.\nMIT License for the rest of that."), (2, "the | that | was for the donation with the one"), (3, None), (4, "  "), (5, "the | that | was for the donation with the one")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    run = lambda d, batch: outputs.run_notes(d, GENERIC, CLINICAL_EDGES, X.rule_proposals, X.proposed_rows, X.rule_verdicts, str(tmp_path / "out"), batch)

    def read(paths):
        return {name: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in spark.read.json(p).collect()) for name, p in paths.items()}

    one = read(run(df, "a"))
    assert len(one["cases"]) == 2 and len(one["rejected"]) == 2 and one["graphs"]
    case = json.loads(one["cases"][0])
    assert [c["chunk_index"] for c in case["chunks"] if c["section_index"] == 1] == list(range(1, 1 + sum(c["section_index"] == 1 for c in case["chunks"]))) and case["sentences"][0]["index"] == 1
    graph = json.loads(one["graphs"][0])
    ids = {n["node_id"] for n in graph["nodes"]}
    assert all(e["source_node_id"] in ids and e["target_node_id"] in ids for g in map(json.loads, one["graphs"]) for e in g["edges"] or [] if g["section_index"] == graph["section_index"] and g["case_id"] == graph["case_id"])
    assert read(run(df, "a")) == one
    both = read(run(df.filter("doc_id = 2"), "b"))
    assert [r for r in both["cases"] if json.loads(r)["batch"] == "a"] == one["cases"] and len(both["cases"]) == 3
    changed = read(run(df.filter("doc_id = 1"), "b"))
    assert [json.loads(r)["source_file"] for r in changed["cases"] if json.loads(r)["batch"] == "b"] == ["1"] and [r for r in changed["cases"] if json.loads(r)["batch"] == "a"] == one["cases"]
