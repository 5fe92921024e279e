"""Every query of the core library against its oracle on the smallest tables."""

import functools

import duckdb
import pytest

from noteweave.jobs import queries
from noteweave.jobs.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Steps that many queries share, worked out once for the module.
SHARED = ("_cases", "_settled_chunks", "_analysis", "_overridden", "_graph", "_sections")


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    own = {name: getattr(queries, name) for name in SHARED}
    for name, f in own.items():
        setattr(queries, name, functools.cache(f))
    yield
    for name, f in own.items():
        setattr(queries, name, f)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want) and len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitions(spark):
    from noteweave.jobs import graphs as G
    from noteweave.jobs import standins as X
    from noteweave.operators.annotate import entity_spans
    from noteweave.sources.clinical import CLINICAL_EDGES
    from noteweave.sources.packs import GENERIC

    cases = spark.createDataFrame([("case_a", "with the plation that was for x\nthe that was\nfor that\n\nthe for"), ("case_b", "the that | was for the nation")], "case_id string, raw_text string")
    lines = G.line_chunks(cases)
    seen = []
    for n in (1, 5):
        graph = G.checked_graph(lines.repartition(n), GENERIC, CLINICAL_EDGES, G.from_tables(X.proposed_graph) if n == 1 else X.proposed_rows, X.rule_verdicts)
        out = G.section_graphs(lines.repartition(n), graph) if n == 1 else G.merged_sections(graph["rows"])
        seen.append([sorted(map(repr, out[k].collect())) for k in ("nodes", "edges", "frames")])
        for r in out["nodes"].filter("NOT implicit").collect():
            assert any(r.source_text in t for t in ("with the plation that was for x the that was for that the for the that | was for the nation",))
    assert seen[0] == seen[1] and seen[0][0] and entity_spans(lines, GENERIC).count()
