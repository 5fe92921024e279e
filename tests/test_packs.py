"""Rule packs from files."""

import json

import pytest

from noteweave.sources import pack_tables as PT
from noteweave.sources.clinical import NODE_TYPES
from noteweave.sources.packs import GENERIC, ZH_CLINICAL

FIELDS = ("kind", "name", "priority", "rule_order", "value", "extra")


@pytest.mark.parametrize("pack", [GENERIC, ZH_CLINICAL])
def test_packs_load_from_files(spark, tmp_path, pack):
    path = tmp_path / "rules.json"
    path.write_text("\n".join(json.dumps(dict(zip(FIELDS, r, strict=True)), ensure_ascii=False) for r in reversed(PT.pack_rows(pack))), encoding="utf-8")
    good, bad = PT.check_rules(PT.read_rules(spark, str(path)), NODE_TYPES)
    assert bad.count() == 0
    got = PT.load_pack(good)
    a, b = ({n: dict(v) for n, v in p.composites.items()} for p in (got, pack))
    assert a == b and all(getattr(got, f) == getattr(pack, f) for f in ("name", "terminators", "cues", "lexicon", "suffixes", "leading", "sites", "status", "inner_tokens", "inherit", "flags", "subject"))
    by_section = lambda p: [(s, n, sorted(rs)) for s, n, rs in p.sections]  # a section's expressions have no order
    assert by_section(got) == by_section(pack)
    assert {k: v for k, v in got.negation.items()} == {k: v for k, v in pack.negation.items()}


def test_bad_rules_are_rejected(spark):
    rows = [("section", "a", 5, 0, "x(", None), ("section", "a", 5, 0, "x", None), ("section", "b", 5, 1, "y", None), ("lexicon", "NOTYPE", 0, 0, "t", "s"), ("lexicon", "SIGN", 0, 1, "(", "s"), ("what", None, 0, 0, "v", None), (None, None, 0, 0, "v", None),
            ("negation", "nolist", 0, 0, "no", None), ("cue", "k", 0, 0, None, None), ("setting", "nothing", 0, 0, "1", None), ("setting", "name", 0, 0, "p", None), ("setting", "terminators", 0, 0, ".", None)]
    good, bad = PT.check_rules(spark.createDataFrame(rows, PT.SCHEMA), NODE_TYPES, ["a", "b"])
    assert sorted(r.reason for r in bad.collect()) == sorted(["expression doesn't compile", "unknown node type", "unknown kind", "unknown kind", "unknown list", "no value", "unknown setting"])
    assert [list(r.sections) for r in PT.ties(good).collect()] == [["a", "b"]] and PT.load_pack(good).lexicon == (("(", "SIGN", "s"),)
    with pytest.raises(ValueError):
        PT.load_pack(good.unionByName(spark.createDataFrame([("site", None, 0, 0, "x" * (PT.MOST_CHARACTERS + 1), None)], PT.SCHEMA)))
