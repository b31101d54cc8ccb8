"""Nested JSON as flat tables."""

import json

from pyspark.sql import functions as F

from codesim.operators import nested
from codesim.operators.nested import nodes, report_tables, walk

SCHEMA = "evidence_id bigint, evidence_json string, pre int, doc string"


def test_walk_numbers_nodes_by_containment():
    found = walk('{"a": [1, {"b": null}], "c": "x"}')
    assert [f[4:7] for f in found] == [(None, 0, "object"), ("a", 0, "array"), ("a", 1, "number"), ("a", 2, "object"), ("b", 0, "null"), ("c", 0, "string")]
    by = {f[0]: f for f in found}
    for f in found:
        inside = [g[0] for g in found if g[0] > f[0] and g[1] < f[1]]
        children = [g[0] for g in found if g[3] == f[0]]
        assert set(children) <= set(inside)
        assert all(by[i][2] > f[2] for i in inside)


def test_walk_takes_anything():
    assert walk(None) == [] and walk("") == [] and walk("{") == [] and walk('"{"') == []
    assert walk("3")[0][6:] == ("number", "3")
    assert len(walk(json.dumps(json.dumps({"a": 1})))) == 2
    assert walk("[" * 100_000) == []
    assert len(walk("[" * 400 + "]" * 400)) == 400
    assert len(walk(json.dumps([1] * 50_000))) == 50_001


def lines(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    return sorted(tuple(r) for r in report_tables(df)["lines"].collect())


def test_layouts(spark):
    old = {"evidence": [None, {"line_highlights_a": [3, "4", None, 3], "line_highlights_b": []}], "scores": {"x": 1.5}}
    new = {"matches": {"lineHighlightsA": ["7"], "lineHighlightsB": None}}
    got = lines(spark, [json.dumps(old), json.dumps(json.dumps(new)), json.dumps({"report": new, "meta": {"lines": [1]}}), json.dumps({"result": {"data": old}}), "{bad", None, "[]", '{"matches": 3}', '{"matches": [[1]]}', '{"matches": []}'])
    assert got == [(0, 2, "a", 3), (0, 2, "a", 4), (1, 1, "a", 7), (2, 1, "a", 7), (3, 2, "a", 3), (3, 2, "a", 4)]


def test_other_tables_and_edges(spark):
    one = json.dumps({"scoreBreakdown": {"jaccard": 2.5, "pdg": None}, "matches": [{"lineHighlightsA": list(range(500))}]})
    df = spark.createDataFrame([(1, one, 1, "x"), (1, one, 2, "y"), (None, one, 1, "x"), (2, None, 1, "x")], SCHEMA)
    t = report_tables(df)
    assert sorted((r.evidence_id is None, r.name, r.score) for r in t["scores"].collect()) == [(False, "jaccard", 2.5), (True, "jaccard", 2.5)]
    assert t["lines"].where("evidence_id = 1").count() == 500
    assert t["blocks"].count() == 2 and t["reports"].count() == 2
    assert all(x.count() == 0 for x in report_tables(df.limit(0)).values())
    n = nodes(df.withColumn("value", F.lit(1)), "evidence_id", "evidence_json")
    assert n.where("kind = 'number'").count() == 3 * 501


def encoded(value, times):
    text = json.dumps(value)
    for _ in range(times):
        text = json.dumps(text)
    return text


def test_no_depth_is_too_deep(spark):
    one = {"matches": [{"lineHighlightsA": [1, 2]}]}
    for times in range(8):
        assert len(walk(encoded(one, times))) == 6
    assert len(walk('{"a": [' * 30_000 + "1" + "]}" * 30_000)) == 60_001
    deep = walk("[" * 60_000 + "]" * 60_000)
    assert len(deep) == 60_000 and deep[-1][2] == 59_999
    wrapped = one
    for name in ("report", "data", "result", "data", "report"):
        wrapped = {name: wrapped, "more": [name]}
    odd = {"matches": [{"lineHighlightsA": [5], "x": json.loads("[" * 400 + "]" * 400)}]}
    text = json.dumps(odd).replace("[" * 400 + "]" * 400, "[" * 60_000 + "]" * 60_000)
    assert lines(spark, [encoded(one, 7), json.dumps(wrapped), text, json.dumps({"report": [one], "x": {"data": one}})]) == [(0, 1, "a", 1), (0, 1, "a", 2), (1, 1, "a", 1), (1, 1, "a", 2), (2, 1, "a", 5)]


def test_own_parser_agrees():
    good = ['{"a": [1, -2.5e3, "x\\u00e9\\n", {}, [], [[]], {"b": {"c": null}}], "t": true , "f":false}', " 3 ", '""', "[NaN, -Infinity, 1E5, -0]", "[1,\n2\t]"]
    for t in good:
        assert repr(nested._loads_deep(t)) == repr(json.loads(t))
    for t in ["", "{", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "01", "tru", "[1]]", '"a', "{1:2}", "[,1]", "nul", '["\n"]', "]"]:
        for parse in (nested._loads_deep, json.loads):
            try:
                parse(t)
            except ValueError:
                continue
            raise AssertionError((parse, t))


def test_only_some_rows_have_the_same_numbers():
    text = json.dumps({"x": {"y": [1, {"matches": 2}]}, "report": {"matches": [{"z": 1}, 3]}})
    every = walk(text, frozenset({"report"}))
    some = walk(text, frozenset({"report"}), frozenset({"report", "matches"}))
    assert some == [r for r in every if r[2] == 0 or r[4] in ("report", "matches")]
    assert [r[4] for r in every if r[8]] == [None, "report"]
