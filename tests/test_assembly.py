"""Evidence of whole pairs and the full comparison."""

import random
import re

from codesim import engine
from codesim.operators import assembly as Y
from tests.test_flags import method


def texts():
    rng = random.Random(5)
    shared = [method(rng, f"m{i}") for i in range(3)]
    own = [method(rng, f"own{i}", "    while (a0 < b0) { emit(a0); }\n") for i in range(2)]
    one = "class A {\n" + shared[0] + own[0] + shared[1] + shared[2] + "}\n"
    two = "class B {\n" + shared[1] + own[1] + shared[0] + "}\n"
    return one, two, re.sub(r"\b(emit|push|send|a0|b0|m\d)\b", r"\1x", one)


def test_full_comparison(spark):
    one, two, renamed = texts()
    r = engine.compare(spark, [("A.java", one)], [("B.java", two)])
    assert r["status"] == "completed" and r["languages"] == {"a": "java", "b": "java"} and 0 < r["weighted_final"] < 1
    la, lb = one.split("\n"), two.split("\n")
    assert r["evidence"]
    taken = (set(), set())
    for e in r["evidence"]:
        assert e["file_a"] == "A.java" and e["file_b"] == "B.java" and e["match_strength"] in ("high", "medium", "low")
        assert e["code_a"].split("\n")[0].strip() in {x.strip() for x in la} and e["code_b"].split("\n")[-1].strip() in {x.strip() for x in lb}
        for side, used in zip("ab", taken):
            lines = set(e[f"line_highlights_{side}"])
            assert lines <= set(range(e[f"{side}1"], e[f"{side}2"] + 1)) and not lines & used
            used |= lines
    assert {e["evidence_source"] for e in r["evidence"]} <= {"ast", "kgram12", "kgram8", "identical"}
    same = engine.compare(spark, [("A.java", one)], [("A.java", one)])
    assert same["weighted_final"] == 1.0 and [e["evidence_source"] for e in same["evidence"]] == ["identical"] and same["flags"] == []
    other = engine.compare(spark, [("A.java", one)], [("A.java", renamed)])
    assert "identifier_renaming" in other["flags"] and other["final"] >= 0.8
    blanked = engine.compare(spark, [("A.java", one)], [("B.java", two)], template=[("T.java", two)])
    assert blanked["status"] == "failed" or blanked["weighted_final"] < r["weighted_final"]


def test_assembly_of_many_is_that_of_each(spark):
    one, two, renamed = texts()
    side = lambda t: {"toks": t.split(), "at": [t[: m.start()].count("\n") + 2 for m in re.finditer(r"\S+", t)], "src": [{"at": i + 2, "l": x, "meaningful": bool(x.strip()), "file": "f", "line": i + 1} for i, x in enumerate(t.split("\n"))], "fs": None}
    rows = [("x", n, "s" + n, None, "java", *side(t).values()) for n, t in zip("abc", (one, two, renamed))] + [("y", "d", None, None, "java", None, None, None, None)]
    df = spark.createDataFrame(rows, "assignment_id string, rep string, student_id string, grp string, lang string, toks array<string>, at array<int>, src array<struct<at int, l string, meaningful boolean, file string, line int>>, fs array<struct<start int, end int, func string, method array<string>, block array<string>, statement array<string>>>")
    scores = spark.createDataFrame([("x", "a", "b", 0.5), ("x", "a", "c", 0.97), ("x", "b", "c", 0.1), ("y", "d", "e", 0.2)], "assignment_id string, a string, b string, weighted_final double")
    got = sorted(tuple(r)[1:] for r in Y.all_evidence(df, scores).collect())
    read = {n: Y.Side(side(t), {}) for n, t in zip("abc", (one, two, renamed))}
    want = [r for a, b, s in (("a", "b", 0.5), ("a", "c", 0.97), ("b", "c", 0.1)) for r in Y.rows_of(a, b, read[a], read[b], Y.pair_evidence(read[a], read[b], s))]
    assert got == sorted(want) and {(r[0], r[1]) for r in got} >= {("a", "b"), ("a", "c")}
    assert Y.all_evidence(df.limit(0), scores).count() == 0 and Y.all_evidence(df, scores.limit(0)).count() == 0


def test_grams_that_repeat_are_matched_at_all_places(spark):
    """Beyond the fiftieth place of a gram, too."""
    line = "emit ( ID , NUM ) ; push ( ID ) ; "
    def side(n):
        return {"toks": (line * n).split(), "at": [i + 1 for i in range(n) for _ in line.split()], "src": [{"at": i + 1, "l": line, "meaningful": True, "file": "f", "line": i + 1} for i in range(n)], "fs": None}
    x, y = Y.Side(side(80), {}), Y.Side(side(80), {})
    ranges = {(a, b) for h in x.grams[12] for a in x.grams[12][h] for b in y.grams[12][h]}
    assert len(ranges) == 80 * 80 + 79 * 79
    (row,) = Y._gram_rows("x", "a", "b", x, y, 0.5)
    assert row[2:6] == (1, 80, 1, 80) and row[-2] == list(range(1, 81))
