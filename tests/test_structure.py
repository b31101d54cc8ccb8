"""Structure, evidence folds, archives, records and streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from codesim.operators import evidence as E
from codesim.operators import records as O
from codesim.operators import structure as X
from codesim.sources import archives as A
from codesim.sources import sinks

BUBBLE_JAVA = "class A {\n  // c {\n  static void bubble(int[] a) {\n    for (int i = 0; i < a.length; i++) {\n      swap(a, i);\n    }\n  }\n  static void swap(int[] a, int i) {\n    int t = a[i];\n    a[i] = a[i + 1];\n    a[i + 1] = t;\n  }\n}\n"
BUBBLE_PY = "import os\ndef bubble(a):\n    for i in range(len(a)):\n        if a[i] > 1:\n            swap(a, i)\n\ndef swap(a, i):\n    t = a[i]\n    a[i] = a[i + 1]\n    return t\n\nprint(bubble([1]))\n"


def test_functions_and_calls():
    java = X.functions(BUBBLE_JAVA, "java")
    assert [(f.name, f.start, f.end) for f in java] == [("bubble", 3, 7), ("swap", 8, 12)]
    assert X.calls(java[0]) == ["swap"] and X.calls(java[1]) == []
    py = X.functions(BUBBLE_PY, "python")
    assert [(f.name, f.start, f.end) for f in py] == [("bubble", 2, 5), ("swap", 7, 10)]
    assert X.calls(py[0]) == ["range", "len", "swap"]
    for bad in ("", "{{{{", "}}}", "int f(", "def", "def f(", "x" * 100_000, "(" * 5000, '"open'):
        for lang in ("java", "c", "python", "mixed"):
            assert isinstance(X.functions(bad, lang), list)


def sims(a, b, lang):
    fa, fb = X.functions(a, lang), X.functions(b, lang)
    return X.best_match([X.hashes(f, lang) for f in fa], [X.hashes(f, lang) for f in fb]), X.dependence_similarity(X.dependence(fa, lang), X.dependence(fb, lang))


def test_invariances():
    renamed = BUBBLE_PY.replace("bubble", "sorter").replace("swap", "flip").replace("(a", "(data").replace("a[", "data[").replace(" t", " tmp")
    unrelated = "def fetch(u):\n    with open(u) as h:\n        return h.read().strip()\n\ndef main():\n    while True:\n        print(fetch('x'))\n        break\n"
    assert sims(BUBBLE_PY, BUBBLE_PY, "python") == (1.0, 1.0)
    match, graph = sims(BUBBLE_PY, renamed, "python")
    assert match >= 0.85 and graph >= 0.80
    match, graph = sims(BUBBLE_PY, unrelated, "python")
    assert match <= 0.30 and graph < 1
    loop = BUBBLE_JAVA.replace("for (int i = 0; i < a.length; i++)", "while (i < a.length)")
    assert 0 < sims(BUBBLE_JAVA, loop, "java")[0] < 1
    assert X.best_match([], []) == 0.0 and X.level_similarity({k: set() for k in ("method", "block", "statement")}, {k: {"x"} for k in ("method", "block", "statement")}) == 0.0


def test_call_similarity():
    star = {"main": ["a", "b"], "a": [], "b": []}
    assert X.call_similarity(star, star) == 1.0 and X.call_similarity(star, {}) == 0.0
    assert X.call_similarity(star, {"run": ["x", "y"], "x": [], "y": []}) == 1.0
    assert X.call_similarity({"f": ["f"]}, {"f": []}) < 1


def test_structure_tables(spark):
    df = spark.createDataFrame([("s", "A.java", "java", BUBBLE_JAVA), ("s", "b.py", "python", BUBBLE_PY), ("t", "e.c", "c", ""), ("t", "n.c", "c", None or "int x;")], "sub_id string, file string, lang string, text string")
    f = X.function_table(df)
    assert f.count() == 4 and f.where("size(statement) > 0").count() == 4
    p = {r.file: r for r in X.pdg_table(df).collect()}
    assert p["A.java"].parse_ok and p["A.java"].has_cycles and not p["e.c"].parse_ok and p["b.py"].n_data > 0
    assert X.function_table(df.limit(0)).count() == 0


def test_pair_tables(spark):
    two = BUBBLE_JAVA.replace("bubble", "order").replace("swap", "flip")
    df = spark.createDataFrame([("s", "A.java", "java", BUBBLE_JAVA), ("s", "B.java", "java", "class B { }"), ("t", "C.java", "java", two), ("u", "d.c", "c", "")], "sub_id string, file string, lang string, text string")
    pairs = spark.createDataFrame([("s", "t"), ("s", "u"), ("s", "gone")], "a string, b string")
    f = X.function_table(df)
    assert {(r.a, r.b): r.method_pair for r in X.pair_structure(pairs, f).collect()} == {("s", "t"): 1.0, ("s", "u"): 0.0, ("s", "gone"): 0.0}
    e = X.method_evidence(pairs, f).collect()
    assert sorted((r.method_a, r.method_b, r.match_strength, r.confirmed) for r in e) == [("bubble", "order", "high", True), ("swap", "flip", "high", True)]
    d = {(r.a, r.b): r.pdg_similarity for r in X.pair_dependence(pairs, X.pdg_table(df)).collect()}
    assert d == {("s", "t"): 1.0, ("s", "u"): 0.0, ("s", "gone"): 0.0}


def test_merge_close():
    assert E.merge_close([(1, 2, 1, 2), (4, 5, 4, 5)], 2) == [(1, 5, 1, 5)]
    assert E.merge_close([(1, 2, 1, 2), (5, 6, 5, 6)], 2) == [(1, 2, 1, 2), (5, 6, 5, 6)]
    # a later block that would join the first, but not the last, stays apart: no plain gaps and islands
    assert E.merge_close([(1, 2, 10, 11), (3, 4, 1, 2), (5, 6, 12, 13)], 2) == [(1, 2, 10, 11), (3, 4, 1, 2), (5, 6, 12, 13)]
    assert E.merge_close([], 2) == []


def block(a1, a2, b1, b2, s="high"):
    return {"a1": a1, "a2": a2, "b1": b1, "b2": b2, "strength": s}


def test_claims():
    out = E.one_to_one([block(1, 10, 1, 10), block(8, 20, 8, 20, "medium"), block(9, 11, 30, 40, "low")])
    assert [(e["a1"], e["a2"]) for e in out] == [(1, 10), (11, 20)]
    rng = random.Random(3)
    for _ in range(100):
        bs = [block(a, a + rng.randrange(12), b, b + rng.randrange(12), rng.choice(list(E.RANK))) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(8))]
        kept = E.one_to_one(bs)
        for side in "ab":
            rows = [x for e in kept for x in (e[side + "1"], e[side + "2"])]
            assert len(rows) == len(set(rows))
        assert all(e["a2"] - e["a1"] >= 2 and e["b2"] - e["b1"] >= 2 for e in kept)
    assert len(E.add_new([block(1, 5, 1, 5)], [block(4, 8, 4, 8), block(4, 8, 50, 60)])) == 2
    assert E.claim_methods([(0.9, 1, 10, 1, 10), (0.8, 5, 12, 20, 30), (0.7, 11, 20, 11, 20), (0.6, 30, 32, 30, 40), (0.1, 50, 60, 50, 60)]) == [(0.9, 1, 10, 1, 10), (0.7, 11, 20, 11, 20)]


def test_extend_up():
    la = ["x", "same", "also", "core", "core2"]
    lb = ["y", "same", "also", "core", "core2"]
    assert [(e["a1"], e["b1"]) for e in E.extend_up([block(4, 5, 4, 5)], la, lb)] == [(2, 2)]
    assert [(e["a1"], e["b1"]) for e in E.extend_up([block(4, 5, 4, 5)], la, lb, frozenset({"also"}))] == [(4, 4)]


def test_kgram_blocks(spark):
    m = spark.createDataFrame([("a", "b", i, i + 2, i + 10, i + 12) for i in range(1, 12)] + [("a", "b", 50, 51, 50, 51)], "a string, b string, a1 int, a2 int, b1 int, b2 int")
    code = spark.createDataFrame([("a", list(range(1, 60))), ("b", list(range(1, 60)))], "rep string, lines array<int>")
    s = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, weighted_final double")
    (r,) = E.kgram_blocks(m, s, code).collect()
    assert (r.a1, r.a2, r.b1, r.b2, r.match_strength, r.tokens_matched, r.line_highlights_a) == (1, 13, 11, 23, "high", 104, list(range(1, 14)))
    (r,) = E.kgram_blocks(m, s.withColumn("weighted_final", F.lit(0.97)), code).collect()
    assert (r.a1, r.a2, r.evidence_source) == (1, 59, "identical")
    assert E.kgram_blocks(m.limit(0), s, code).count() == 0


def pack(entries, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in entries:
            z.writestr(n, b)
    return out.getvalue()


def test_archives():
    inner = pack([("In.java", "class In {}")])
    z = pack([("src/Main.java", "class A {}"), ("../../up.c", "int x;"), ("__MACOSX/x.java", "x"), ("a/.DS_Store", "x"), ("sub/in.zip", inner), ("r.txt", "x"), ("e.java", "")])
    assert sorted(p for p, _ in A.taken("s.zip", z)) == ["src/Main.java", "sub/in/In.java", "up.c"]
    assert A.taken("One.java", b"\xff\xfeclass")[0][1].endswith("class")
    for name, data, error in (("s.zip", z[:40], A.CorruptZipError), ("s.zip", pack([]), A.EmptySubmissionError), ("s.pdf", b"x", A.UnsupportedFileTypeError), ("s.zip", pack([(f"{i}.c", "x") for i in range(5001)]), A.ZipTooLargeError), ("s.zip", pack([("a.c", b"\0" * 20_000_000)]), A.ZipBombError), ("s.zip", pack([("d/" * 200 + "a.c", "x")]), A.PathTraversalError)):
        with pytest.raises(error):
            A.taken(name, data)
    deep = pack([("A.java", "x")])
    for _ in range(13):
        deep = pack([("n.zip", deep)])
    with pytest.raises(A.EmptySubmissionError):
        A.taken("s.zip", deep)


def test_read_archives(spark, tmp_path):
    (tmp_path / "ok.zip").write_bytes(pack([("Main.java", "class A {}"), ("Helper.java", "class B {}")]))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04broken")
    rows = A.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.status) for r in rows if r.file) == [("Helper.java", "ok"), ("Main.java", "ok")]
    assert [r.error.split(":")[0] for r in rows if r.status == "failed"] == ["CorruptZipError"]


def test_records(spark):
    st = spark.createDataFrame([("a", 1, 7), ("b", 1, 7), (None, 1, 7)], "k string, v int, _rank int")
    ar = spark.createDataFrame([("b", 2, 8), ("b", 3, 8), ("c", 4, 8)], "k string, v int, _rank int")
    assert sorted((tuple(r) for r in O.upsert(st, ar, ["k"], [F.desc("v")]).collect()), key=repr) == [("a", 1, 7), ("b", 3, 8), ("c", 4, 8), (None, 1, 7)]
    assert {r.k: r.v for r in O.insert_ignore(st, ar, ["k"], [F.desc("v")]).collect()} == {"a": 1, "b": 1, "c": 4, None: 1}
    assert {r.k: r.v for r in O.replace_partition(st.dropna(), ar, "k").collect() if r.k != "b"} == {"a": 1, "c": 4}
    parent, child = O.delete_cascade(st, F.col("k") == "a", [(ar.withColumn("p", F.lit("a")), "p")], "k")
    assert parent.count() == 2 and child.count() == 0
    assert O.repeated(ar, ["k"]).collect()[0].n == 2


def test_reports_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.561, "MEDIUM", ["loop_type_swap", "odd"]), ("a", "c", 0.1, "LOW", [])], "a string, b string, weighted_final double, risk string, flags array<string>")
    one, two = (r.report for r in sinks.text_report(df).orderBy("b").collect())
    assert one == "a ~ b: 56.1% (MEDIUM)\nTechniques: Loop type swap, odd" and two.endswith("none")
    sinks.write_partitioned(df, str(tmp_path / "p"), "risk")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stream(spark, tmp_path):
    from codesim.streaming.arrivals import arrivals_by_window, each_batch, read_arrivals

    schema = "sub_id string, artifact_id string, status string, submitted_at timestamp, arrived_at timestamp"
    df = spark.sql("SELECT 's' || (id % 3) AS sub_id, 'u' || id AS artifact_id, 'ok' AS status, timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) AS submitted_at, timestamp'2024-01-02' + make_interval(0,0,0,cast(id as int)) AS arrived_at FROM range(9)")
    df.select("sub_id", "artifact_id", "status", "submitted_at", "arrived_at").write.parquet(str(tmp_path / "in"))
    stream = read_arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    seen = []
    each_batch(stream, lambda b, n: seen.extend(r.artifact_id for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert {"u6", "u7", "u8"} <= set(seen)
    q = arrivals_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM windows").first().n == 9


def test_long_heads():
    many = ", ".join(f"E{i}" for i in range(10))
    java = f"class A {{\n  void f() throws {many} {{\n    g();\n  }}\n}}\n"
    assert [f.name for f in X.functions(java, "java")] == ["f"]
    cpp = "A::A(int x) : a(x), b((x + 1) * 2), Base<int>::c(g(x)) {\n  run(x);\n}\nauto h(int y) -> int {\n  return y;\n}\nint k(int z);\nint u = v ? w(1) : q(2);\n"
    assert [f.name for f in X.functions(cpp, "cpp")] == ["A", "h"]
