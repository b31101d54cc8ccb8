"""Fingerprints of functions, and queries for reports on small tables with gaps."""

import __spark_entry__ as entry
from codesim.functions import fingerprints as P
from codesim.operators import structure as X
from tests.compare import duck, rows
from tests.test_structure import BUBBLE_JAVA, BUBBLE_PY


def test_function_prints(spark):
    df = spark.createDataFrame([("s", "A.java", "java", BUBBLE_JAVA), ("s", "b.py", "python", BUBBLE_PY), ("t", "e.c", "c", ""), ("t", "n.c", "c", None)], "sub_id string, file string, lang string, text string")
    got = {tuple(r) for r in X.function_prints(df).collect()}
    want = set()
    for sub, file, lang, text in (tuple(r) for r in df.collect()):
        for f in X.functions(text, lang):
            tokens = X.normal(f.tokens, lang).split(" ")
            k = P.size_k(len(tokens))
            hashes = [P.gram_hashes(tokens[i : i + k], k)[0] for i in range(len(tokens) - k + 1)]
            picked = {max(range(i, i + 4), key=lambda p: (-hashes[p], p)) for i in range(len(hashes) - 3)} or set(range(len(hashes)))
            want |= {(sub, file, f.name, f.start, k, hashes[p], p) for p in picked}
    assert got == want and len({r[2] for r in got}) == 2
    assert [P.size_k(n) for n in (5, 19, 20, 49, 50, 149, 150, 299, 300, 600, 100_000)] == [3, 3, 5, 5, 8, 8, 12, 12, 15, 16, 18]


def test_gaps(spark, tmp_path):
    d = str(tmp_path)
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    save("source_files", [(1, "s", "a/b/X.java", "class X {\r\n}"), (2, "s", "a/b/c/y.py", ""), (3, "t", "\\q\\..\\z.c", "int x;"), (4, "u", "only", "\n\n"), (5, None, "a", "b"), (6, "v", None, "b"), (7, "w", "n/m.c", None)], "file_id bigint, sub_id string, file string, text string")
    save("similarity_evidence", [(1, "r1", "a\n\n\n\nb // x  \n/* c\n */ d\n\n"), (1, "r1", "a\n\n\n\nb // x  \n/* c\n */ d\n\n"), (2, "r1", "other"), (3, "r2", None)], "evidence_id bigint, result_id string, full_source_a string")
    save("evidence", [(1, "r1", "A.java", 1, 9), (1, "r1", "A.java", 1, 9), (2, "r1", "A.java", 5, 7), (3, "r1", "A.java", 50, 60), (4, "r1", None, 1, 2), (5, "r1", "A.java", 3, 2), (6, "r2", "A.java", 1, 2), (7, "r9", "A.java", None, 2)], "block_id bigint, result_id string, file_a string, a1 int, a2 int")
    save("subtree_hashes", [("u1", "upload", ["A", None, " b "], ["c"], None), ("u1", "upload", ["d"], [], ["e"]), ("s1", "submission", ["a", "b", "d"], ["C"], []), ("s2", "submission", ["zz"], None, None), ("u2", "upload", None, None, None), (None, "upload", ["a"], None, None), ("u1", "submission", ["a"], None, None)], "sub_id string, origin string, statement array<string>, block array<string>, method array<string>")
    save("similarity_results", [("x1", " R1", "S", "t", None, "0.90", None), ("x1", "r1", "s ", "t", None, "0.90", None), ("x2", "r2", "u", None, None, None, None), ("x3", "r1", "w", "w", None, "1.00", None), ("x4", None, None, "v", "u1", "0.10", None)], "result_id string, run_id string, left_submission_id string, right_submission_id string, left_upload_id string, score string, prof_comparison boolean")
    spark.read.parquet(f"{d}/similarity_results.parquet").selectExpr("* EXCEPT (score)", "CAST(score AS decimal(5,2)) AS score", "CAST(NULL AS timestamp) AS created_at").write.parquet(f"{d}/tmp.parquet")
    (tmp_path / "similarity_results.parquet").rename(tmp_path / "_old")
    (tmp_path / "tmp.parquet").rename(tmp_path / "similarity_results.parquet")
    import shutil

    shutil.rmtree(tmp_path / "_old")
    spark.createDataFrame([("r1", "Completed "), ("r1", "failed"), ("r2", "FAILED"), ("r3", "odd"), ("r4", None), (None, "completed")], "run_id string, status string").selectExpr("*", "CAST(NULL AS timestamp) AS completed_at").write.parquet(f"{d}/analysis_runs.parquet")
    spark.createDataFrame([("s", "a1", "p"), ("s", "a1", None), ("t", "a1", "q"), ("u", "a2", None), ("v", None, "p"), (None, "a2", "p")], "sub_id string, assignment_id string, student_id string").selectExpr("*", "CAST(NULL AS timestamp) AS submitted_at").write.parquet(f"{d}/submissions.parquet")
    save("assignments", [("a1", "T"), ("a1", None), ("a3", "U")], "assignment_id string, title string")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("canonical_concat", "common_prefix", "code_slices", "upload_matches", "mark_compared", "submissions_with_reports", "run_states", "either_side", "assignment_view"):
        df = queries[name](spark, d)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        cur = duck(d).execute(sql[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall()), name
        assert got, name
    assert {tuple(r) for r in queries["common_prefix"](spark, d).collect()} == {("s", "a/b"), ("t", "q"), ("u", ""), ("w", "n")}
    assert {r.block_id: r.code for r in queries["code_slices"](spark, d).collect()} == {1: "a\n\nb\n\n d", 2: "b\n\n d", 3: ""}
    assert [(r.upload, r.sub_id, r.shared, r.containment) for r in queries["upload_matches"](spark, d).collect() if r.sub_id != "u1"] == [("u1", "s1", 4, 1.0)]
