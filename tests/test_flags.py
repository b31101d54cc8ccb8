"""All pairs, signals and flags of disguised copies, beside the SQL."""

import random
import re

import __spark_entry__ as entry
from codesim.operators import rules as Q
from tests.compare import duck, rows


def method(rng, name, extra=""):
    """A method of calls without loops, branches or assignments."""
    verbs = "emit push send mark keep drop fold join".split()
    lines = [f"    {rng.choice(verbs)}(a{rng.randrange(9)}, b{rng.randrange(9)}.{rng.choice(verbs)}({rng.randrange(1000, 9999)}{', c' * rng.randrange(4)}));" for _ in range(9)]
    return f"  int {name}(int a0, int b0) {{\n" + "\n".join(lines) + f"\n{extra}    return a0;\n  }}\n"


def disguises():
    """Pairs of Java texts that share most of their code, by the flag that tells them apart."""
    rng = random.Random(3)
    base = [method(rng, f"m{i}") for i in range(4)]
    more = [method(rng, f"k{i}") for i in range(8)]
    text = lambda *ms: "class A {\n" + "".join(ms) + "}\n"
    with_ = lambda extra: text(*base[:3], method(random.Random(9), "z", extra))
    one = text(*base)
    sums = [f"  int q{i}(int x) {{\n" + "".join("    emit(" + "".join(rng.choice(["x ", "7 ", "(x) ", "y(x) "]) + rng.choice("+ - * / % & | ^ << >>".split()) + " " for _ in range(6)) + "x);\n" for _ in range(6)) + "  }\n" for i in range(8)]
    cases = {
        "identifier_renaming": (one, re.sub(r"\b(emit|push|send|mark|keep|[abc]\d*)\b", r"\1Renamed", one)),
        "loop_type_swap": (with_("    for (;a0 < b0;) { emit(a0); }\n" * 3), with_("    while (a0 < b0) { emit(a0); }\n" * 3)),
        "literal_substitution": (one, re.sub(r"\d{4}", lambda m: str(10_000 + int(m.group())), one)),
        "dead_code_insertion": (one, text(*base, *more[:2])),
        "code_reordering": (text(*sums), text(*sums[4:], *sums[:4])),
        "switch_to_ifelse": (with_("    switch (a0) { case 1: emit(a0); break; default: push(b0); }\n"), with_("    if (a0 > 1) { emit(a0); }\n" * 4)),
        "ternary_to_ifelse": (with_("    emit(a0 > 1 ? b0 : a0);\n"), with_("    emit(a0);\n")),
        "exception_wrapping": (one, with_("    try { emit(a0); } catch (E e) { push(b0); }\n" * 2)),
        "for_each_to_indexed": (with_("    for (int v : list) { emit(v); }\n"), with_("    for (;a0 < b0;) { emit(a0); }\n")),
        "compound_op_expansion": (with_("    a0 ^= b0; b0 ^= a0; a0 |= b0; b0 &= a0; a0 ^= 7;\n"), with_("    emit(a0);\n")),
        "method_decomposition": (one, text(*base, *[f"  int s{i}(int q) {{\n    return q;\n  }}\n" for i in range(6)])),
        "condition_negation": (with_("    emit(!a0, !b0, !c);\n"), with_("    emit(a0);\n")),
        "intermediate_variable": (with_("    int t = a0;\n"), with_("".join(f"    int t{i} = a{i};\n" for i in range(8)))),
    }
    return cases


def test_every_flag_is_met_and_not_met(spark, tmp_path):
    cases = disguises()
    assert list(cases) == [flag for flag, _ in Q.RULES]
    files, subs, trees = [], [], []
    for i, (flag, pair) in enumerate(cases.items()):
        for side, text in zip("ab", pair, strict=True):
            sub = f"{i:02}{side}"
            files.append((len(files), sub, "r", "A.java", "java", text, None))
            subs.append((sub, "p", f"student {sub}", None, f"task {flag}", "submitted"))
            trees.append((sub, "submission", [f"s{i}", f"t{side}"], [f"b{i}"], [f"m{side if i % 2 else i}"] if i % 3 else None))
    # submissions without code or trees, of one student, and copies
    for sub, student, text in (("x1", "u1", " "), ("x2", "u2", ""), ("x3", "u2", "class B { int f(int x) { return x; } }"), ("x4", None, cases["dead_code_insertion"][0]), ("x5", None, cases["dead_code_insertion"][0])):
        files.append((len(files), sub, "r", "A.java", "java", text, None))
        subs.append((sub, "p", student, None, "task rest", "submitted"))
    d = str(tmp_path)
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    save("source_files", files, "file_id bigint, sub_id string, repository_id string, file string, ext string, text string, parse_ok boolean")
    save("submissions", subs, "sub_id string, path string, student_id string, grp string, assignment_id string, status string")
    save("subtree_hashes", trees, "sub_id string, origin string, statement array<string>, block array<string>, method array<string>")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("pair_signals", "all_flags", "match_positions", "submission_classes"):
        df = queries[name](spark, d)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        cur = duck(d).execute(sql[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall()), name
    told = {(r.a, r.b): r.asDict() for r in queries["all_flags"](spark, d).collect()}
    for i, flag in enumerate(cases):
        assert told[f"{i:02}a", f"{i:02}b"][flag], flag
    for flag in cases:
        assert {r[flag] for r in told.values()} == {True, False}
    trigger = {(r.a, r.b): r.reason for r in queries["pdg_trigger"](spark, d).collect()}
    assert {r and r.split(":")[0] for r in trigger.values()} >= {"condition_2", "condition_3"}
    final = queries["final_scores"](spark, d).collect()
    assert any(r.pdg_similarity is not None and r.final != r.weighted_final for r in final)
    scores = [r.asDict() for r in queries["batch_scores"](spark, d).collect()]
    for c in ("jaccard", "containment", "cosine", "structural", "ast_subtree", "method_pair", "weighted_final"):
        assert len({r[c] for r in scores}) > 2, c
