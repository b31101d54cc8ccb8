"""Pairs, signals, rules and the batch report."""

import itertools
import random

from pyspark.sql import functions as F

from codesim.engine import batch_analyze, compare
from codesim.operators import pairs as R
from codesim.operators import rules as Q
from codesim.operators import submissions as U


def test_containment_pairs_are_complete(spark):
    rng = random.Random(2)
    sets = {f"s{i:02}": sorted(rng.sample(range(40), rng.randrange(0, 12))) for i in range(60)}
    sets["t0"], sets["t1"] = list(range(100, 130)), list(range(100, 130))
    df = spark.createDataFrame([("x", k, v) for k, v in sets.items()] + [("y", "z", [1, 2, 3]), ("x", "n", None)], "blk string, rep string, els array<int>")
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r.a, r.b): r.shared for r in R.containment_pairs(df, "blk", "rep", "els", least).collect()}
        want = {}
        for a, b in itertools.combinations(sorted(sets), 2):
            shared = len(set(sets[a]) & set(sets[b]))
            if shared and shared >= least * min(len(sets[a]), len(sets[b])) - 1e-9:
                want[a, b] = shared
        assert got == want
    assert R.containment_pairs(df.limit(0), "blk", "rep", "els", 0.5).count() == 0


def value(spark, e, **cols):
    df = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in cols.items()])
    return df.select(e.alias("v")).first().v


def test_measures(spark):
    c = F.col
    args = (c("i"), c("m"), c("n"))
    assert value(spark, R.jaccard(*args), i=2, m=3, n=3) == 0.5 and value(spark, R.jaccard(*args), i=0, m=0, n=0) == 1
    assert abs(value(spark, R.containment(*args), i=2, m=3, n=3) - 2 / 3) < 1e-9 and value(spark, R.containment(*args), i=0, m=0, n=3) == 0
    assert value(spark, R.containment(*args, 0.0), i=0, m=0, n=0) == 0
    assert value(spark, R.with_pdg(c("b"), c("p")), b=0.55, p=0.90) == 0.62 and value(spark, R.with_pdg(c("b"), c("p")), b=1.0, p=1.0) == 1
    all_ = dict(jaccard=0.5, containment=0.6, cosine=0.7, structural=0.8, ast_subtree=0.4, method_pair=0.3)
    t, f = F.lit(True), F.lit(False)
    want = {(1, 1): 0.3 * 0.4 + 0.25 * 0.3 + 0.15 * 0.6 + 0.12 * 0.7 + 0.08 * 0.5 + 0.1 * 0.8, (1, 0): 0.3 * 0.4 + 0.25 * 0.3 + 0.29 * 0.6 + 0.16 * 0.5, (0, 1): 0.18 * 0.5 + 0.33 * 0.6 + 0.27 * 0.7 + 0.22 * 0.8, (0, 0): 0.36 * 0.5 + 0.64 * 0.6}
    for (ast, tok), w in want.items():
        assert abs(value(spark, R.base_score(t if ast else f, t if tok else f), **all_) - w) < 1e-4


SORT = """public class A { static void sort(int[] a) {
  for (int i = 0; i < a.length; i++) {
    for (int j = 0; j + 1 < a.length - i; j++) {
      if (a[j] > a[j + 1]) { int t = a[j]; a[j] = a[j + 1]; a[j + 1] = t; }
    }
  }
} 
  static int sum(int[] a) { int s = 0; for (int i = 0; i < a.length; i++) { s += a[i]; } return s; }
}"""
RENAMED = SORT.replace("sort", "order").replace("a[", "data[").replace("a.", "data.").replace("int[] a", "int[] data").replace(" t ", " swap ").replace("= t;", "= swap;").replace("s +=", "total +=").replace("int s", "int total").replace("return s", "return total")
OTHER = "public class B { String greet(String n) { if (n == null) { throw new IllegalStateException(\"no\"); } String r = n.trim(); return r.isEmpty() ? \"x\" : r.toLowerCase() + n.length(); } boolean odd(int q) { switch (q) { case 1: return true; default: return q % 2 == 1; } } }"


def test_compare(spark):
    same = compare(spark, [("A.java", SORT)], [("A.java", SORT)])
    renamed = compare(spark, [("A.java", SORT)], [("B.java", RENAMED)])
    other = compare(spark, [("A.java", SORT)], [("B.java", OTHER)])
    assert same["status"] == "completed" and same["weighted_final"] > 0.99
    assert renamed["weighted_final"] > 0.85 > 0.5 > other["weighted_final"]


def test_batch_leaves_out_and_orders(spark):
    files = spark.createDataFrame([("a", "A.java", SORT), ("b", "A.java", RENAMED), ("c", "A.java", SORT + "\n// x"), ("d", "B.java", OTHER), ("e", "E.java", ""), ("f", None, SORT), ("g", "G.java", None)], "sub_id string, file string, text string")
    owners = spark.createDataFrame([("a", "x", "1", "g1"), ("b", "x", "2", ""), ("c", "x", "1", "g2"), ("d", "x", "3", None), ("e", "x", "4", None)], "sub_id string, assignment_id string, student_id string, grp string")
    got = [(r.a, r.b) for r in batch_analyze(files, owners).collect()]
    assert set(got) == {("a", "b"), ("b", "c")}  # a and c are of one student
    assert batch_analyze(files.limit(0), owners).count() == 0
    assert batch_analyze(files, owners, threshold=1.1).count() == 0
    template = files.where("sub_id = 'a'").select("file", "text")
    assert batch_analyze(files, owners, template=template).count() < 2


def flags(spark, a, b, norm=0.6, **more):
    zero = {n: 0 for n in [*Q.COUNTS, "n_methods", "n_each", "n_norm", "n_lits", "loops"]}
    sides = [{**zero, **x} for x in (a, b)]
    row = {"norm": norm, "raw": more.get("raw", norm), "lits_shared": more.get("lits_shared", 0), "drift": more.get("drift", 0.0)}
    df = spark.range(1).select(*[F.struct(*[F.lit(v).cast("double").alias(k) for k, v in s.items()]).alias(n) for s, n in zip(sides, "ab")], *[F.lit(v).cast("double").alias(k) for k, v in row.items()])
    r = df.select(*[F.expr(test).alias(flag) for flag, test in Q.RULES]).first().asDict()
    return {k for k, v in r.items() if v}


def test_each_rule_fires_alone(spark):
    assert flags(spark, {}, {}) == set()
    assert flags(spark, {}, {}, raw=0.3) == {"identifier_renaming"}
    assert flags(spark, {"n_for": 3, "loops": 3}, {"n_while": 3, "loops": 3}) == {"loop_type_swap"}
    assert flags(spark, {"n_lits": 5}, {"n_lits": 5}, lits_shared=1) == {"literal_substitution"}
    assert flags(spark, {"n_norm": 130}, {"n_norm": 100}) == {"dead_code_insertion"}
    assert flags(spark, {}, {}, drift=0.3) == {"code_reordering"}
    assert flags(spark, {"n_switch": 1, "n_if": 1}, {"n_if": 4}) == {"switch_to_ifelse"}
    assert flags(spark, {"n_ternary": 1}, {}) == {"ternary_to_ifelse"}
    assert flags(spark, {"n_try": 2}, {}) == {"exception_wrapping"}
    assert flags(spark, {"n_each": 1}, {}) == {"for_each_to_indexed"}
    assert flags(spark, {"n_compound": 4}, {"n_compound": 1}) == {"compound_op_expansion"}
    assert flags(spark, {"n_methods": 4}, {"n_methods": 2}) == {"method_decomposition"}
    assert flags(spark, {"n_not": 3}, {}) == {"condition_negation"}
    assert flags(spark, {"n_assign": 11}, {"n_assign": 5}) == {"intermediate_variable"}
    assert flags(spark, {"n_try": 9}, {}, norm=0.2) == set()


def test_raw_features(spark):
    src = "for ( int x : xs ) { a = ! b ; } void f ( ) throws E { for ( i ; i ; i ) { } } ? 'c' 12 \"s\" 12".split()
    rows = [("s", v, i, t, "f", 1) for v in ("raw", "norm") for i, t in enumerate(src)]
    r = Q.raw_features(spark.createDataFrame(rows, "sub_id string, variant string, spos int, tok string, file string, line int")).first()
    assert (r.n_for, r.n_each, r.n_methods, r.n_not, r.n_ternary, r.n_assign, r.lits) == (2, 1, 3, 1, 1, 1, ['"s"', "'c'", "12"])


def test_submission_language(spark):
    df = spark.createDataFrame([("a", "c"), ("a", "cpp"), ("b", "java"), ("c", "java"), ("c", "python")], "sub_id string, lang string")
    assert {tuple(r) for r in U.submission_language(df).collect()} == {("a", "cpp"), ("b", "java"), ("c", "mixed")}


def test_containment_pairs_across_blocks_equal_brute_force(spark, monkeypatch):
    """Sets in several blocks, matched a few elements at a time: no pair is lost or doubled."""
    import random

    from codesim.operators import blocks as B
    from codesim.operators import pairs as R

    rng = random.Random(8)
    base = [rng.sample(range(300), 40) for _ in range(6)]
    sets = {f"s{i:02}": sorted({x if rng.random() < 0.9 else rng.randrange(300) for x in rng.choice(base)[: rng.randrange(5, 40)]}) for i in range(50)} | {"none": []}
    monkeypatch.setattr(B, "WIDE", 9)
    monkeypatch.setattr(B, "MATCHES", 50)
    df = spark.createDataFrame([("x" if i % 7 else "y", k, v) for i, (k, v) in enumerate(sets.items())], "blk string, r string, els array<bigint>")
    where = {k: i % 7 == 0 for i, k in enumerate(sets)}
    got = sorted(tuple(r)[1:] for r in R.containment_pairs(df, "blk", "r", "els", 0.7).collect())
    want = sorted((a, b, len(set(sets[a]) & set(sets[b])), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and where[a] == where[b] and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= 0.7 * min(len(sets[a]), len(sets[b])) - 1e-9)
    assert want and got == want


def test_no_token_is_a_row_on_the_way_to_classes(spark):
    """The plan of fingerprint_pairs has no exchange of tokens: streams are packed by submission."""
    from codesim.operators import submissions as U
    from codesim.plans import prints as W
    from codesim.plans import texts as T

    d = "/root/testdata/sf0.001"
    told = {r.sub_id: (U.unpacked(r.raw), U.unpacked(r.norm)) for r in W.stream_table(spark, d).collect()}
    want = {r.sub_id: (r.raw, r.norm or []) for r in U.streams(U.submission_tokens(T.tokens(spark, d))).collect()}
    assert told == {k: (list(a), list(b)) for k, (a, b) in want.items()}
    plan = W.stream_table(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
