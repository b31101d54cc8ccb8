"""Top N, components, similar sets and shared spans against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codesim.llm import components as C
from codesim.llm import setjoin as J
from codesim.llm import spans as S
from codesim.llm import topn as T


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), f"i{i:03}", rng.choice([None, 1.0, 2.0, 3.0]), i, "x") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:20], "g string, item string, score double, _rank int, _salt string")
    got = T.top_n(df, ["g"], "item", [F.desc_nulls_last("score")], 5)
    assert got.columns == df.columns
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows + rows[:20] if r[0] == g), key=lambda r: (-(r[2] or 0), r[1]))
        want += own[:5]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert T.top_n(df.limit(0), ["g"], "item", [F.desc("score")], 5).count() == 0
    assert T.top_n(df, ["g"], "item", [F.desc("score")], 0).count() == 0


def test_best_results(spark):
    df = spark.createDataFrame([(" R1 ", "a", "0.50"), ("r1", "a", "0.90"), ("r1", "b", "0.90"), ("r1", "c", None), (None, "d", "0.1"), ("r2", None, "0.2")], "run_id string, result_id string, score string").withColumn("score", F.col("score").cast("decimal(5,2)"))
    assert sorted(map(tuple, T.best_results(df, 1).collect())) == [("r1", "a")]


def groups(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("hub", [3, 50_000])
def test_components(spark, hub):
    rng = random.Random(hub)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]  # a chain
    edges += [("hub", f"h{i:02}") for i in range(40)]
    edges += [(f"r{rng.randrange(60):02}", f"r{rng.randrange(60):02}") for _ in range(40)]
    edges += [("x", "y"), ("y", "x"), ("x", "y")]
    df = spark.createDataFrame(edges + [("self", "self"), (None, "x"), ("z", None)], "a string, b string").withColumn("cluster", F.lit(1))
    got = {r.id: r.group_id for r in C.components(df, "a", "b", hub=hub).collect()}
    assert got == groups([e for e in edges if e[0] != e[1]])


def test_components_of_nothing_and_numbers(spark):
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert C.components(empty, "a", "b").collect() == []
    assert C.components(empty, "a", "b").columns == ["id", "group_id"]
    two = spark.createDataFrame([(10, 9), (9, 2), (5, 4)], "a bigint, b bigint")
    assert {r.id: r.group_id for r in C.components(two, "a", "b").collect()} == {10: 2, 9: 2, 2: 2, 5: 4, 4: 4}


def test_links_are_cleaned(spark):
    df = spark.createDataFrame([(" A", "b ", "0.80"), ("a", "a", "0.99"), ("b", "C", "0.79"), ("d", None, "0.9"), ("e", "f", None)], "left_submission_id string, right_submission_id string, score string").withColumn("score", F.col("score").cast("decimal(5,2)"))
    assert sorted(map(tuple, C.linked_submissions(df).collect())) == [("a", "a"), ("b", "a")]


def test_calibration():
    segments, radius = J.calibrated(0.7)
    agree = 0.85
    assert (1 - agree**J.BITS) ** segments <= J.MISS * 1.001
    assert 0.15 < radius / (segments * J.BITS) < 0.2


def test_similar_sets_recall(spark):
    rng = random.Random(4)
    sets = {f"r{i:03}": {f"e{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60))} for i in range(120)}
    for i in range(80):  # copies at and around the threshold
        base = rng.choice(sorted(sets))
        keep = sorted(sets[base])
        drop = rng.randrange(0, len(keep) // 3 + 1)
        sets[f"s{i:03}"] = set(keep[drop:])
    df = spark.createDataFrame([(k, [*sorted(v), None, sorted(v)[0] if v else None], 1) for k, v in sets.items()] + [("empty", [], 1), ("null", None, 1), ("nulls", [None], 1)], "key string, els array<string>, cls int")
    pairs, members = J.similar_sets(df, "key", "els", 0.7)
    cls = {r.key: bytes(r.cls) for r in members.collect()}
    assert set(cls) == {k for k, v in sets.items() if v}
    found = {(bytes(r.ca), bytes(r.cb)): r.jaccard for r in pairs.collect()}
    got = {(a, b) for a, b in itertools.combinations(sorted(cls), 2) if cls[a] == cls[b] or tuple(sorted((cls[a], cls[b]))) in found}
    want = {(a, b) for a, b in itertools.combinations(sorted(cls), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 60


def test_similar_records(spark):
    rows = [("a", ["AB ", "x"], None, []), ("a", ["y", None], ["z"], None), ("b", ["ab", "x", "y", "y"], ["Z"], []), ("c", ["ab", "x", "y"], None, ["z"]), ("d", [], None, [None]), (None, ["q"], [], [])]
    df = spark.createDataFrame(rows, "sub_id string, statement array<string>, block array<string>, method array<string>")
    assert sorted(map(tuple, J.similar_records(df).collect())) == [("a", "b")]
    assert J.similar_records(df.limit(0)).count() == 0


def brute(texts, least):
    """Maximal runs of shared characters, by comparing all windows."""
    where = {}
    for field, rec, group, t in texts:
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(group)
    out = set()
    for field, rec, group, t in texts:
        mark = [False] * len(t or "")
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                mark[i : i + least] = [True] * least
        i = 0
        while i < len(mark):
            if mark[i]:
                j = i
                while j + 1 < len(mark) and mark[j + 1]:
                    j += 1
                out.add((field, rec, i + 1, j + 1))
                i = j
            i += 1
    return out


def spans(spark, texts, least):
    df = spark.createDataFrame(texts, "field string, rec_id bigint, g string, t string").withColumn("cls", F.lit(1)).withColumn("place", F.lit(2))
    return {tuple(r) for r in S.shared_spans(df, ["field", "rec_id"], "g", "t", least).collect()}


@pytest.mark.parametrize(("seed", "least", "letters"), [(1, 8, "ab"), (2, 12, "abcd"), (3, 40, "abcdefgh\n é🙂")])
def test_shared_spans(spark, seed, least, letters):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [word(rng.randrange(least // 2, 4 * least)) for _ in range(6)]
    texts = []
    for i in range(50):
        t = "".join(rng.choice(pool) if rng.random() < 0.5 else word(rng.randrange(least)) for _ in range(rng.randrange(5)))
        texts.append(("f", i, f"g{rng.randrange(12)}", t))
    texts += [("f", 100, "g1", None), ("f", 101, None, pool[0] * 2), ("f", 102, None, pool[0] * 2), ("f", 103, "g1", ""), ("g", 1, *texts[3][2:]), texts[5]]
    assert spans(spark, texts, least) == brute(texts, least)


def test_shared_spans_edges(spark):
    a = "x" * 500
    assert spans(spark, [("f", 1, "g", a), ("f", 2, "g", a)], 40) == set()
    assert spans(spark, [("f", 1, "g", a), ("f", 2, "h", a[:40])], 40) == {("f", 1, 1, 500), ("f", 2, 1, 40)}
    assert spans(spark, [], 40) == set()
    with pytest.raises(ValueError):
        spans(spark, [], 10)


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(9)
    t = "".join(rng.choice("abc") for _ in range(5000))
    whole = S.anchors(t, 40)
    monkeypatch.setattr(S, "BLOCK", 700)
    cut = S.anchors(t, 40)
    cover = lambda r: [(p, i) for p, f, last in zip(r["place"], r["first"], r["last"]) for i in range(f, last + 1)]
    assert cover(whole) == cover(cut)
