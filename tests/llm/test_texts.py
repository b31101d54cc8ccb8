"""Tokenizer, leaks and residue."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codesim.llm import leakage as L
from codesim.llm import residue as R
from codesim.llm import tokenizer as K

pytestmark = pytest.mark.filterwarnings("ignore")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary")


@needs_vocabulary
def test_automaton_is_the_vocabularys_own():
    import tiktoken

    ranks = K.ranks_of(K.VOCABULARY)
    real = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = K.Encoder(K.Automaton(ranks))
    rng = random.Random(1)
    alphabet = "ab eth\n\t'sé🙂Ж1 <|>\u00a0\u2003\x1c"
    texts = ["", " ", "a" * 3000, "the " * 500, " " * 700, "<|endoftext|>", "don't I'll x² ½ ß", "\r\n\r\n x", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000))]
    for t in texts:
        ids = e.encode(t)
        assert ids == real.encode_ordinary(t), repr(t)
        assert e.automaton.decode(ids).decode() == t


def test_small_automaton_prefers_early_merges():
    a = K.Automaton({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"aa": 5, b"abc": 6})
    assert a.encode(b"abc") == [6] and a.encode(b"bc") == [4] and a.encode(b"aaa") == [5, 0] and a.encode(b"aab") == [0, 3] and a.encode(b"") == []


@needs_vocabulary
def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 5), (3, None, 5), (4, "x" * 20_000, 5), (4, "hi", 5), (None, "hi", 5)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0, len(r.ids)) for r in K.encoded(df).collect()))
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 2), (2, 0), (3, 0)] and len(got) == 6
    assert K.encoded(df.limit(0)).count() == 0


def brute_leaks(docs, items, n):
    grams = lambda t: {" ".join(w[i : i + n]) for w in [L.normalised(t).split()] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs if t for i, q in items if q and grams(t) & grams(q)}


def test_leaks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Éa", "ÉA", "b_c", "x²", "İz"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "__", " - "]) for _ in range(n))
    items = [(i, text(rng.randrange(2, 20))) for i in range(30)] + [(98, None), (99, "")]
    docs = [(i, text(20) + (rng.choice(items[:30])[1].upper() if i % 2 else "") + text(5)) for i in range(60)] + [(100, None), (101, ""), (102, "w1 " * 20_000)]
    d = spark.createDataFrame([(*x, 1) for x in docs + docs[:3]], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame([(*x, 1) for x in items + items[:3]], "item_id bigint, text string, doc_id int")
    for n in (2, 4):
        want = brute_leaks(docs, items, n)
        assert want and {tuple(r) for r in L.leaks(d, q, n).collect()} == want
    monkeypatch.setattr(L, "BLOCK_CHARS", 200)  # several automata
    assert {tuple(r) for r in L.leaks(d, q, 4).collect()} == want
    assert L.leaks(d.limit(0), q, 4).count() == 0 and L.leaks(d, q.limit(0), 4).count() == 0


def test_leak_offsets(spark):
    d = spark.createDataFrame([(1, "Intro İ! One,  two\nTHREE four five. End")], "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "zero one two three four"), (8, "two three four five six")], "item_id bigint, text string")
    got = {r.item_id: (r.first, r.end) for r in L.leaks(d, q, 4, offsets=True).collect()}
    text = d.first().text
    assert text[slice(*got[7])] == "One,  two\nTHREE four" and text[slice(*got[8])] == "two\nTHREE four five"


NOUNS = "ledge valve keel marsh quarry tulip spindle wharf".split()


def corpus(rng):
    """(text, is it residue) of small made-up records."""
    n = lambda: rng.choice(NOUNS)
    real = lambda k: " ".join(f"Please measure the {n()} before the {n()} of group {rng.randrange(99)} is stored." for _ in range(k))
    code = f"int {n()}(int {n()}) {{\n  // TODO check {n()}\n  printf(\"404 Not Found {{{{slot}}}}\");\n  return {n()} + {rng.randrange(99)};\n}}\n"
    bad = [f"404 Not Found\n\nThe file /{n()} was not found on this server.", f"Please enable JavaScript to view {n()}.", "lorem ipsum dolor sit amet " * rng.randrange(2, 30), "blah " * rng.randrange(5, 90), "Question 1: ______\nQuestion 2: ______", "Summary: n/a\nMethod: ...", f"Dear {{{{name}}}},\n{real(2)}", f"{real(1)} [your {n()} here] {real(1)}", "// your code here\n// your code here", f"Access denied. You do not have permission to view {n()}."]
    good = [real(4), code, real(3) + f'\nstudent 4: I get "503 Service Unavailable" when I open the {n()}.', f"tutor 3: solved, the {n()} was off by 2.", real(2) + f" The {n()} needs JavaScript, so we draw a plain table.", code + real(1)]
    return [(t, True) for t in bad] + [(t, False) for t in good]


def test_residue_held_out(spark):
    rng = random.Random(5)
    train = [x for _ in range(60) for x in corpus(rng)]
    test = [x for _ in range(30) for x in corpus(rng)]
    frame = lambda rows: spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string, words int")
    model = R.learned(R.records(frame(train), "doc_id", "text"))
    found = {r.doc_id for r in R.residue(frame(test), model=model).collect()}
    wrong = [t for i, (t, bad) in enumerate(test) if (i in found) != bad]
    assert len(wrong) <= 0.02 * len(test), wrong[:5]


def test_residue_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "404 Not Found"), (4, "404 Not Found"), (5, "word " * 30_000), (6, "\n" * 1000), (None, "Access denied."), (7, "🙂"), (8, "the plain text of a record")], "doc_id bigint, text string").withColumn("key", F.lit(1))
    assert {r.doc_id for r in R.residue(df).collect()} == {4, 5, None}
    assert R.residue(df.limit(0)).count() == 0


def test_verdicts_come_from_scores_alone(spark, monkeypatch):
    rng = random.Random(8)
    rows = [x for _ in range(60) for x in corpus(rng)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    table = R.records(df, "doc_id", "text")
    model = R.learned(table)
    assert len(model.likelihood) > 1 and model.likelihood[-1] >= model.likelihood[0] - 1e-9
    found = {r.doc_id for r in R.residue(df, model=model).collect()}
    monkeypatch.setattr(R, "trusted", lambda *_: 0)  # no lists once the model is there
    batch = next(R._records(pa.int64())(iter([df.selectExpr("doc_id", "text", "0.5D AS pick").toArrow().combine_chunks().to_batches()[0]])))
    assert set(batch.column(1 + 1).to_pylist()) == {0}
    decided = pa.Table.from_batches(R._decided(model)(iter([batch]))).column(0).to_pylist()
    assert set(decided) == found


def test_labels_are_a_bounded_sample(spark):
    rng = random.Random(9)
    rows = [x for _ in range(60) for x in corpus(rng)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    table = R.records(df, "doc_id", "text")
    few = R.learned(table, most=150)  # of 600
    again = {r.doc_id for r in table.mapInArrow(R._decided(few), "key bigint").withColumnRenamed("key", "doc_id").collect()}
    bad = {i for i, (_, b) in enumerate(rows) if b}
    assert len(bad ^ again) <= 0.1 * len(bad)
