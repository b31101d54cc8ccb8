"""The whole evidence of many pairs at once."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from codesim.functions.text import TRIVIAL_LINES
from codesim.operators import assembly as Y
from codesim.operators import disguise as D
from codesim.operators import evidence as E
from codesim.operators import passages as Z
from codesim.operators import submissions as U
from codesim.operators import wholes as V


def test_the_query_sends_no_token_and_folds_no_pair(spark):
    plan = __spark_entry__.queries()["full_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Generate posexplode" not in plan and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("width", [6, 40])
def test_ranges_fold_as_those_of_each_pair(width):
    rng = random.Random(4)
    rows = {(pair, rng.randrange(1, width), rng.randrange(1, width)): (rng.randrange(4), rng.randrange(4)) for pair in range(60) for _ in range(rng.randrange(1, 90))}
    columns = [np.array(v, np.int64) for v in zip(*((p, a, a + m, b, b + n) for (p, a, b), (m, n) in sorted(rows.items())), strict=True)]
    gap = np.array([2, 4, 6])[columns[0] % 3]
    got = sorted(zip(*(v.tolist() for v in V.folded(*columns, gap)), strict=True))
    want = sorted((p, *block) for p in range(60) for block in E.merge_close([(a, a + m, b, b + n) for (q, a, b), (m, n) in rows.items() if q == p], [2, 4, 6][p % 3]))
    assert got == want and len(got) < len(rows)


def submissions(rng):
    """Submissions of some files, each of functions that others have, too, with blank lines and lines of their own."""
    words = "a b ( ) ; =".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
    functions = [[line() for _ in range(rng.randrange(3, 14))] for _ in range(9)] + [["a ( ) ;"] * 60]
    for no in range(26):
        files, fs, start = [], [], 2
        for f in range(rng.randrange(1, 4)):
            lines = ["", line()]
            for _ in range(rng.randrange(0, 4)):
                i = rng.randrange(len(functions))
                own = [x if rng.random() > 0.1 else rng.choice(["", "}", line()]) for x in functions[i]]
                at = start + len(lines)
                levels = {k: {str(1000 * i + rng.randrange(5)) for _ in range(n)} for k, n in (("method", 1), ("block", rng.randrange(3)), ("statement", 4))}
                fs.append({"start": at, "end": at + len(own) - 1 - rng.randrange(2), "func": f"f{rng.randrange(4)}", **levels})
                lines += own + [""] * rng.randrange(4)
            files.append((f"F{f}", "  " * (no % 2) + ("\n" + "  " * (no % 2)).join(lines)))
            start += len(lines) + 2
        yield files, sorted(fs, key=lambda f: (f["start"], f["end"], f["func"])) if no != 7 else [{**f, "start": 5 + i % 9, "end": 9 + i % 9, "func": f"g{i:02}"} for i, f in enumerate(fs * 70)]
    yield [], []


@pytest.mark.parametrize(("listed", "rows"), [(40, 30), (V.LISTED, V.ROWS)])
def test_evidence_of_parts_is_that_of_each_pair(monkeypatch, listed, rows):
    rng = random.Random(11)
    pack = lambda v, kind=np.int32: zlib.compress(np.array(v, kind).tobytes())
    table, sides = [], {}
    names = [f"s{i:02}" for i in range(27)]
    rng.shuffle(names)
    for no, (name, (files, fs)) in enumerate(zip(names, submissions(rng), strict=True)):
        src, start = [], 2
        for file, text in files:
            src += [{"at": start + i, "l": x, "meaningful": x.strip(" ") not in ("", *TRIVIAL_LINES), "file": file, "line": i + 1} for i, x in enumerate(text.split("\n"))]
            start += text.count("\n") + 3
        fs = sorted(fs, key=lambda f: (f["start"], f["end"], f["func"]))
        toks, at = zip(*((t, s["at"]) for s in src for t in s["l"].split()), strict=True) if src else ((), ())
        sides[name] = Y.Side({"toks": list(toks), "at": at, "src": src, "fs": fs}, {})
        mixed = rng.sample(fs, len(fs))
        hashes = [sorted(map(int, f[k])) for f in mixed for k in ("method", "block", "statement")]
        table.append({
            "assignment_id": "x", "rep": name, "student_id": f"u{no // 2}", "grp": None, "lang": "c", "norm": U.packed(list(toks)), "k": 8, "places": zlib.compress(b""), "at": pack(at), "code": pack(sides[name].code),
            "sizes": pack([len(h) for h in hashes]), "hashes": np.array([v for h in hashes for v in h], np.uint64).tobytes(), "files": [f for f, _ in files], "text": zlib.compress("\0".join(x for _, x in files).encode()),
            "spots": pack([(f["start"], f["end"]) for f in mixed]), "funcs": [f["func"] for f in mixed],
        })
    t = pa.Table.from_pylist(table, pa.schema([(c, pa.binary() if isinstance(v, bytes) else pa.list_(pa.string()) if isinstance(v, list) else pa.int32() if isinstance(v, int) else pa.string()) for c, v in table[0].items()]))
    told = np.random.default_rng(1).choice([0.2, 0.75, 0.92, 0.97], (len(t), len(t)))
    monkeypatch.setattr(V, "LISTED", listed)
    monkeypatch.setattr(V, "ROWS", rows)
    monkeypatch.setattr(D, "signals", lambda *_: None)
    seen = set()
    for x, y in ((t, t), (t.slice(0, 9), t.slice(9))):
        first, second = sorted(x["rep"].to_pylist()), sorted(y["rep"].to_pylist())
        score = told[: len(first), : len(second)]
        monkeypatch.setattr(Z, "base_scores", lambda _, score=score: score)
        got = [tuple(r.values()) for b in V.of_parts(x, y) for r in b.to_pylist()]
        want = []
        student = dict(zip(t["rep"].to_pylist(), t["student_id"].to_pylist(), strict=True))
        for i, n in enumerate(first):
            for k, m in enumerate(second):
                if student[n] != student[m] and (n < m or x is not y):
                    a, b = sorted((n, m))
                    want += [("x", *r) for r in Y.rows_of(a, b, sides[a], sides[b], Y.pair_evidence(sides[a], sides[b], score[i, k]))]
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 60
        seen |= {r[11] for r in got}
    assert seen == {"ast", "kgram12", "kgram8", "identical"}
