"""The driver's contract."""

import importlib
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names
    assert {"batch_scores", "p4_found", "p7_found"} <= names


def test_core_does_not_need_llm(monkeypatch):
    real = importlib.import_module
    monkeypatch.setattr(importlib, "import_module", lambda n, *a: (_ for _ in ()).throw(ImportError(n)) if ".llm" in n else real(n, *a))
    assert "p6_found" not in entry.queries() and "p7_found" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["canonical_text", "tok_counts", "winnow", "fingerprint_pairs", "latest_per_pair", "p4_found", "p7_found", "severity_counts"])
def test_against_sql(spark, name):
    from tests.compare import duck, rows

    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(entry.oracle_sql()[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())
