"""Merkle trees, the change log and current uploads."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from codesim.operators import changes
from codesim.operators.changes import ChangeLog, changed_records, unread_uploads

SCHEMA = "k string, v string, _leaf string, node int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted(df.collect(), key=repr)


def test_added_changed_and_removed(spark):
    old = frame(spark, [(f"k{i}", "a", None, i) for i in range(50)])
    new = frame(spark, [(f"k{i}", "b" if i == 7 else "a", "x", -i) for i in range(1, 52)])
    found = changed_records(new, old, ["k"], ["v"])
    assert found.columns == ["k", "v", "_leaf", "node"]  # clashing names stay as they are
    assert {r.k for r in found.collect()} == {"k7", "k50", "k51"}


def test_nulls_repeats_and_empty_tables(spark):
    empty = frame(spark, [])
    rows = frame(spark, [(None, None, None, None), ("", None, None, None), (None, "x", None, None), ("a", "x" * 200_000, None, 1), ("a", "x" * 200_000, None, 1)])
    assert len(got(changed_records(rows, empty, ["k"], ["v"]))) == 5
    assert got(changed_records(empty, rows, ["k"], ["v"])) == []
    assert got(changed_records(empty, empty, ["k"], ["v"])) == []
    assert got(changed_records(rows, rows.limit(10), ["k"], ["v"])) == []
    left = changed_records(rows, rows.where("k IS NOT NULL"), ["k"], ["v"])
    assert {(r.k, r.v) for r in left.collect()} == {(None, None), (None, "x")}


def test_log_survives_a_failed_run(spark, tmp_path):
    root = str(tmp_path / "log")
    log = ChangeLog(spark, root, ["k"], ["v"])
    one = frame(spark, [(f"k{i}", "a", None, i) for i in range(30)])
    assert log.last() == 0
    assert log.run(one, lambda df: df) == 1
    assert spark.read.parquet(f"{root}/run-1/output").count() == 30

    two = frame(spark, [(f"k{i}", "b" if i == 3 else "a", None, i) for i in range(33)])

    def fails(df):
        raise RuntimeError("lost")

    for _ in range(2):
        try:
            log.run(two, fails)
        except RuntimeError:
            pass
    assert log.last() == 1
    assert log.run(two, lambda df: df.select("k")) == 2
    assert {r.k for r in spark.read.parquet(f"{root}/run-2/output").collect()} == {"k3", "k30", "k31", "k32"}
    three = two.union(frame(spark, [("new", "a", None, 0)]))
    log.run(three, lambda df: df)
    assert [r.k for r in spark.read.parquet(f"{root}/run-3/output").collect()] == ["new"]
    assert log.run(three, lambda df: df) == 4
    assert spark.read.parquet(f"{root}/run-4/output").count() == 0
    shutil.rmtree(root)


def test_unread_uploads(spark):
    t = [dt.datetime(2024, 1, i) for i in range(1, 10)]
    subs = spark.createDataFrame(
        [("s1", "u1", t[0], t[0]), ("s1", "u2", t[1], t[1]), ("s2", "u3", t[0], t[0]), ("s2", "u4", t[0], t[2]), ("s3", None, t[5], t[5]), ("s3", "u5", None, t[0]), ("s4", "u6", None, None), ("s4", "u6", None, None), (None, "u7", t[0], t[0])],
        "sub_id string, artifact_id string, submitted_at timestamp, arrived_at timestamp",
    )
    runs = spark.createDataFrame([("r1", " Completed", ["u1", "u4", None]), ("r1", "failed", ["u5"]), ("r2", "failed", ["u6"]), ("r3", None, ["u7"]), ("r4", "COMPLETED", None)], "run_id string, status string, artifact_ids array<string>")
    assert {tuple(r) for r in unread_uploads(subs, runs).collect()} == {("s1", "u2"), ("s4", "u6"), (None, "u7")}
    assert unread_uploads(subs.limit(0), runs).count() == 0
    assert unread_uploads(subs, runs.limit(0)).count() == 5
    assert unread_uploads(subs.withColumn("_row", F.lit(1)), runs.withColumn("node", F.lit(1))).count() == 3


def growing(spark, path):
    """A source read anew whenever it is evaluated."""
    import pandas as pd

    def rows(parts):
        for p in parts:
            if len(p):
                with open(path) as f:
                    yield pd.DataFrame([x.split("=") for x in f.read().split()], columns=["k", "v"])

    return spark.range(0, 1, 1, 1).mapInPandas(rows, "k string, v string")


def test_source_grows_during_the_run(spark, tmp_path):
    source, root = tmp_path / "source", str(tmp_path / "log")
    log = ChangeLog(spark, root, ["k"], ["v"])
    source.write_text(" ".join(f"k{i}=a" for i in range(20)))
    seen = []
    for n in range(1, 4):

        def work(df, n=n):
            source.write_text(source.read_text() + f" late{n}=a k{n}=b{n}")
            return df

        log.run(growing(spark, str(source)), work)
        seen += [(r.k, r.v) for r in spark.read.parquet(f"{root}/run-{n}/output").collect()]
    log.run(growing(spark, str(source)), lambda df: df)
    seen += [(r.k, r.v) for r in spark.read.parquet(f"{root}/run-4/output").collect()]
    assert len(seen) == len(set(seen))
    assert set(seen) == {(f"k{i}", "a") for i in range(20)} | {(f"late{n}", "a") for n in (1, 2, 3)} | {(f"k{n}", f"b{n}") for n in (1, 2, 3)}


def test_one_of_two_runs_at_once_is_published(spark, tmp_path):
    root = str(tmp_path / "log")
    log, other = (ChangeLog(spark, root, ["k"], ["v"]) for _ in range(2))
    one = frame(spark, [("a", "x", None, 1)])

    def overtaken(df):
        assert other.run(one, lambda d: d.select("k")) == 1
        return df

    try:
        log.run(one, overtaken)
        raise AssertionError
    except OSError:
        pass
    assert spark.read.parquet(f"{root}/run-1/output").columns == ["k"]
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["run-1"]


def test_depth_and_periods_follow_the_table(spark, tmp_path, monkeypatch):
    assert [changes.depth_for(n) for n in (0, 10, 4096 * 16, 4096 * 16 + 1, 10**11)] == [1, 1, 1, 2, 7] and changes.depth_for(10, True) == 9
    monkeypatch.setattr(changes, "LEAF_RECORDS", 2)
    monkeypatch.setattr(changes, "HOMES", 2)
    root = str(tmp_path / "log")
    log = ChangeLog(spark, root, ["k"], ["v"], by=("at", 86400))
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) if i % 7 else None
    rows = lambda n, v: spark.createDataFrame([(f"k{i}", v if i % 10 == 0 else "a", day(i)) for i in range(n)], "k string, v string, at timestamp")
    before = set()
    for step, (n, v) in enumerate([(20, "a"), (40, "a"), (200, "a"), (200, "b"), (210, "b"), (210, "b")], 1):
        now = {tuple(r) for r in rows(n, v).collect()}
        log.run(rows(n, v), lambda df: df)
        got_ = [tuple(r) for r in spark.read.parquet(f"{root}/run-{step}/output").collect()]
        assert len(got_) == len(set(got_)) and set(got_) == now - before
        before = now
    old, new = rows(100, "a"), rows(110, "a")
    a, b = (changes._marked(t, ["k"], ["v"], ("at", 86400)).withColumn("_leaf", changes._leaf(8)) for t in (new, old))
    assert changes.changed_leaves(changes.tree(a, 8), changes.tree(b, 8), 8).count() <= 2  # ten new records lie in one day, those without a time in another range
    assert changed_records(new, old, ["k"], ["v"], by=("at", 86400)).count() == 10
