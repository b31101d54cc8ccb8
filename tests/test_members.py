"""Members of classes of copies."""

from codesim.operators import submissions as U


def test_members_are_told_and_copies_of_unknown_students_linked(spark):
    streams = spark.createDataFrame([(s, ["x", "y"]) for s in "abcdefgh"] + [("i", ["z"]), ("j", ["x", "y"])], "sub_id string, raw array<string>")
    streams = streams.selectExpr("sub_id", "raw", "raw AS norm")
    langs = spark.createDataFrame([(s, "java") for s in "abcdefghij"], "sub_id string, lang string")
    own = {"a": (None, None), "b": (None, None), "c": ("1", None), "d": ("1", None), "e": (None, "g"), "f": (None, "g"), "g": ("2", None), "h": (None, None), "i": (None, None)}
    subs = spark.createDataFrame([(s, "x", *o) for s, o in own.items()] + [("j", None, None, None)], "sub_id string, assignment_id string, student_id string, grp string")
    got = {r.sub_id: (r.rep, r.linked) for r in U.members(streams, langs, subs).collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "h": ("a", True), "c": ("c", False), "d": ("c", False), "e": ("e", False), "f": ("e", False), "g": ("g", False), "i": ("i", True)}
    assert {r.rep: r.members for r in U.classes(streams, langs, subs).collect()} == {"a": 3, "c": 2, "e": 2, "g": 1, "i": 1}


def test_class_members_is_registered_and_agrees_with_the_classes(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    got = entry.queries()["class_members"](spark, d).groupBy("rep").count().collect()
    assert {r.rep: r["count"] for r in got} == {r.rep: r.members for r in entry.queries()["submission_classes"](spark, d).collect()}
