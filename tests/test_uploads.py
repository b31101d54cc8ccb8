"""Uploads above the limit."""

from codesim.sources import archives as A


def test_an_upload_above_the_limit_has_a_row(spark, tmp_path):
    with (tmp_path / "large.zip").open("wb") as f:
        f.truncate(A.Limits().archive + 1)
    (tmp_path / "A.java").write_text("class A {}")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in A.read_archives(spark, str(tmp_path)).collect()}
    assert rows["A.java"].status == "ok"
    assert rows["large.zip"].status == "failed" and rows["large.zip"].error.startswith("ZipTooLargeError") and rows["large.zip"].file is None
