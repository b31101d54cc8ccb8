"""Checkpoints in the session's folder."""

import os
from urllib.parse import urlparse

from codesim.session import checkpointed, forget


def test_checkpoints_are_kept_and_removed(spark):
    kept = checkpointed(spark.range(10).selectExpr("id", "id % 3 AS k"))
    assert kept.where("k = 0").count() == 4
    folder = urlparse(kept._checkpoint.get()).path
    assert os.path.isdir(folder)
    forget(kept, None, spark.range(1))
    assert not os.path.exists(folder)
