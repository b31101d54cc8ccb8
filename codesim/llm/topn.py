"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesim.session import unused

SALTS = 16


def top_n(df: DataFrame, group: list[str], item: str, order: list[Column], n: int, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, ties cut by ``item`` ascending; columns as in ``df``.

    Each group is hashed into ``salts`` subgroups by the item, which are ranked on their
    own (Spark cuts each at n before the shuffle as well as after), and only n rows of
    each reach the second ranking: no task sees more than salts * n rows of a group
    there, and a group of a third of all rows is spread over ``salts`` tasks before.
    A null group key is a group, null items come first. Groups smaller than n come out
    whole; n <= 0 gives no rows. Rows equal in order and item are cut in any order.
    """
    salt, rank = unused(df, "_salt"), unused(df, "_rank")
    last = F.col(item).asc_nulls_first()
    first = Window.partitionBy(*group, salt).orderBy(*order, last)
    second = Window.partitionBy(*group).orderBy(*order, last)
    kept = df.withColumn(salt, F.pmod(F.xxhash64(item), F.lit(salts))).withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n)
    return kept.withColumn(rank, F.row_number().over(second)).where(F.col(rank) <= n).drop(salt, rank)


def best_results(results: DataFrame, n: int = 10) -> DataFrame:
    """``run_id, result_id``: the first n results of each run by score descending, then result_id.

    Run ids are taken trimmed and in lower case. A result_id counts once per run, with its
    highest score; null scores, run ids and result ids are left out.
    """
    one = (
        results.select(F.lower(F.trim("run_id")).alias("run_id"), "result_id", "score")
        .where("score IS NOT NULL AND run_id IS NOT NULL AND result_id IS NOT NULL")
        .groupBy("run_id", "result_id").agg(F.max("score").alias("score"))
    )
    return top_n(one, ["run_id"], "result_id", [F.col("score").desc()], n).select("run_id", "result_id")
