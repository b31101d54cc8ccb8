"""Relational operators on stored runs, results and submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesim.session import unused


def latest(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row of ``df`` for each value of the keys (nulls are equal): the first in ``order``.

    Spark ranks within each partition before the shuffle, so of a key that holds a third of
    all rows only one row of each partition moves.
    """
    rank = unused(df, "_rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def unordered(a: str, b: str) -> list[Column]:
    """A pair without its order, as two keys."""
    return [F.least(a, b), F.greatest(a, b)]


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``stored`` with the arriving rows, one row a key: the arriving one if there is any, of several the first in ``order``."""
    new = unused(stored, "_new")
    both = stored.withColumn(new, F.lit(0)).unionByName(arriving.withColumn(new, F.lit(1)))
    return latest(both, [F.col(k) for k in keys], [F.desc(new), *order]).drop(new)


def insert_ignore(stored: DataFrame, arriving: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``stored`` with those arriving rows, one a key, whose key it lacks."""
    new = latest(arriving, [F.col(k) for k in keys], order)
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return stored.unionByName(new.join(known, same, "left_anti"))


def delete_cascade(parent: DataFrame, gone: Column, children: list[tuple[DataFrame, str]], key: str) -> list[DataFrame]:
    """The parent without the rows that are ``gone``, and each child (frame, its column) without rows that refer to them."""
    dead = parent.where(gone).select(F.col(key).alias("_dead")).distinct()
    return [parent.where(~F.coalesce(gone, F.lit(False))), *[c.join(dead, c[k] == F.col("_dead"), "left_anti") for c, k in children]]


def replace_partition(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """``stored`` with all rows of the arriving keys replaced by the arriving rows."""
    return stored.join(arriving.select(key).distinct(), key, "left_anti").unionByName(arriving)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, with their number: those that break uniqueness."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
