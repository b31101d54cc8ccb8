"""Results as Parquet, JSON and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How flags are called in reports.
LABELS = {
    "identifier_renaming": "Identifier renaming",
    "loop_type_swap": "Loop type swap",
    "literal_substitution": "Literal substitution",
    "dead_code_insertion": "Dead code insertion",
    "code_reordering": "Code reordering",
    "switch_to_ifelse": "Switch to if-else",
    "ternary_to_ifelse": "Ternary to if-else",
    "exception_wrapping": "Exception wrapping",
    "for_each_to_indexed": "For-each to indexed loop",
    "compound_op_expansion": "Compound operator expansion",
    "method_decomposition": "Method decomposition",
    "condition_negation": "Condition negation",
    "intermediate_variable": "Intermediate variable",
}


def label(flag: Column) -> Column:
    """A flag's name in reports; unknown flags keep their own."""
    return F.coalesce(*[F.when(flag == k, v) for k, v in LABELS.items()], flag)


def text_report(pairs: DataFrame) -> DataFrame:
    """``a, b, report`` of ``pairs(a, b, weighted_final, risk, flags array<string>)``."""
    flags = F.when(F.size("flags") > 0, F.array_join(F.transform("flags", label), ", ")).otherwise("none")
    line = F.format_string("%s ~ %s: %.1f%% (%s)\nTechniques: %s", "a", "b", F.col("weighted_final") * 100, "risk", flags)
    return pairs.select("a", "b", line.alias("report"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder a value of ``by``; rows are spread by a hash of all columns, so a giant value makes several files."""
    df.withColumn("_spread", F.pmod(F.xxhash64(*df.columns), F.lit(16))).repartition(by, "_spread").drop("_spread").write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)
