"""Queries of the text and token operators, over all source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesim.functions import text as T
from codesim.functions import tokens as K
from codesim.operators import sources as S
from codesim.plans.catalogue import Catalogue
from codesim.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query


def files(spark: SparkSession, d: str) -> DataFrame:
    return S.source_files(table(spark, d, "source_files"))


def canon(spark: SparkSession, d: str) -> DataFrame:
    return S.canonical_files(files(spark, d))


def _rewrite(name: str, spark_text, duck_text: str) -> None:
    """A query that rewrites every file's text."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return files(spark, d).select("sub_id", "file", spark_text(F.col("text"), F.col("lang")).alias("text"))

    query(f"WITH {S.FILES_SQL} SELECT sub_id, file, {duck_text} AS text FROM files", name)(run)


_rewrite("newline_normalize", lambda t, _: T.apply_rules(t, T.NEWLINES), T.duck_rules("text", T.NEWLINES))
_rewrite("control_chars", lambda t, _: T.apply_rules(t, T.CONTROLS), T.duck_rules("text", T.CONTROLS))
_rewrite("trailing_ws", lambda t, _: T.apply_rules(t, T.NEWLINES + T.TRAILING), T.duck_rules("text", T.NEWLINES + T.TRAILING))
_rewrite("strip_comments", lambda t, lang: T.strip_comments(T.apply_rules(t, T.NEWLINES), lang), T.duck_strip_comments(T.duck_rules("text", T.NEWLINES), "lang"))
_rewrite("boilerplate_filter", lambda t, lang: T.without_imports(T.apply_rules(t, T.NEWLINES), lang), T.duck_without_imports(T.duck_rules("text", T.NEWLINES), "lang"))
_rewrite("io_blank", lambda t, lang: T.without_output(T.apply_rules(t, T.NEWLINES), lang), T.duck_without_output(T.duck_rules("text", T.NEWLINES), "lang"))
_rewrite("control_flow_normalize", lambda t, _: T.apply_rules(T.apply_rules(t, T.NEWLINES), T.CONTROL_FLOW), T.duck_rules(T.duck_rules("text", T.NEWLINES), T.CONTROL_FLOW))
_rewrite("header_blank", lambda t, _: T.apply_rules(T.apply_rules(t, T.NEWLINES), T.HEADER), T.duck_rules(T.duck_rules("text", T.NEWLINES), T.HEADER))
_rewrite("content_sniff", lambda t, _: T.sniffed(t), T.duck_sniffed("text"))


@query(f"WITH {S.CANONICAL_SQL} SELECT sub_id, file, lang, text FROM canon")
def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    return canon(spark, d)


TOKENS_SQL = f"{S.CANONICAL_SQL}, tok AS ({K.duck_tokens('canon', ['sub_id', 'file'])})"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return K.token_table(canon(spark, d), ["sub_id", "file"])


@query(f"WITH {TOKENS_SQL} SELECT sub_id, file, pos, line, raw FROM tok")
def tok_raw(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).drop("norm", "npos")


@query(f"WITH {TOKENS_SQL} SELECT sub_id, file, npos, line, norm FROM tok WHERE norm IS NOT NULL")
def tok_norm(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).where("norm IS NOT NULL").select("sub_id", "file", "npos", "line", "norm")


@query(f"WITH {TOKENS_SQL} SELECT sub_id, norm, count(*) AS n FROM tok WHERE norm IS NOT NULL GROUP BY sub_id, norm")
def tok_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).where("norm IS NOT NULL").groupBy("sub_id", "norm").agg(F.count("*").alias("n"))
