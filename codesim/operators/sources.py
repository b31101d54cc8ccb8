"""The file relation of the engine, from stored source files or from archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesim.functions import text as T
from codesim.session import parallelism


def source_files(rows: DataFrame) -> DataFrame:
    """``sub_id, file, lang, text``: one row for each file of a submission (the least file_id of rows that repeat one), rows without any of the three left out."""
    known = rows.where("sub_id IS NOT NULL AND file IS NOT NULL AND text IS NOT NULL").select("file_id", "sub_id", "file", "text")
    # one exchange that later steps by sub_id and by (sub_id, file) reuse, and that is not coalesced by the texts' few bytes
    known = known.repartition(parallelism(rows.sparkSession), "sub_id")
    one = known.groupBy("sub_id", "file").agg(F.min(F.struct("file_id", "text")).alias("r"))
    return one.select("sub_id", "file", T.file_lang(F.col("file"), F.col("r.text")).alias("lang"), F.col("r.text").alias("text"))


FILES_SQL = f"""files AS (SELECT sub_id, file, {T.duck_file_lang('file', 'text')} AS lang, text FROM (
  SELECT sub_id, file, first(text ORDER BY file_id, text) AS text FROM source_files WHERE sub_id IS NOT NULL AND file IS NOT NULL AND text IS NOT NULL GROUP BY sub_id, file))"""


def canonical_files(files: DataFrame) -> DataFrame:
    """``files`` with their canonical texts."""
    return files.withColumn("text", T.canonical(F.col("text"), F.col("lang")))


CANONICAL_SQL = (
    FILES_SQL
    + f""", c1 AS (SELECT sub_id, file, lang, {T.duck_rules('text', T.NEWLINES + T.CONTROLS)} AS text FROM files),
c2 AS (SELECT sub_id, file, lang, {T.duck_strip_comments('text', 'lang')} AS text FROM c1),
c3 AS (SELECT sub_id, file, lang, {T.duck_without_imports('text', 'lang')} AS text FROM c2),
c4 AS (SELECT sub_id, file, lang, {T.duck_rules('text', T.CONTROL_FLOW + T.TRAILING)} AS text FROM c3),
canon AS (SELECT sub_id, file, lang, {T.duck_without_output('text', 'lang')} AS text FROM c4)"""
)
