"""Queries of the general record operators: changed records and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesim.operators.changes import unread_uploads
from codesim.operators.nested import report_tables
from codesim.plans.catalogue import Catalogue
from codesim.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query

P4_SQL = """
WITH good AS (SELECT DISTINCT run_id FROM analysis_runs WHERE lower(trim(status)) = 'completed'),
rd AS (SELECT DISTINCT unnest(r.artifact_ids) AS artifact_id FROM analysis_runs r JOIN good g ON r.run_id = g.run_id),
cur AS (SELECT sub_id, artifact_id, row_number() OVER (PARTITION BY sub_id
          ORDER BY submitted_at DESC NULLS LAST, arrived_at DESC NULLS LAST, artifact_id DESC) AS rn
        FROM submissions WHERE artifact_id IS NOT NULL)
SELECT sub_id, artifact_id FROM cur WHERE rn = 1
  AND NOT EXISTS (SELECT 1 FROM rd WHERE rd.artifact_id = cur.artifact_id)
"""


@query(P4_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unread_uploads(table(spark, d, "submissions"), table(spark, d, "analysis_runs"))


P7_SQL = """
WITH raw AS (SELECT DISTINCT evidence_id, TRY_CAST(evidence_json AS JSON) AS j FROM similarity_evidence),
dec AS (SELECT evidence_id, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) ELSE j END AS j FROM raw WHERE j IS NOT NULL),
rep AS (SELECT evidence_id, coalesce(CASE WHEN json_type(j -> 'report') = 'OBJECT' THEN j -> 'report' END,
                 CASE WHEN json_type(j -> 'result' -> 'data') = 'OBJECT' THEN j -> 'result' -> 'data' END, j) AS r FROM dec),
lst AS (SELECT evidence_id, r -> 'matches' AS b, 'lineHighlightsA' AS fa, 'lineHighlightsB' AS fb FROM rep WHERE json_type(r) = 'OBJECT'
        UNION ALL SELECT evidence_id, r -> 'evidence', 'line_highlights_a', 'line_highlights_b' FROM rep WHERE json_type(r) = 'OBJECT'),
arr AS (SELECT evidence_id, fa, fb, CASE WHEN json_type(b) = 'ARRAY' THEN from_json(b, '["JSON"]') WHEN json_type(b) = 'OBJECT' THEN [b] END AS bs FROM lst),
blk AS (SELECT evidence_id, fa, fb, unnest(range(1, len(bs) + 1)) AS match_no, unnest(bs) AS m FROM arr WHERE bs IS NOT NULL),
sides AS (SELECT evidence_id, match_no, 'a' AS side, json_extract(m, '$.' || fa) AS ls FROM blk WHERE json_type(m) = 'OBJECT'
          UNION ALL SELECT evidence_id, match_no, 'b', json_extract(m, '$.' || fb) FROM blk WHERE json_type(m) = 'OBJECT'),
lines AS (SELECT evidence_id, match_no, side, unnest(from_json(ls, '["JSON"]')) AS l FROM sides WHERE json_type(ls) = 'ARRAY')
SELECT DISTINCT evidence_id, CAST(match_no AS INTEGER) AS match_no, side, CAST(l ->> '$' AS INTEGER) AS line_no
FROM lines WHERE json_type(l) <> 'NULL'
"""


@query(P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return report_tables(table(spark, d, "similarity_evidence"))["lines"]
