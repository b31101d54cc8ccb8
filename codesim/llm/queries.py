"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesim.llm import components, leakage, residue, setjoin, spans, syntax, tokenizer, topn
from codesim.plans.catalogue import Catalogue
from codesim.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query

P1_SQL = """
WITH e AS (SELECT sub_id, 's' AS lv, unnest(statement) AS h FROM subtree_hashes
  UNION ALL SELECT sub_id, 'b', unnest(block) FROM subtree_hashes
  UNION ALL SELECT sub_id, 'm', unnest(method) FROM subtree_hashes),
s AS (SELECT DISTINCT sub_id, lv, lower(trim(h)) AS h FROM e WHERE h IS NOT NULL AND sub_id IS NOT NULL),
n AS (SELECT sub_id, count(*) AS n FROM s GROUP BY sub_id),
i AS (SELECT a.sub_id AS sub_a, b.sub_id AS sub_b, count(*) AS c FROM s a JOIN s b ON a.lv = b.lv AND a.h = b.h AND a.sub_id < b.sub_id GROUP BY 1, 2)
SELECT sub_a, sub_b FROM i JOIN n x ON x.sub_id = sub_a JOIN n y ON y.sub_id = sub_b WHERE 10 * c >= 7 * (x.n + y.n - c)
"""


@query(P1_SQL)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_records(table(spark, d, "subtree_hashes"))


P2_SQL = """
WITH RECURSIVE l AS (SELECT lower(trim(left_submission_id)) AS a, lower(trim(right_submission_id)) AS b FROM similarity_results WHERE score >= 0.80),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a)
SELECT v AS submission_id, min(w) AS group_id FROM r GROUP BY v
"""


@query(P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.linked_submissions(table(spark, d, "similarity_results"))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "source_files"), table(spark, d, "submissions"), table(spark, d, "assignments"))


@query()
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rates(table(spark, d, "source_files"), table(spark, d, "submissions"), table(spark, d, "assignments"))


P5_SQL = """
WITH t AS (SELECT 'code_a' AS field, block_id AS rec_id, result_id, code_a AS t FROM evidence
  UNION ALL SELECT 'code_b', block_id, result_id, code_b FROM evidence
  UNION ALL SELECT 'full_source_a', evidence_id, result_id, full_source_a FROM similarity_evidence),
u AS (SELECT DISTINCT * FROM t WHERE length(t) >= 200),
w AS (SELECT field, rec_id, result_id, t, unnest(range(1, length(t) - 198)) AS p FROM u),
h AS (SELECT field, rec_id, result_id, p, md5(t[p:p + 199]) AS h FROM w),
s AS (SELECT h FROM h GROUP BY h HAVING min(coalesce(result_id, '')) <> max(coalesce(result_id, ''))),
m AS (SELECT field, rec_id, p FROM h SEMI JOIN s USING (h)),
b AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY field, rec_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS n FROM m),
k AS (SELECT *, sum(n) OVER (PARTITION BY field, rec_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT field, rec_id, CAST(min(p) AS INTEGER) AS start_pos, CAST(max(p) + 199 AS INTEGER) AS end_pos FROM k GROUP BY field, rec_id, i
"""


@query(P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_code(table(spark, d, "evidence"), table(spark, d, "similarity_evidence"))


P6_SQL = """
WITH one AS (SELECT lower(trim(run_id)) AS run_id, result_id, max(score) AS score FROM similarity_results
             WHERE score IS NOT NULL AND run_id IS NOT NULL AND result_id IS NOT NULL GROUP BY 1, 2)
SELECT run_id, result_id FROM one
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, result_id) <= 10
"""


@query(P6_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_results(table(spark, d, "similarity_results"))


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encoded(table(spark, d, "documents"))


P9_SQL = r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT k, id, w, unnest(range(1, len(w) - 10)) AS p FROM t WHERE len(w) >= 12),
h AS (SELECT DISTINCT k, id, array_to_string(w[p:p + 11], ' ') AS s FROM g)
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM h a JOIN h b ON a.k = 'd' AND b.k = 'i' AND a.s = b.s
"""


@query(P9_SQL)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))
