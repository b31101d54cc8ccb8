"""Queries on stored courses' data: runs, results, submissions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesim.operators import records as O
from codesim.plans.catalogue import Catalogue
from codesim.plans.signals import RISK_SQL
from codesim.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query

_IDS = "lower(trim(run_id)) AS run_id, lower(trim(left_submission_id)) AS l, lower(trim(right_submission_id)) AS r"
RES_SQL = f"res AS (SELECT DISTINCT result_id, {_IDS}, left_upload_id, score, prof_comparison, created_at FROM similarity_results)"


def results(spark: SparkSession, d: str) -> DataFrame:
    """similarity_results with ids trimmed and in lower case."""
    clean = lambda c: F.lower(F.trim(c))
    return table(spark, d, "similarity_results").select("result_id", clean("run_id").alias("run_id"), clean("left_submission_id").alias("l"), clean("right_submission_id").alias("r"), "left_upload_id", "score", "prof_comparison", "created_at").distinct()


@query(f"""WITH {RES_SQL} SELECT least(l, r) AS a, greatest(l, r) AS b, result_id, score, created_at FROM res WHERE l IS NOT NULL AND r IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY created_at DESC NULLS LAST, result_id) = 1""")
def latest_per_pair(spark: SparkSession, d: str) -> DataFrame:
    """The newest result of each pair of submissions, whichever side is which."""
    res = results(spark, d).where("l IS NOT NULL AND r IS NOT NULL").withColumn("a", F.least("l", "r")).withColumn("b", F.greatest("l", "r"))
    return O.latest(res, [F.col("a"), F.col("b")], [F.desc_nulls_last("created_at"), F.asc("result_id")]).select("a", "b", "result_id", "score", "created_at")


@query(f"""WITH {RES_SQL} SELECT left_upload_id, r, result_id, score FROM res WHERE left_upload_id IS NOT NULL AND r IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY left_upload_id, r ORDER BY created_at DESC NULLS LAST, result_id) = 1""")
def latest_per_upload(spark: SparkSession, d: str) -> DataFrame:
    """The newest result of each stored upload against each submission."""
    res = results(spark, d).where("left_upload_id IS NOT NULL AND r IS NOT NULL")
    return O.latest(res, [F.col("left_upload_id"), F.col("r")], [F.desc_nulls_last("created_at"), F.asc("result_id")]).select("left_upload_id", "r", "result_id", "score")


@query("""SELECT assignment_id, run_id, engine_version, started_at FROM (SELECT DISTINCT assignment_id, run_id, engine_version, started_at FROM analysis_runs WHERE assignment_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY assignment_id ORDER BY started_at DESC NULLS LAST, run_id, engine_version) = 1""")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "analysis_runs").where("assignment_id IS NOT NULL").select("assignment_id", "run_id", "engine_version", "started_at").distinct()
    return O.latest(runs, [F.col("assignment_id")], [F.desc_nulls_last("started_at"), F.asc("run_id"), F.asc("engine_version")])


_SUB = "SELECT DISTINCT sub_id, assignment_id, student_id, artifact_id, submitted_at, arrived_at, status FROM submissions WHERE student_id IS NOT NULL AND assignment_id IS NOT NULL"
_ORDER = "submitted_at DESC NULLS LAST, arrived_at DESC NULLS LAST, artifact_id DESC NULLS LAST, sub_id, status"


def _subs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submissions").select("sub_id", "assignment_id", "student_id", "artifact_id", "submitted_at", "arrived_at", "status").where("student_id IS NOT NULL AND assignment_id IS NOT NULL").distinct()


def _newest() -> list:
    return [F.desc_nulls_last("submitted_at"), F.desc_nulls_last("arrived_at"), F.desc_nulls_last("artifact_id"), F.asc("sub_id"), F.asc("status")]


@query(f"""WITH s AS ({_SUB}), b AS (SELECT *, CASE WHEN status = 'accepted' THEN 0 ELSE 1 END AS nw FROM s)
SELECT sub_id, assignment_id, student_id, artifact_id, submitted_at FROM b QUALIFY row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY nw DESC, {_ORDER}) = 1""")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Accepted deliveries as stored, all others arriving: one row for each student and assignment, the newest arriving first."""
    s = _subs(spark, d)
    both = O.upsert(s.where("status = 'accepted'"), s.where("status <> 'accepted' OR status IS NULL"), ["student_id", "assignment_id"], _newest())
    return both.select("sub_id", "assignment_id", "student_id", "artifact_id", "submitted_at")


@query(f"""WITH s AS ({_SUB}), st AS (SELECT * FROM s WHERE status = 'accepted'), ar AS (SELECT * FROM s WHERE status <> 'accepted' QUALIFY row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY {_ORDER}) = 1)
SELECT sub_id, assignment_id, student_id, artifact_id, submitted_at, status FROM st UNION ALL SELECT sub_id, assignment_id, student_id, artifact_id, submitted_at, status FROM ar
WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.student_id = ar.student_id AND st.assignment_id = ar.assignment_id)""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    s = _subs(spark, d)
    out = O.insert_ignore(s.where("status = 'accepted'"), s.where("status <> 'accepted'"), ["student_id", "assignment_id"], _newest())
    return out.select("sub_id", "assignment_id", "student_id", "artifact_id", "submitted_at", "status")


@query("""WITH dead AS (SELECT DISTINCT assignment_id FROM assignments WHERE language IS NULL),
s AS (SELECT * FROM submissions x WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.assignment_id = x.assignment_id)), r AS (SELECT * FROM analysis_runs x WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.assignment_id = x.assignment_id))
SELECT 'assignments' AS t, count(*) AS n FROM assignments WHERE language IS NOT NULL UNION ALL SELECT 'submissions', count(*) FROM s UNION ALL SELECT 'analysis_runs', count(*) FROM r""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left when assignments without a language are deleted with all that refers to them."""
    left = O.delete_cascade(table(spark, d, "assignments"), F.col("language").isNull(), [(table(spark, d, t), "assignment_id") for t in ("submissions", "analysis_runs")], "assignment_id")
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, x in zip(("assignments", "submissions", "analysis_runs"), left)]
    return counts[0].union(counts[1]).union(counts[2])


@query("""WITH a AS (SELECT DISTINCT * FROM submissions WHERE has_comparison), b AS (SELECT * FROM (SELECT DISTINCT * FROM submissions) x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.assignment_id = x.assignment_id))
SELECT sub_id, artifact_id, submitted_at FROM b UNION ALL SELECT sub_id, artifact_id, submitted_at FROM a WHERE assignment_id IS NOT NULL""")
def replace_all(spark: SparkSession, d: str) -> DataFrame:
    """All rows of an assignment replaced by those that were compared, where there are such."""
    s = table(spark, d, "submissions").distinct()
    return O.replace_partition(s, s.where("has_comparison AND assignment_id IS NOT NULL"), "assignment_id").select("sub_id", "artifact_id", "submitted_at")


@query("SELECT sub_id, artifact_id, count(*) AS n FROM submissions GROUP BY sub_id, artifact_id HAVING count(*) > 1")
def uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    return O.repeated(table(spark, d, "submissions"), ["sub_id", "artifact_id"])


_A1 = "a1 AS (SELECT assignment_id, max(title) AS title, max(language) AS language FROM assignments GROUP BY assignment_id)"


def _assignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assignments").groupBy("assignment_id").agg(F.max("title").alias("title"), F.max("language").alias("language"))


@query(f"WITH {_A1} SELECT s.sub_id, s.path, s.arrived_at, a.title FROM (SELECT DISTINCT sub_id, path, arrived_at, assignment_id FROM submissions) s JOIN a1 a USING (assignment_id)")
def inner_join_listing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").select("sub_id", "path", "arrived_at", "assignment_id").distinct()
    return s.join(_assignments(spark, d), "assignment_id").select("sub_id", "path", "arrived_at", "title")


@query("""WITH s AS (SELECT DISTINCT sub_id, artifact_id FROM submissions), f AS (SELECT sub_id, count(*) AS files, sum(length(text)) AS characters FROM source_files GROUP BY sub_id)
SELECT s.sub_id, s.artifact_id, coalesce(f.files, 0) AS files, CAST(f.characters AS BIGINT) AS characters FROM s LEFT JOIN f USING (sub_id)""")
def left_join_listing(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").groupBy("sub_id").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("characters"))
    s = table(spark, d, "submissions").select("sub_id", "artifact_id").distinct()
    return s.join(f, "sub_id", "left").select("sub_id", "artifact_id", F.coalesce("files", F.lit(0)).alias("files"), "characters")


@query(f"""WITH {_A1}, s AS (SELECT DISTINCT assignment_id, sub_id FROM submissions WHERE assignment_id IS NOT NULL)
SELECT a.assignment_id, a.title, s.sub_id FROM a1 a LEFT JOIN s USING (assignment_id) ORDER BY a.assignment_id, s.sub_id NULLS FIRST""")
def parent_with_children(spark: SparkSession, d: str) -> DataFrame:
    """Each assignment with its submissions in order, one row a child, so no parent's children are gathered."""
    s = table(spark, d, "submissions").where("assignment_id IS NOT NULL").select("assignment_id", "sub_id").distinct()
    return _assignments(spark, d).join(s, "assignment_id", "left").select("assignment_id", "title", "sub_id").orderBy("assignment_id", "sub_id")


@query("SELECT DISTINCT run_id, a AS artifact_id FROM (SELECT run_id, unnest(artifact_ids) AS a FROM analysis_runs WHERE lower(trim(status)) = 'completed') WHERE a IN (SELECT artifact_id FROM submissions WHERE has_comparison)")
def id_list_filter(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that completed runs read and that are marked as compared: a list column filtered by a set of ids."""
    e = table(spark, d, "analysis_runs").where(F.lower(F.trim("status")) == "completed").select("run_id", F.explode("artifact_ids").alias("artifact_id"))
    return e.join(table(spark, d, "submissions").where("has_comparison").select("artifact_id"), "artifact_id", "left_semi").select("run_id", "artifact_id").distinct()


@query(f"WITH {RES_SQL} SELECT run_id, count(*) AS n, round(avg(CAST(score AS DOUBLE) * 100), 1) AS avg_score, count(*) FILTER (score >= 0.8) AS high FROM res WHERE run_id IS NOT NULL GROUP BY run_id")
def average_score(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).where("run_id IS NOT NULL")
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("double") * 100), 1).alias("avg_score"), F.count_if(F.col("score") >= 0.8).alias("high"))


@query(f"WITH {RES_SQL} SELECT DISTINCT unnest([l, r]) AS id FROM res WHERE score >= 0.8")
def high_risk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Submissions (and null for unknown sides) in results from 0.8 on."""
    return results(spark, d).where("score >= 0.8").select(F.explode(F.array("l", "r")).alias("id")).distinct()


@query(f"WITH {RES_SQL} SELECT result_id, CAST(score AS DOUBLE) AS score, {RISK_SQL.format('score')} AS risk FROM (SELECT DISTINCT result_id, score FROM res WHERE score IS NOT NULL)")
def risk_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = results(spark, d).where("score IS NOT NULL").select("result_id", "score").distinct()
    return s.select("result_id", F.col("score").cast("double").alias("score"), F.expr(RISK_SQL.format("score")).alias("risk"))


@query(f"WITH {RES_SQL} SELECT DISTINCT result_id, l, r, score FROM res WHERE score >= 0.6 AND NOT coalesce(l = r, false)")
def threshold_pairs(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).where("score >= 0.6 AND NOT coalesce(l = r, false)").select("result_id", "l", "r", "score").distinct()


@query(f"""WITH {RES_SQL}, e AS (SELECT DISTINCT result_id, block_id, a, b, file_a, a1, a2, match_strength FROM evidence)
SELECT result_id, count(*) AS blocks, count(DISTINCT file_a) AS files, min(a1) AS first_line, max(a2) AS last_line FROM e GROUP BY result_id""")
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").select("result_id", "block_id", "a", "b", "file_a", "a1", "a2", "match_strength").distinct()
    return e.groupBy("result_id").agg(F.count("*").alias("blocks"), F.count_distinct("file_a").alias("files"), F.min("a1").alias("first_line"), F.max("a2").alias("last_line"))


@query(f"""SELECT result_id, to_json({{'resultId': result_id, 'matches': list({{'block': block_id, 'severity': match_strength, 'fileA': file_a, 'linesA': [a1, a2]}} ORDER BY block_id)}}) AS report
FROM (SELECT block_id, result_id, max(match_strength) AS match_strength, max(file_a) AS file_a, max(a1) AS a1, max(a2) AS a2 FROM evidence WHERE result_id IS NOT NULL GROUP BY block_id, result_id) GROUP BY result_id""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """Each result's blocks as one JSON report."""
    e = table(spark, d, "evidence").where("result_id IS NOT NULL").groupBy("block_id", "result_id").agg(*[F.max(c).alias(c) for c in ("match_strength", "file_a", "a1", "a2")])
    m = F.struct(F.col("block_id").alias("block"), F.col("match_strength").alias("severity"), F.col("file_a").alias("fileA"), F.array("a1", "a2").alias("linesA"))
    return e.groupBy("result_id").agg(F.array_sort(F.collect_list(m)).alias("matches")).select("result_id", F.to_json(F.struct(F.col("result_id").alias("resultId"), "matches"), {"ignoreNullFields": "false"}).alias("report"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name""")
def multi_join(spark: SparkSession, d: str) -> DataFrame:
    """A chain of five joins; lines are summed by order before the joins, so the largest table is shuffled once."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    by = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"), F.sum("rev").alias("rev"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(by, F.col("c_custkey") == F.col("o_custkey"))
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.sum("lines").alias("lines"), F.sum("rev").alias("rev"))
    return g.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "customers", "orders", "lines", F.round("rev", 2).alias("revenue"))
