"""Queries that prepare texts and stored results for reports: concatenations, slices, states and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesim.functions import text as T
from codesim.operators import pairs as R
from codesim.operators import sources as S
from codesim.operators import structure as X
from codesim.plans.catalog import RES_SQL, results
from codesim.plans.catalogue import Catalogue
from codesim.plans.texts import canon, files
from codesim.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query(f"WITH {S.CANONICAL_SQL} SELECT sub_id, string_agg('# --- ' || file || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY lower(file), file) AS text FROM canon GROUP BY sub_id")
def canonical_concat(spark: SparkSession, d: str) -> DataFrame:
    """All canonical files of a submission as one text, by lower-case name: a line with the name before each, an empty one behind. Lines lie where canonical_offsets says."""
    part = F.concat(F.lit("# --- "), "file", F.lit(" ---\n"), "text", F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct(F.lower("file").alias("k"), "file", part.alias("t"))))
    return canon(spark, d).groupBy("sub_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


@query("""WITH p AS (SELECT sub_id, list_filter(string_split(replace(file, '\\', '/'), '/'), lambda x: x NOT IN ('', '.', '..')) AS p FROM source_files WHERE sub_id IS NOT NULL AND file IS NOT NULL),
m AS (SELECT sub_id, min(p[1:len(p) - 1]) AS lo, max(p[1:len(p) - 1]) AS hi FROM p WHERE len(p) > 0 GROUP BY sub_id)
SELECT sub_id, array_to_string(lo[1:len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i]))], '/') AS prefix FROM m""")
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The folders that all files of a submission lie in. What the least and the greatest path share, all share."""
    parts = F.filter(F.split(F.translate("file", "\\", "/"), "/"), lambda x: ~x.isin("", ".", ".."))
    p = table(spark, d, "source_files").where("sub_id IS NOT NULL AND file IS NOT NULL").select("sub_id", parts.alias("p")).where(F.size("p") > 0)
    m = p.withColumn("p", F.slice("p", F.lit(1), F.size("p") - 1)).groupBy("sub_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    n = F.least(F.size("lo"), F.size("hi"))
    shared = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i)))).otherwise(0)
    return m.select("sub_id", F.array_join(F.slice("lo", F.lit(1), shared), "/").alias("prefix"))


_COLLAPSE = [*T.TRAILING, T.Rule(r"\n{3,}", "\n\n"), T.Rule(r"\A\s+|\s+\z")]
_SLICE = "array_to_string(string_split({0}, chr(10))[a1:a2], chr(10))".format(T.duck_rules("src", T.NEWLINES))


@query(f"""WITH s AS (SELECT result_id, first(full_source_a ORDER BY evidence_id) AS src FROM (SELECT DISTINCT evidence_id, result_id, full_source_a FROM similarity_evidence WHERE full_source_a IS NOT NULL) GROUP BY result_id),
b AS (SELECT DISTINCT block_id, result_id, file_a, a1, a2 FROM evidence WHERE a1 >= 1 AND a2 >= a1 AND file_a IS NOT NULL),
c AS (SELECT block_id, result_id, a1, a2, {T.duck_file_lang('file_a', 'src')} AS lang, {_SLICE} AS code FROM b JOIN s USING (result_id))
SELECT block_id, result_id, a1, a2, {T.duck_rules(T.duck_strip_comments('code', 'lang'), _COLLAPSE)} AS code FROM c""")
def code_slices(spark: SparkSession, d: str) -> DataFrame:
    """The lines of side A that a block names, from its result's source: comments out, ends of lines trimmed, runs of blank lines made one."""
    s = table(spark, d, "similarity_evidence").where("full_source_a IS NOT NULL").groupBy("result_id").agg(F.min(F.struct("evidence_id", "full_source_a")).alias("s")).select("result_id", F.col("s.full_source_a").alias("src"))
    b = table(spark, d, "evidence").where("a1 >= 1 AND a2 >= a1 AND file_a IS NOT NULL").select("block_id", "result_id", "file_a", "a1", "a2").distinct()
    c = b.join(s, "result_id").withColumn("lang", T.file_lang(F.col("file_a"), F.col("src")))
    code = F.array_join(F.slice(F.split(T.apply_rules(F.col("src"), T.NEWLINES), "\n", -1), F.col("a1"), F.col("a2") - F.col("a1") + 1), "\n")
    return c.select("block_id", "result_id", "a1", "a2", T.apply_rules(T.strip_comments(code, F.col("lang")), _COLLAPSE).alias("code"))


UPLOADS = 0.7  # containment from which an upload and a submission are a pair


@query(f"""WITH e AS (SELECT sub_id, origin, 'm' AS lv, unnest(method) AS h FROM subtree_hashes UNION ALL SELECT sub_id, origin, 'b', unnest(block) FROM subtree_hashes UNION ALL SELECT sub_id, origin, 's', unnest(statement) FROM subtree_hashes),
s AS (SELECT DISTINCT sub_id, origin, lv, lower(trim(h)) AS h FROM e WHERE h IS NOT NULL AND sub_id IS NOT NULL AND origin IN ('upload', 'submission')), n AS (SELECT sub_id, origin, count(*) AS n FROM s GROUP BY 1, 2),
i AS (SELECT u.sub_id AS upload, t.sub_id AS sub_id, count(*) AS c FROM s u JOIN s t ON u.origin = 'upload' AND t.origin = 'submission' AND u.lv = t.lv AND u.h = t.h GROUP BY 1, 2)
SELECT upload, i.sub_id, CAST(c AS INTEGER) AS shared, floor(c / least(x.n, y.n) * 1e6 + 0.5) / 1e6 AS containment FROM i JOIN n x ON x.sub_id = upload AND x.origin = 'upload' JOIN n y ON y.sub_id = i.sub_id AND y.origin = 'submission' WHERE c >= {UPLOADS} * least(x.n, y.n) - 1e-9""")
def upload_matches(spark: SparkSession, d: str) -> DataFrame:
    """Stored uploads against submissions: pairs that share UPLOADS of the smaller side's structural hashes, by their rarest hashes."""
    rows = table(spark, d, "subtree_hashes").where("sub_id IS NOT NULL AND origin IN ('upload', 'submission')")
    of = lambda level: F.transform(F.coalesce(level, F.array().cast("array<string>")), lambda x: F.concat(F.lit(level[0] + ":"), F.lower(F.trim(x))))
    tagged = F.concat(*map(of, R.LEVELS))
    own = F.concat_ws(":", F.substring("origin", 1, 1), "sub_id")
    sets = rows.select(own.alias("rep"), F.explode(tagged).alias("e")).where("e IS NOT NULL").groupBy("rep").agg(F.collect_set("e").alias("set")).withColumn("all", F.lit(0))
    p = R.containment_pairs(sets, "all", "rep", "set", UPLOADS).where("substring(a, 1, 1) <> substring(b, 1, 1)")  # a is the submission
    name = lambda c: F.substring(c, 3, 1 << 20)
    return p.select(name("b").alias("upload"), name("a").alias("sub_id"), "shared", R.rounded(F.col("shared") / F.least("na", "nb"), 6).alias("containment"))


_DONE = "SELECT DISTINCT lower(trim(run_id)) AS run_id FROM analysis_runs WHERE lower(trim(status)) = 'completed' AND run_id IS NOT NULL"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Submissions on a side of a result of a completed run."""
    done = table(spark, d, "analysis_runs").where(F.lower(F.trim("status")) == "completed").select(F.lower(F.trim("run_id")).alias("run_id"))
    return results(spark, d).join(done, "run_id", "left_semi").select(F.explode(F.array("l", "r")).alias("k")).where("k IS NOT NULL").distinct()


@query(f"""WITH {RES_SQL}, done AS ({_DONE}), c AS (SELECT DISTINCT unnest([l, r]) AS k FROM res WHERE run_id IN (SELECT run_id FROM done))
SELECT DISTINCT sub_id, coalesce(lower(trim(sub_id)) IN (SELECT k FROM c WHERE k IS NOT NULL), false) AS has_comparison FROM submissions""")
def mark_compared(spark: SparkSession, d: str) -> DataFrame:
    """Each submission with its mark as it should be: is it a side of a result of a completed run? (A null id is none.)"""
    s = table(spark, d, "submissions").select("sub_id").distinct().withColumn("k", F.lower(F.trim("sub_id")))
    return s.join(_compared(spark, d).withColumn("hit", F.lit(True)), "k", "left").select("sub_id", F.coalesce("hit", F.lit(False)).alias("has_comparison"))


@query(f"""WITH {RES_SQL}, done AS ({_DONE}), c AS (SELECT DISTINCT unnest([l, r]) AS k FROM res WHERE run_id IN (SELECT run_id FROM done)), s AS (SELECT DISTINCT assignment_id, sub_id FROM submissions WHERE assignment_id IS NOT NULL)
SELECT assignment_id, count(*) AS submissions, count(*) FILTER (lower(trim(sub_id)) IN (SELECT k FROM c WHERE k IS NOT NULL)) AS with_reports FROM s GROUP BY assignment_id""")
def submissions_with_reports(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions").where("assignment_id IS NOT NULL").select("assignment_id", "sub_id").distinct().withColumn("k", F.lower(F.trim("sub_id")))
    hit = s.join(_compared(spark, d).withColumn("hit", F.lit(True)), "k", "left")
    return hit.groupBy("assignment_id").agg(F.count("*").alias("submissions"), F.count("hit").alias("with_reports"))


#: States of runs, that which outlives the others first.
STATES = ("completed", "failed", "running", "pending")


@query(f"""SELECT lower(trim(run_id)) AS run_id, {'CASE ' + ' '.join(f"WHEN bool_or(lower(trim(status)) = '{s}') THEN '{s}'" for s in STATES) + " ELSE min(lower(trim(status))) END"} AS status, count(DISTINCT status) AS states, max(completed_at) AS completed_at
FROM analysis_runs WHERE run_id IS NOT NULL GROUP BY 1""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """One state a run, of all that its rows tell."""
    state = F.lower(F.trim("status"))
    merged = F.min(state)
    for s in reversed(STATES):
        merged = F.when(F.bool_or(state == s), s).otherwise(merged)
    return table(spark, d, "analysis_runs").where("run_id IS NOT NULL").groupBy(F.lower(F.trim("run_id")).alias("run_id")).agg(merged.alias("status"), F.count_distinct("status").alias("states"), F.max("completed_at").alias("completed_at"))


@query(f"""WITH {RES_SQL}, side AS (SELECT l AS sub_id, r AS other, score, result_id, run_id FROM res WHERE l IS NOT NULL UNION SELECT r, l, score, result_id, run_id FROM res WHERE r IS NOT NULL)
SELECT sub_id, count(*) AS results, count(DISTINCT other) AS others, max(score) AS best, count(*) FILTER (score >= 0.8) AS high FROM side WHERE NOT coalesce(sub_id = other, false) GROUP BY sub_id""")
def either_side(spark: SparkSession, d: str) -> DataFrame:
    """The results of each submission, whichever side it is on. Counts are combined before the shuffle."""
    r = results(spark, d)
    sides = [r.where(f"{x} IS NOT NULL").select(F.col(x).alias("sub_id"), F.col(y).alias("other"), "score", "result_id", "run_id") for x, y in (("l", "r"), ("r", "l"))]
    both = sides[0].union(sides[1]).distinct().where("NOT coalesce(sub_id = other, false)")
    return both.groupBy("sub_id").agg(F.count("*").alias("results"), F.count_distinct("other").alias("others"), F.max("score").alias("best"), F.count_if(F.col("score") >= 0.8).alias("high"))


@query(f"""WITH {RES_SQL}, a AS (SELECT assignment_id, max(title) AS title FROM assignments GROUP BY assignment_id),
s AS (SELECT assignment_id, sub_id, max(student_id) AS student_id, max(submitted_at) AS submitted_at FROM submissions WHERE assignment_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT result_id, l AS k, score FROM res WHERE l IS NOT NULL UNION SELECT result_id, r, score FROM res WHERE r IS NOT NULL), e AS (SELECT result_id, count(DISTINCT block_id) AS blocks FROM evidence GROUP BY result_id),
b AS (SELECT k, max(score) AS best, sum(blocks) AS blocks FROM (SELECT DISTINCT k, result_id, score, coalesce(blocks, 0) AS blocks FROM p LEFT JOIN e USING (result_id)) GROUP BY k)
SELECT s.assignment_id, a.title, s.sub_id, s.student_id, s.submitted_at, b.best, CAST(coalesce(b.blocks, 0) AS BIGINT) AS blocks FROM s LEFT JOIN a USING (assignment_id) LEFT JOIN b ON b.k = lower(trim(s.sub_id))""")
def assignment_view(spark: SparkSession, d: str) -> DataFrame:
    """Each submission of an assignment with its student, best score and number of evidence blocks: a join of four tables, each summed up before it."""
    a = table(spark, d, "assignments").groupBy("assignment_id").agg(F.max("title").alias("title"))
    s = table(spark, d, "submissions").where("assignment_id IS NOT NULL").groupBy("assignment_id", "sub_id").agg(F.max("student_id").alias("student_id"), F.max("submitted_at").alias("submitted_at"))
    e = table(spark, d, "evidence").groupBy("result_id").agg(F.count_distinct("block_id").alias("blocks"))
    p = results(spark, d).select("result_id", F.explode(F.array("l", "r")).alias("k"), "score").where("k IS NOT NULL").distinct()
    b = p.join(e, "result_id", "left").groupBy("k").agg(F.max("score").alias("best"), F.sum(F.coalesce("blocks", F.lit(0))).alias("blocks"))
    joined = s.join(a, "assignment_id", "left").withColumn("k", F.lower(F.trim("sub_id"))).join(b, "k", "left")
    return joined.select("assignment_id", "title", "sub_id", "student_id", "submitted_at", "best", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query()
def function_prints(spark: SparkSession, d: str) -> DataFrame:
    """Winnowed fingerprints of each function by itself, in grams as long as the function's size asks."""
    return X.function_prints(files(spark, d))
