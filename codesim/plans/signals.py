"""Queries of pairs, signals, rules and the batch report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesim.functions import text as T
from codesim.functions.fingerprints import hashed
from codesim.operators import blocks as B
from codesim.operators import disguise as D
from codesim.operators import pairs as R
from codesim.operators import rules as Q
from codesim.operators import submissions as U
from codesim.plans import prints as W
from codesim.plans.catalogue import Catalogue
from codesim.plans.texts import files
from codesim.session import checkpointed
from codesim.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query

LEAST = 0.7  # containment of winnowed fingerprints from which fingerprint_pairs has a pair


def classes(spark: SparkSession, d: str, *kept: str) -> DataFrame:
    """Classes of submissions with equal streams, of which those ``kept`` (normalised ones else) are columns; ``rep`` stands for each. Written once, as all that follows reads it."""
    return checkpointed(U.classes(W.stream_table(spark, d), None, table(spark, d, "submissions"), kept or ("norm",)))


def pairs(cls: DataFrame, winnowed: DataFrame) -> DataFrame:
    """``assignment_id, a, b, shared, na, nb, jaccard, containment`` of the pairs that count and share LEAST."""
    sets = cls.join(winnowed.select("rep", "set"), "rep").select("assignment_id", "rep", "set")
    p = R.containment_pairs(sets, "assignment_id", "rep", "set", LEAST, cls)
    side = lambda s: cls.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("student_id", "grp", "lang")])
    p = p.join(side("a"), "a").join(side("b"), "b").where(R.allowed())
    i, na, nb = F.col("shared"), F.col("na"), F.col("nb")
    return p.select("assignment_id", "a", "b", "shared", "na", "nb", R.jaccard(i, na, nb).alias("jaccard"), R.containment(i, na, nb).alias("containment"))


SHARED_SQL = f"""{U.BASE_SQL}, {U.CLASS_SQL}, {W.WINNOW_SQL},
wset AS (SELECT DISTINCT c.assignment_id, w.sub_id AS rep, w.k, w.hash FROM winnow w JOIN cls c ON c.rep = w.sub_id),
wn AS (SELECT assignment_id, rep, count(*) AS n FROM wset GROUP BY 1, 2),
sh AS (SELECT p.assignment_id, p.rep AS a, q.rep AS b, count(*) AS shared FROM wset p JOIN wset q ON p.assignment_id = q.assignment_id AND p.k = q.k AND p.hash = q.hash AND p.rep < q.rep GROUP BY 1, 2, 3)"""
#: Every pair that counts, whatever it shares.
PAIR_SQL = f"""{SHARED_SQL},
pair AS (SELECT x.assignment_id, x.rep AS a, y.rep AS b, coalesce(shared, 0) AS shared, coalesce(m.n, 0) AS na, coalesce(n.n, 0) AS nb,
  CASE WHEN m.n IS NULL AND n.n IS NULL THEN 1.0 ELSE coalesce(shared, 0) / (coalesce(m.n, 0) + coalesce(n.n, 0) - coalesce(shared, 0)) END AS jaccard,
  CASE WHEN m.n IS NULL AND n.n IS NULL THEN 1.0 WHEN m.n IS NULL OR n.n IS NULL THEN 0.0 ELSE coalesce(shared, 0) / least(m.n, n.n) END AS containment
  FROM cls x JOIN cls y ON x.assignment_id = y.assignment_id AND x.rep < y.rep LEFT JOIN sh ON sh.assignment_id = x.assignment_id AND sh.a = x.rep AND sh.b = y.rep
  LEFT JOIN wn m ON m.assignment_id = x.assignment_id AND m.rep = x.rep LEFT JOIN wn n ON n.assignment_id = x.assignment_id AND n.rep = y.rep WHERE {R.DUCK_ALLOWED})"""
#: Those that share LEAST.
CLOSE_SQL = f"""{SHARED_SQL},
pair AS (SELECT sh.assignment_id, sh.a, sh.b, shared, m.n AS na, n.n AS nb, shared / (m.n + n.n - shared) AS jaccard, shared / least(m.n, n.n) AS containment
  FROM sh JOIN wn m ON m.assignment_id = sh.assignment_id AND m.rep = sh.a JOIN wn n ON n.assignment_id = sh.assignment_id AND n.rep = sh.b
  JOIN cls x ON x.rep = sh.a AND x.assignment_id = sh.assignment_id JOIN cls y ON y.rep = sh.b AND y.assignment_id = sh.assignment_id
  WHERE shared >= {LEAST} * least(m.n, n.n) - 1e-9 AND {R.DUCK_ALLOWED})"""


@query(f"WITH {U.BASE_SQL}, {U.CLASS_SQL} SELECT rep, members, assignment_id, student_id, grp, lang FROM cls")
def submission_classes(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).select("rep", "members", "assignment_id", "student_id", "grp", "lang")


@query()
def class_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each submission, by which pairs of representatives stand for those of all members; copies of unknown students are linked."""
    return U.members(W.stream_table(spark, d), None, table(spark, d, "submissions"))


@query(f"WITH {CLOSE_SQL} SELECT assignment_id, a, b, CAST(shared AS INTEGER) AS shared, CAST(na AS INTEGER) AS na, CAST(nb AS INTEGER) AS nb, {R.duck_rounded('jaccard', 6)} AS jaccard, {R.duck_rounded('containment', 6)} AS containment FROM pair")
def fingerprint_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs within an assignment that count and share LEAST of the smaller side's fingerprints."""
    cls = classes(spark, d)
    p = pairs(cls, hashed(cls, "norm", W.WINNOWED))
    return p.withColumn("jaccard", R.rounded(F.col("jaccard"), 6)).withColumn("containment", R.rounded(F.col("containment"), 6))


@query(f"WITH {U.BASE_SQL}, {U.CLASS_SQL} SELECT assignment_id, count(*) AS submissions, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS total_pairs FROM stream JOIN owner USING (sub_id) WHERE assignment_id IS NOT NULL GROUP BY assignment_id")
def total_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = classes(spark, d).groupBy("assignment_id").agg(F.sum("members").alias("submissions"))
    return n.withColumn("total_pairs", (F.col("submissions") * (F.col("submissions") - 1) / 2).cast("bigint"))


STRUCT_SQL = """sh0 AS (SELECT sub_id, 'method' AS level, unnest(method) AS h FROM subtree_hashes WHERE origin = 'submission' UNION ALL SELECT sub_id, 'block', unnest(block) FROM subtree_hashes WHERE origin = 'submission' UNION ALL SELECT sub_id, 'statement', unnest(statement) FROM subtree_hashes WHERE origin = 'submission'),
sth AS (SELECT DISTINCT sub_id, level, lower(trim(h)) AS h FROM sh0 WHERE h IS NOT NULL AND sub_id IS NOT NULL), stn AS (SELECT sub_id, level, count(*) AS n FROM sth GROUP BY 1, 2), sts AS (SELECT DISTINCT sub_id FROM sth),
sti AS (SELECT p.a, p.b, level, count(*) AS i FROM pair p JOIN sth x ON x.sub_id = p.a JOIN sth y USING (level, h) WHERE y.sub_id = p.b GROUP BY 1, 2, 3),
lvl AS (SELECT i.a, i.b, i.level, i.i / least(m.n, n.n) AS c FROM sti i JOIN stn m ON m.sub_id = a AND m.level = i.level JOIN stn n ON n.sub_id = b AND n.level = i.level),
ast AS (SELECT p.a, p.b, floor(least(1.0, CAST(0.5 AS DOUBLE) * coalesce(max(CASE WHEN level = 'method' THEN c END), 0.0) + CAST(0.3 AS DOUBLE) * coalesce(max(CASE WHEN level = 'block' THEN c END), 0.0) + CAST(0.2 AS DOUBLE) * coalesce(max(CASE WHEN level = 'statement' THEN c END), 0.0)) * 1e6 + 0.5) / 1e6 AS ast_subtree
  FROM pair p JOIN sts s ON s.sub_id = p.a JOIN sts t ON t.sub_id = p.b LEFT JOIN lvl USING (a, b) GROUP BY p.a, p.b)"""

SCORE_SQL = f"""{PAIR_SQL}, {STRUCT_SQL},
tc AS (SELECT sub_id, tok, count(*) AS n FROM stok WHERE variant = 'norm' GROUP BY 1, 2),
tn AS (SELECT sub_id, sum((1 + ln(n)) * (1 + ln(n))) AS c2, sum(CASE WHEN tok IN {U.sql_list(R.STRUCTURAL)} THEN n * n END) AS s2 FROM tc GROUP BY 1),
dots AS (SELECT p.a, p.b, sum((1 + ln(x.n)) * (1 + ln(y.n))) AS dot, sum(CASE WHEN x.tok IN {U.sql_list(R.STRUCTURAL)} THEN x.n * y.n END) AS sdot FROM pair p JOIN tc x ON x.sub_id = p.a JOIN tc y ON y.sub_id = p.b AND y.tok = x.tok GROUP BY 1, 2),
sig AS (SELECT p.*, coalesce(dot / sqrt(m.c2 * n.c2), 0.0) AS cosine, coalesce(sdot / sqrt(m.s2 * n.s2), 0.0) AS structural, ast_subtree, ast.a IS NOT NULL AS has_ast, true AS has_tokens
  FROM pair p LEFT JOIN dots d USING (a, b) LEFT JOIN tn m ON m.sub_id = p.a LEFT JOIN tn n ON n.sub_id = p.b LEFT JOIN ast USING (a, b)),
score AS (SELECT * FROM sig)"""


def sides(spark: SparkSession, d: str, flagged: bool = False, dependence: bool = False, lines: bool = False, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sides of all submissions (``disguise.read_sides``), and the owners that tell how many an assignment has."""
    numbers = lambda c: F.transform(F.filter(c, lambda h: h.isNotNull()), lambda h: F.xxhash64(F.lower(F.trim(h))))
    rows = table(spark, d, "subtree_hashes").where("origin = 'submission' AND sub_id IS NOT NULL")
    lists = rows.select("sub_id", *[numbers(F.col(level)).alias(level) for level in R.LEVELS]).groupBy("sub_id").agg(*[F.array_distinct(F.flatten(F.collect_list(level))).alias(f"lv_{level}") for level in R.LEVELS])
    levels = lists.where(" + ".join(f"size(lv_{level})" for level in R.LEVELS) + " > 0").withColumn("has_ast", F.lit(True))
    owners = checkpointed(U.owners(table(spark, d, "submissions")).where("assignment_id IS NOT NULL"))
    return D.read_sides(files(spark, d), T.canonical(F.col("text"), F.col("lang")), owners, levels, flagged, dependence, lines, whole), owners


def scored(spark: SparkSession, d: str, flagged: bool = False, dependence: bool = False) -> DataFrame:
    """All pairs within an assignment that count, whatever they share, with all signals and the base score; with the flags that call for dependence graphs if asked for, and those graphs' similarity."""
    return D.all_scores(*sides(spark, d, flagged, dependence)).withColumn("weighted_final", R.base_score(F.col("ast_subtree").isNotNull(), F.lit(True)))


SIGNALS = ("jaccard", "containment", "cosine", "structural", "ast_subtree", "method_pair")
SQL_SIGNALS = SIGNALS[:-1]
_ROUNDED = ", ".join(f"{R.duck_rounded(s)} AS {s}" for s in SQL_SIGNALS)


def _rounded(df: DataFrame) -> DataFrame:
    return reduce(lambda x, s: x.withColumn(s, R.rounded(F.col(s))), SIGNALS, df)


@query(f"WITH {SCORE_SQL} SELECT assignment_id, a, b, {_ROUNDED} FROM score")
def pair_signals(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that counts with the signals that SQL can express: all but the best match of methods."""
    return _rounded(scored(spark, d)).select("assignment_id", "a", "b", *SQL_SIGNALS)


@query()
def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    """The batch comparison: every pair that counts with its signals and base score. SQL has no methods to match; ``pair_signals`` has the rest."""
    return _rounded(scored(spark, d))


RISK = [(0.85, "CRITICAL"), (0.65, "HIGH"), (0.40, "MEDIUM")]
RISK_SQL = "CASE " + " ".join(f"WHEN {{0}} >= {t} THEN '{name}'" for t, name in RISK) + " ELSE 'LOW' END"


@query()
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The five pairs with the highest base score, with tier, percentage and place."""
    s = scored(spark, d)
    best = s.orderBy(F.desc("weighted_final"), "a", "b").limit(5)
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("weighted_final"), "a", "b")  # of five rows
    tier = reduce(lambda e, x: F.when(F.col("weighted_final") >= x[0], x[1]).otherwise(e), reversed(RISK), F.lit("LOW"))
    return best.select("a", "b", "weighted_final", tier.alias("risk"), F.concat((F.col("weighted_final") * 100).cast("decimal(7,2)").cast("decimal(6,1)").cast("string"), F.lit("%")).alias("percent"), F.row_number().over(w).cast("bigint").alias("place"))


_H8 = W.HASH_SQL.replace("WHERE variant = 'norm'", "WHERE true").replace("PARTITION BY sub_id ORDER BY spos", "PARTITION BY sub_id, variant ORDER BY spos").replace("h1 AS (SELECT sub_id, spos,", "h1 AS (SELECT sub_id, variant, spos,")
#: All 8-grams of both streams; names of its own so that it can stand beside the winnowing CTEs.
_H8 = ", ".join(x for x in [_H8[: _H8.index(", h9 AS")].replace("vm AS", "vm2 AS").replace("JOIN vm ", "JOIN vm2 ").replace("h1 AS (SELECT sub_id", "g1 AS (SELECT sub_id")])
for _k in range(2, 9):
    _H8 = _H8.replace(f", h{_k} AS (SELECT *, (h{_k - 1} ", f", g{_k} AS (SELECT *, (h{_k - 1} ").replace(f"AS h{_k} FROM h{_k - 1})", f"AS h{_k} FROM g{_k - 1})")
FLAG_SQL = f"""{SCORE_SQL}, {_H8}, {Q.FEATURES_SQL},
k8 AS (SELECT DISTINCT sub_id, variant, h8 FROM g8 WHERE h8 IS NOT NULL), k8n AS (SELECT sub_id, variant, count(*) AS n FROM k8 GROUP BY 1, 2),
k8i AS (SELECT p.a, p.b, x.variant, count(*) AS i FROM pair p JOIN k8 x ON x.sub_id = p.a JOIN k8 y ON y.sub_id = p.b AND y.variant = x.variant AND y.h8 = x.h8 GROUP BY 1, 2, 3),
k8j AS (SELECT p.a, p.b, v.variant, CASE WHEN coalesce(m.n, 0) = 0 AND coalesce(n.n, 0) = 0 THEN 1.0 ELSE coalesce(i, 0) / (coalesce(m.n, 0) + coalesce(n.n, 0) - coalesce(i, 0)) END AS j
  FROM pair p CROSS JOIN (VALUES ('raw'), ('norm')) v(variant) LEFT JOIN k8i i ON i.a = p.a AND i.b = p.b AND i.variant = v.variant LEFT JOIN k8n m ON m.sub_id = p.a AND m.variant = v.variant LEFT JOIN k8n n ON n.sub_id = p.b AND n.variant = v.variant),
jj AS (SELECT a, b, max(CASE WHEN variant = 'norm' THEN j END) AS norm, max(CASE WHEN variant = 'raw' THEN j END) AS raw FROM k8j GROUP BY 1, 2),
ls AS (SELECT p.a, p.b, count(y.tok) AS lits_shared FROM pair p LEFT JOIN lit x ON x.sub_id = p.a LEFT JOIN lit y ON y.sub_id = p.b AND y.tok = x.tok GROUP BY 1, 2),
wf AS (SELECT sub_id, k, hash, min(pos) AS pos FROM winnow GROUP BY 1, 2, 3),
dr AS (SELECT p.a, p.b, abs(x.pos / greatest(m.n_norm, 1) - y.pos / greatest(n.n_norm, 1)) AS delta, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.hash) AS r
  FROM pair p JOIN wf x ON x.sub_id = p.a JOIN wf y ON y.sub_id = p.b AND y.k = x.k AND y.hash = x.hash JOIN feat m ON m.sub_id = p.a JOIN feat n ON n.sub_id = p.b),
drift AS (SELECT a, b, avg(delta) AS drift FROM dr WHERE r <= {Q.SAMPLE} GROUP BY 1, 2),
side AS (SELECT s.*, norm, raw, lits_shared, drift, struct_a, struct_b FROM score s JOIN jj USING (a, b) JOIN ls USING (a, b) LEFT JOIN drift USING (a, b)
  JOIN (SELECT sub_id AS a, feat AS struct_a FROM feat) USING (a) JOIN (SELECT sub_id AS b, feat AS struct_b FROM feat) USING (b)),
flags AS (SELECT * EXCLUDE (struct_a, struct_b), {', '.join(f"({test.replace('a.', 'struct_a.').replace('b.', 'struct_b.')}) AS {flag}" for flag, test in Q.RULES)} FROM side)"""


def flagged(spark: SparkSession, d: str, dependence: bool = False) -> DataFrame:
    """The scored pairs with the reason why dependence graphs are to be compared, null if they are not."""
    s = scored(spark, d, True, dependence)
    return s.withColumn("ast_subtree", F.coalesce("ast_subtree", F.lit(0.0))).withColumn("reason", F.expr(Q.TRIGGER_SQL))


FLAGS = [flag for flag, _ in Q.RULES]


@query(f"WITH {FLAG_SQL} SELECT a, b, {R.duck_rounded('norm')} AS norm, {R.duck_rounded('raw')} AS raw, {', '.join(FLAGS)} FROM flags")
def all_flags(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of 8-grams and flags of every pair that counts; they depend on none of its signals."""
    return D.all_flags(classes(spark, d, "raw", "norm").drop("members")).select("a", "b", R.rounded(F.col("norm")).alias("norm"), R.rounded(F.col("raw")).alias("raw"), *FLAGS)


@query()
def pdg_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Whether a pair's dependence graphs are to be compared, and the first reason why."""
    return flagged(spark, d).select("a", "b", "weighted_final", F.col("reason").isNotNull().alias("pdg_triggered"), "reason")
