"""Queries of fingerprints, submissions and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesim.functions import fingerprints as P
from codesim.functions import text as T
from codesim.operators import sources as S
from codesim.operators import submissions as U
from codesim.plans.catalogue import Catalogue
from codesim.plans.texts import canon, files, tokens
from codesim.session import checkpointed
from codesim.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query


def stream_table(spark: SparkSession, d: str) -> DataFrame:
    """Each submission's streams, packed (U.PACK_SCHEMA)."""
    return U.packs(canon(spark, d))


def prints(spark: SparkSession, d: str, *schemes: P.Scheme) -> DataFrame:
    return P.fingerprints(stream_table(spark, d), "sub_id", "norm", list(schemes))


_P = f"CAST({P.PRIME} AS HUGEINT)"
#: v and m of each distinct token, and the hash of every k tokens in a row for k from 1 to 15 (h1 .. h15).
HASH_SQL = (
    f"vm AS (SELECT tok, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_append(list_transform(string_split(tok, ''), lambda c: CAST(unicode(c) AS HUGEINT)), CAST({P.SEPARATOR} AS HUGEINT))), lambda h, c: (h * {P.BASE} + c) % {_P}) AS v, "
    f"list_reduce(list_prepend(CAST(1 AS HUGEINT), list_transform(range(length(tok) + 1), lambda x: CAST({P.BASE} AS HUGEINT))), lambda h, c: (h * c) % {_P}) AS m FROM (SELECT DISTINCT tok FROM stok WHERE variant = 'norm')), "
    "h1 AS (SELECT sub_id, spos, v AS h1, " + ", ".join(f"lead(v, {i}) OVER w AS v{i}, lead(m, {i}) OVER w AS m{i}" for i in range(1, 15)) + " FROM stok JOIN vm USING (tok) WHERE variant = 'norm' WINDOW w AS (PARTITION BY sub_id ORDER BY spos)), "
    + ", ".join(f"h{k} AS (SELECT *, (h{k - 1} * m{k - 1} + v{k - 1}) % {_P} AS h{k} FROM h{k - 1})" for k in range(2, 16))
)


@query(f"WITH {U.BASE_SQL}, {HASH_SQL} SELECT sub_id, spos AS pos, CAST(h8 AS BIGINT) AS hash FROM h8 WHERE h8 IS NOT NULL")
def kgrams_k8(spark: SparkSession, d: str) -> DataFrame:
    return prints(spark, d, P.Scheme("k8", 8)).select("sub_id", "pos", "hash")


@query(f"WITH {U.BASE_SQL}, {HASH_SQL} SELECT sub_id, spos AS pos, CAST(h12 AS BIGINT) AS hash FROM h12 WHERE h12 IS NOT NULL")
def kgrams_k12(spark: SparkSession, d: str) -> DataFrame:
    return prints(spark, d, P.Scheme("k12", 12)).select("sub_id", "pos", "hash")


_N = "n AS (SELECT sub_id, count(*) AS n FROM stok WHERE variant = 'norm' GROUP BY sub_id), dyn AS (SELECT sub_id, n, greatest(8, least(15, n // 200)) AS k, greatest(4, least(8, greatest(8, least(15, n // 200)) // 2)) AS w FROM n)"
WINNOW_SQL = (
    f"{HASH_SQL}, {_N}, gram AS (SELECT sub_id, spos AS pos, k, w, CASE k " + " ".join(f"WHEN {k} THEN h{k}" for k in range(8, 16)) + " END AS h FROM h15 JOIN dyn USING (sub_id)), "
    "full_gram AS (SELECT *, count(*) OVER (PARTITION BY sub_id) AS grams FROM gram WHERE h IS NOT NULL), "
    "pick AS (SELECT sub_id, k, grams, w, pos, h, CASE w "
    + " ".join(f"WHEN {w} THEN CASE WHEN pos <= grams - {w} THEN min({{'h': h, 'p': -pos}}) OVER (PARTITION BY sub_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) END" for w in range(4, 9))
    + " END AS best FROM full_gram), "
    "winnow AS (SELECT DISTINCT sub_id, CAST(k AS INTEGER) AS k, CAST(best.h AS BIGINT) AS hash, CAST(-best.p AS INTEGER) AS pos FROM pick WHERE grams >= w AND best IS NOT NULL "
    "UNION ALL SELECT sub_id, CAST(k AS INTEGER), CAST(h AS BIGINT), CAST(pos AS INTEGER) FROM pick WHERE grams < w)"
)
WINNOWED = P.Scheme("winnow", 0, True)


@query(f"WITH {U.BASE_SQL}, {WINNOW_SQL} SELECT sub_id, k, hash, pos FROM winnow")
def winnow(spark: SparkSession, d: str) -> DataFrame:
    return prints(spark, d, WINNOWED).select("sub_id", "k", "hash", "pos")


@query(f"WITH {U.BASE_SQL}, {_N} SELECT sub_id, n, k, w FROM dyn")
def dyn_k(spark: SparkSession, d: str) -> DataFrame:
    n = U.submission_tokens(tokens(spark, d)).where("variant = 'norm'").groupBy("sub_id").agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(8), F.least(F.lit(15), F.floor(F.col("n") / 200)))
    return n.withColumn("k", k.cast("bigint")).withColumn("w", F.greatest(F.lit(4), F.least(F.lit(8), F.floor(F.col("k") / 2))).cast("bigint"))


@query(f"WITH {S.FILES_SQL} SELECT sub_id, file, n, CAST({P.DUCK_FUNCTION_K} AS INTEGER) AS k FROM (SELECT sub_id, file, length(text) AS n FROM files)")
def select_k(spark: SparkSession, d: str) -> DataFrame:
    n = files(spark, d).select("sub_id", "file", F.length("text").cast("bigint").alias("n"))
    return n.withColumn("k", P.function_k(F.col("n")).cast("int"))


@query(f"WITH {U.BASE_SQL}, {WINNOW_SQL}, {U.OWNER_SQL}, tpl AS (SELECT assignment_id, min(sub_id) AS sub_id FROM owner WHERE assignment_id IS NOT NULL AND sub_id IN (SELECT sub_id FROM winnow) GROUP BY assignment_id), "
       "th AS (SELECT DISTINCT assignment_id, k, hash FROM winnow JOIN tpl USING (sub_id)) "
       "SELECT x.sub_id, x.k, x.hash, x.pos FROM winnow x JOIN owner o ON x.sub_id = o.sub_id WHERE o.assignment_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM th WHERE th.assignment_id = o.assignment_id AND th.k = x.k AND th.hash = x.hash)")
def fingerprint_subtract(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of each submission without those of its assignment's template (here its first submission)."""
    w = checkpointed(prints(spark, d, WINNOWED)).join(U.owners(table(spark, d, "submissions")).where("assignment_id IS NOT NULL").select("sub_id", "assignment_id"), "sub_id")
    first = w.groupBy("assignment_id").agg(F.min("sub_id").alias("sub_id"))
    template = w.join(first, ["assignment_id", "sub_id"], "left_semi").select("assignment_id", "k", "hash").distinct()
    return w.join(template, ["assignment_id", "k", "hash"], "left_anti").select("sub_id", "k", "hash", "pos")


@query(f"WITH {U.BASE_SQL} SELECT sub_id, CASE WHEN tok IN ('for', 'while', 'do') THEN 'LOOP' ELSE tok END AS tok, count(*) AS n FROM stok WHERE variant = 'norm' GROUP BY 1, 2")
def loop_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = U.submission_tokens(tokens(spark, d)).where("variant = 'norm'")
    return t.groupBy("sub_id", F.when(F.col("tok").isin("for", "while", "do"), "LOOP").otherwise(F.col("tok")).alias("tok")).agg(F.count("*").alias("n"))


@query(f"WITH {S.FILES_SQL}, {U.LANGUAGE_SQL} SELECT sub_id, lang FROM sub_lang")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return U.submission_language(files(spark, d))


@query(r"SELECT DISTINCT sub_id, path, array_to_string(list_filter(string_split(replace('../' || path || '/./x.c', '\', '/'), '/'), lambda x: x NOT IN ('', '.', '..')), '/') AS clean FROM submissions")
def path_sanitize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("../"), F.col("path"), F.lit("/./x.c"))
    return table(spark, d, "submissions").select("sub_id", "path", T.clean_path(raw).alias("clean")).distinct()


# -- lines

_LINES_SQL = f"""{S.CANONICAL_SQL}, cl AS (SELECT sub_id, file, l, line FROM (SELECT sub_id, file, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT sub_id, file, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM canon WHERE text <> '')))"""


def lines(df: DataFrame) -> DataFrame:
    """``sub_id, file, line, l``: the lines of each file from 1; a last line end begins no line, an empty text has none."""
    split = F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)
    return df.where("text <> ''").select("sub_id", "file", F.posexplode(split).alias("line", "l")).withColumn("line", (F.col("line") + 1).cast("bigint"))


@query(f"WITH {_LINES_SQL} SELECT sub_id, file, line FROM cl WHERE trim(l) <> '' AND trim(l) NOT IN {U.sql_list(T.TRIVIAL_LINES)}")
def meaningful_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(canon(spark, d)).where(T.meaningful(F.col("l"))).select("sub_id", "file", "line")


_OFFSETS_SQL = f"""{_LINES_SQL}, nl AS (SELECT sub_id, file, count(*) AS n FROM cl GROUP BY sub_id, file),
off AS (SELECT sub_id, file, n, CAST(1 + coalesce(sum(n + 2) OVER (PARTITION BY sub_id ORDER BY lower(file), file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS canonical_start FROM nl)"""


def offsets(spark: SparkSession, d: str, texts: DataFrame | None = None) -> DataFrame:
    """Where each file's lines lie in its submission's concatenation: a line with its name before, an empty one behind."""
    from pyspark.sql import Window

    n = lines(canon(spark, d) if texts is None else texts).groupBy("sub_id", "file").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sub_id").orderBy(F.lower("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("canonical_start", (F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0)) + 2).cast("bigint"))


@query(f"WITH {_OFFSETS_SQL} SELECT sub_id, file, canonical_start, canonical_start + n - 1 AS canonical_end FROM off")
def canonical_offsets(spark: SparkSession, d: str) -> DataFrame:
    return offsets(spark, d).select("sub_id", "file", "canonical_start", (F.col("canonical_start") + F.col("n") - 1).alias("canonical_end"))


@query(f"WITH {_OFFSETS_SQL}, m AS (SELECT sub_id, file, line, canonical_start + line - 1 AS cline FROM cl JOIN off USING (sub_id, file)) SELECT sub_id, file, cline, line FROM m")
def source_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each canonical line with its file and original line: the line found by its place between a file's first and last."""
    from pyspark.sql import Window

    starts = checkpointed(offsets(spark, d)).select("sub_id", "file", "canonical_start", "n")
    ends = starts.groupBy("sub_id").agg(F.max(F.col("canonical_start") + F.col("n") - 1).alias("last"))
    points = ends.select("sub_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("cline"))
    # files and lines in one order: the latest file begun is the line's
    both = points.select("sub_id", F.col("cline").cast("bigint").alias("at"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("n")).unionByName(starts.select("sub_id", F.col("canonical_start").alias("at"), "file", "n"))
    w = Window.partitionBy("sub_id").orderBy("at", F.col("file").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("file").isNotNull(), F.struct("file", "at", "n")), ignorenulls=True).over(w)
    found = both.withColumn("of", begun).where("file IS NULL AND of IS NOT NULL AND at < of.at + of.n")
    return found.select("sub_id", F.col("of.file").alias("file"), F.col("at").alias("cline"), (F.col("at") - F.col("of.at") + 1).alias("line"))


@query(f"WITH {_LINES_SQL}, {U.OWNER_SQL}, tpl AS (SELECT assignment_id, min(sub_id) AS sub_id FROM owner WHERE assignment_id IS NOT NULL AND sub_id IN (SELECT sub_id FROM cl) GROUP BY assignment_id), "
       f"bp AS (SELECT DISTINCT assignment_id, trim(l) AS l FROM cl JOIN tpl USING (sub_id) WHERE trim(l) <> '' AND trim(l) NOT IN {U.sql_list(T.TRIVIAL_TEMPLATE)}) "
       "SELECT c.sub_id, c.file, c.line, CASE WHEN b.l IS NULL THEN c.l ELSE '' END AS l FROM cl c JOIN owner o ON c.sub_id = o.sub_id LEFT JOIN bp b ON b.assignment_id = o.assignment_id AND b.l = trim(c.l) WHERE o.assignment_id IS NOT NULL")
def template_blank(spark: SparkSession, d: str) -> DataFrame:
    """Lines that occur in their assignment's template (here its first submission) blanked."""
    own = U.owners(table(spark, d, "submissions")).where("assignment_id IS NOT NULL").select("sub_id", "assignment_id")
    all_ = lines(checkpointed(canon(spark, d))).join(own, "sub_id")
    first = all_.groupBy("assignment_id").agg(F.min("sub_id").alias("sub_id"))
    kept = (F.trim("l") != "") & ~F.trim("l").isin(*T.TRIVIAL_TEMPLATE)
    template = all_.join(first, ["assignment_id", "sub_id"], "left_semi").where(kept).select("assignment_id", F.trim("l").alias("t"), F.lit(True).alias("known")).distinct()
    hit = all_.withColumn("t", F.trim("l")).join(template, ["assignment_id", "t"], "left")
    return hit.select("sub_id", "file", "line", F.when(F.col("known").isNull(), F.col("l")).otherwise("").alias("l"))


@query(f"WITH {S.FILES_SQL} SELECT sub_id, string_agg(rtrim(text, chr(10)) || chr(10), '' ORDER BY lower(file), file) AS full_source FROM files GROUP BY sub_id")
def full_source(spark: SparkSession, d: str) -> DataFrame:
    """All files of a submission as one text, by lower-case name, one line end after each."""
    parts = F.array_sort(F.collect_list(F.struct(F.lower("file").alias("k"), "file", F.concat(F.regexp_replace("text", r"\n+\z", ""), F.lit("\n")).alias("t"))))
    return files(spark, d).groupBy("sub_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("full_source"))
