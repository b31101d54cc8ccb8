"""The engine's entry points: batch analysis of submissions and comparison of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesim.functions.fingerprints import Scheme, fingerprints, hashed
from codesim.functions.text import apply_rules, canonical, file_lang, meaningful
from codesim.functions.tokens import token_table
from codesim.operators import assembly as Y
from codesim.operators import blocks as B
from codesim.operators import pairs as R
from codesim.operators import rules as Q
from codesim.operators import structure as X
from codesim.operators import submissions as U
from codesim.session import checkpointed

VERSION = "2.0"


def features(files: DataFrame) -> DataFrame:
    """``sub_id, lang, raw, norm, prints`` of ``files(sub_id, file, text)``: streams and distinct winnowed hashes."""
    told = files.select("sub_id", "file", "text", file_lang(F.col("file"), F.col("text")).alias("lang")).where("sub_id IS NOT NULL AND file IS NOT NULL AND text IS NOT NULL")
    plain = told.withColumn("text", canonical(F.col("text"), F.col("lang")))
    streams = U.streams(U.submission_tokens(token_table(plain, ["sub_id", "file"])))
    prints = fingerprints(streams, "sub_id", "norm", [Scheme("winnow", 0, True)]).groupBy("sub_id").agg(F.array_sort(F.collect_set("hash")).alias("prints"))
    return U.submission_language(told).join(streams, "sub_id", "left").join(prints, "sub_id", "left")


def blank_template(files: DataFrame, template: DataFrame | None) -> DataFrame:
    """``files`` with the lines blanked that the template (file, text) has, trivial ones kept."""
    from codesim.functions.text import NEWLINES, TRIVIAL_TEMPLATE

    if template is None:
        return files
    lines = lambda df: df.select(*[c for c in df.columns if c != "text"], F.posexplode(F.split(apply_rules(F.col("text"), NEWLINES), "\n", -1)).alias("no", "l"))
    known = lines(template.select("text")).select(F.trim("l").alias("t")).where((F.col("t") != "") & ~F.col("t").isin(*TRIVIAL_TEMPLATE)).distinct().withColumn("known", F.lit(True))
    kept = lines(files).withColumn("t", F.trim("l")).join(known, "t", "left").withColumn("l", F.when(F.col("known"), "").otherwise(F.col("l")))
    keys = [c for c in files.columns if c != "text"]
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "l"))), lambda x: x["l"]), "\n").alias("text"))


def pair_scores(f: DataFrame, functions: DataFrame) -> DataFrame:
    """All pairs that count of ``f`` (features with owners), with their signals and base score, whatever they share."""
    methods = functions.groupBy("sub_id").agg(F.array_sort(F.collect_list(F.struct("file", "start_line", "func", *R.LEVELS))).alias("fs"), *[F.array_distinct(F.flatten(F.collect_list(level))).alias(f"lv_{level}") for level in R.LEVELS])
    terms, keys = R.term_weights("norm")
    sides = f.where("assignment_id IS NOT NULL AND raw IS NOT NULL").join(methods, "sub_id", "left")
    s = B.all_signals(sides.select("assignment_id", F.col("sub_id").alias("rep"), "student_id", "grp", "lang", F.col("prints").alias("set"), terms.alias("terms"), keys.alias("keys"), *[f"lv_{level}" for level in R.LEVELS], F.lit(True).alias("has_ast"), "fs"))
    return s.withColumn("weighted_final", R.base_score(F.lit(True), F.lit(True)))


def told_functions(files: DataFrame) -> DataFrame:
    return X.function_table(files.where("sub_id IS NOT NULL AND file IS NOT NULL AND text IS NOT NULL").withColumn("lang", file_lang(F.col("file"), F.col("text"))))


def batch_analyze(files: DataFrame, owners: DataFrame, least: float = 0.5, threshold: float = 0.0, template: DataFrame | None = None) -> DataFrame:
    """Scored pairs, best first, of ``files(sub_id, file, text)`` within the assignments of ``owners(sub_id, assignment_id, student_id, grp)``.

    Pairs share at least ``least`` of the smaller side's fingerprints, 0 for every pair; those of one
    student or group or of different languages are left out, as are scores below ``threshold``.
    """
    files = blank_template(files, template)
    functions = told_functions(files)
    s = pair_scores(features(files).join(owners, "sub_id"), functions).where((F.col("containment") >= least - 1e-9) & (F.col("weighted_final") >= threshold))
    return s.join(X.pair_structure(s, functions).select("a", "b", "callgraph_sim"), ["a", "b"]).orderBy(F.desc("weighted_final"), "a", "b")


def _told(spark: SparkSession, files: DataFrame, template: frozenset[str]) -> dict:
    """Everything about the one pair (a, b) of ``files``."""
    # each written once: what follows reads them many times, and plans over them stay small
    told = checkpointed(files.withColumn("lang", file_lang(F.col("file"), F.col("text"))))
    plain = checkpointed(told.withColumn("text", canonical(F.col("text"), F.col("lang"))))
    functions = checkpointed(X.function_table(told))
    toks = checkpointed(U.submission_tokens(token_table(plain, ["sub_id", "file"])))
    streams = U.streams(toks)
    prints = fingerprints(streams, "sub_id", "norm", [Scheme("winnow", 0, True)]).groupBy("sub_id").agg(F.array_sort(F.collect_set("hash")).alias("prints"))
    f = checkpointed(U.submission_language(told).withColumnRenamed("lang", "language").join(streams, "sub_id", "left").join(prints, "sub_id", "left"))
    one = f.withColumns({"assignment_id": F.lit("x"), "student_id": F.lit(None).cast("string"), "grp": F.lit(None).cast("string"), "lang": F.lit("mixed")})
    s = checkpointed(pair_scores(one, functions))
    cls = f.withColumnRenamed("sub_id", "rep")
    flagged = Q.flagged_pairs(s, Q.flag_sides(cls, toks, hashed(cls, "norm", Scheme("winnow", 0, True))))
    flagged = flagged.withColumn("reason", F.expr(Q.TRIGGER_SQL.replace("ast_subtree", "coalesce(ast_subtree, 0.0)")))
    found = flagged.join(X.pair_structure(s, functions).select("a", "b", "callgraph_sim"), ["a", "b"]).collect()
    if not found:
        raise ValueError("a side without code")
    r = found[0].asDict()
    out = {k: r[k] for k in (*B.SCHEMA.replace(" double", "").replace(" string", "").split(", "), "callgraph_sim", "weighted_final", "norm", "raw", "reason")}
    out["flags"] = [flag for flag, _ in Q.RULES if r[flag]]
    out["pdg_similarity"] = None
    if r["reason"] is not None:
        pdg = X.pair_dependence(s.select("a", "b"), X.pdg_table(told)).collect()
        out["pdg_similarity"] = pdg[0]["pdg_similarity"] if pdg else None
    share = R.PDG_SHARE
    base, graph = r["weighted_final"], out["pdg_similarity"]
    out["final"] = base if graph is None else int(min(base * (1 - share) + graph * share, 1.0) * 1e4 + 0.5) / 1e4
    out["languages"] = {x["sub_id"]: x["language"] for x in f.select("sub_id", "language").collect()}
    lines = plain.select("sub_id", "file", F.posexplode(F.split("text", "\n", -1)).alias("no", "l")).select("sub_id", "file", (F.col("no") + 1).alias("line"), "l", meaningful(F.col("l")).alias("meaningful"))
    before = Window.partitionBy("sub_id").orderBy(F.lower("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("sub_id", "file").agg(F.count("*").alias("n")).withColumn("canonical_start", (F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0)) + 2).cast("bigint"))
    sides = {x["sub_id"]: Y.Side(x.asDict(True), {}) for x in Y.packed(toks, lines, offsets.select("sub_id", "file", "canonical_start"), functions).collect()}
    names = Y._NAMES[1:]
    blocks = Y.pair_evidence(sides["a"], sides["b"], base, template=template)
    out["evidence"] = [dict(zip(names, row, strict=True)) for row in Y.rows_of("a", "b", sides["a"], sides["b"], blocks)]
    return out


def compare(spark: SparkSession, a: list[tuple[str, str]], b: list[tuple[str, str]], template: list[tuple[str, str]] | None = None) -> dict:
    """The full comparison of two submissions given as (file, text) lists, of any languages: signals, flags, dependence graphs where a trigger calls for them, final score, evidence.

    Lines of ``template`` do not count. A failure, also of a side without code, is told in ``status`` and ``error``.
    """
    rows = [("a", f, t) for f, t in a] + [("b", f, t) for f, t in b]
    try:
        files = spark.createDataFrame(rows, "sub_id string, file string, text string").where("file IS NOT NULL AND text IS NOT NULL")
        files = blank_template(files, spark.createDataFrame(template, "file string, text string") if template else None)
        known = frozenset(line.strip() for _, t in template or [] for line in (t or "").splitlines())
        return {"status": "completed", "error": None, "engine_version": VERSION, **_told(spark, files, known)}
    except Exception as e:  # noqa: BLE001
        return {"status": "failed", "error": f"{type(e).__name__}: {e}", "engine_version": VERSION, "weighted_final": None}
