"""Submissions as token streams, and classes of submissions with equal streams.

All signals depend on a submission's language and token streams alone, so submissions
that agree in them (and in what excludes pairs) are one class, of which the least sub_id
stands for all: copies never meet in a join.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesim.functions import tokens as K
from codesim.functions.text import quote
from codesim.operators import sources as S


def submission_language(files: DataFrame) -> DataFrame:
    """``sub_id, lang``: that of its files; C++ if C and C++ meet, 'mixed' for other mixtures."""
    langs = files.groupBy("sub_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))  # at most one a language
    lang = F.when(F.size("langs") == 1, F.element_at("langs", 1)).when(F.col("langs") == F.array(F.lit("c"), F.lit("cpp")), "cpp").otherwise("mixed")
    return langs.select("sub_id", lang.alias("lang"))


LANGUAGE_SQL = """sub_lang AS (SELECT sub_id, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang)
  WHEN count(DISTINCT lang) = 2 AND min(lang) = 'c' AND max(lang) = 'cpp' THEN 'cpp' ELSE 'mixed' END AS lang FROM files GROUP BY sub_id)"""


def submission_tokens(tokens: DataFrame) -> DataFrame:
    """``sub_id, variant, spos, tok, file, line``: raw and normalised streams over all files (by lower-case name), CAP tokens each."""
    both = tokens.select("sub_id", "file", "line", "pos", F.explode(F.array(F.struct(F.lit("raw").alias("variant"), F.col("raw").alias("tok")), F.struct(F.lit("norm").alias("variant"), F.col("norm").alias("tok")))).alias("v"))
    both = both.select("sub_id", "file", "line", "pos", "v.variant", "v.tok").where("tok IS NOT NULL")
    w = Window.partitionBy("sub_id", "variant").orderBy(F.lower("file"), "file", "pos")
    return both.withColumn("spos", F.row_number().over(w) - 1).where(F.col("spos") < K.CAP).select("sub_id", "variant", "spos", "tok", "file", "line")


STREAM_SQL = f"""stok AS (SELECT sub_id, variant, CAST(row_number() OVER (PARTITION BY sub_id, variant ORDER BY lower(file), file, pos) - 1 AS INTEGER) AS spos, tok, file, line
  FROM (SELECT sub_id, file, pos, line, 'raw' AS variant, raw AS tok FROM tok UNION ALL SELECT sub_id, file, pos, line, 'norm', norm FROM tok WHERE norm IS NOT NULL)
  QUALIFY spos < {K.CAP})"""


def streams(sub_tokens: DataFrame) -> DataFrame:
    """``sub_id, raw, norm``: the two streams as arrays of at most CAP tokens."""
    arrays = sub_tokens.groupBy("sub_id", "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("spos", "tok"))), lambda x: x["tok"]).alias("toks"))
    return arrays.groupBy("sub_id").agg(F.max(F.when(F.col("variant") == "raw", F.col("toks"))).alias("raw"), F.max(F.when(F.col("variant") == "norm", F.col("toks"))).alias("norm"))


PACK_SCHEMA = "sub_id string, lang string, stream string, raw binary, norm binary, places binary"
SPLIT = "\x01"  # between tokens; no canonical text has it


def packed(tokens: list[str]) -> bytes | None:
    """Tokens as a few bytes."""
    return zlib.compress(SPLIT.join(tokens).encode(), 1) if tokens else None


def unpacked(tokens: bytes | list[str] | None) -> list[str]:
    """The tokens of ``packed``; a list is its own."""
    return zlib.decompress(tokens).decode().split(SPLIT) if isinstance(tokens, bytes) else tokens or []


def _language(langs: set[str]) -> str:
    """``submission_language`` of one set."""
    return next(iter(langs)) if len(langs) == 1 else "cpp" if langs == {"c", "cpp"} else "mixed"


def _packs(batches: Iterator[pa.RecordBatch], known: dict[tuple, tuple] | None = None) -> Iterator[pa.RecordBatch]:
    known = {} if known is None else known  # language and piece: class and line ends
    for batch in batches:
        rows = []
        for sub, fs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw, norm, places = [], [], []
            for no, f in enumerate(fs):
                line, lang = 1, f["lang"]
                for piece in K.text_pieces(f["text"], lang):
                    if piece == "\n":
                        line += 1
                        continue
                    if (told := known.get((lang, piece))) is None:
                        told = (piece[0] == "#", K.piece_norm(piece, lang), K.piece_breaks(piece))
                        if len(known) < 1_000_000:
                            known[lang, piece] = told
                    if not told[0]:
                        raw.append(piece)
                        if told[1] is not None:
                            norm.append(told[1])
                            places.append((no, line))
                    line += told[2]
                if len(raw) >= K.CAP and len(norm) >= K.CAP:
                    break
            raw, norm, places = raw[: K.CAP], norm[: K.CAP], places[: K.CAP]
            if raw:
                at = zlib.compress(np.array(places, np.int32).tobytes(), 1) if places else None
                rows.append((sub, _language({f["lang"] for f in fs}), hashlib.md5(SPLIT.join(raw).encode(), usedforsecurity=False).hexdigest(), packed(raw), packed(norm), at))
        types = [pa.string()] * 3 + [pa.binary()] * 3
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in PACK_SCHEMA.split(", ")])


def packs(canonical: DataFrame) -> DataFrame:
    """PACK_SCHEMA: each submission's language, both streams of ``submission_tokens`` (packed), the MD5 of the raw one, and file (its number by name) and line of each normalised token.

    ``canonical``: sub_id, file, lang, text. A text is sent once, by its submission; no token is ever a row.
    """
    each = F.array_sort(F.collect_list(F.struct(F.lower("file").alias("k"), "file", "lang", "text")))
    return canonical.groupBy("sub_id").agg(each.alias("fs")).select("sub_id", F.transform("fs", lambda x: F.struct(x["lang"].alias("lang"), x["text"].alias("text"))).alias("fs")).mapInArrow(_packs, PACK_SCHEMA)


def stream_key(stream_table: DataFrame) -> Column:
    """The MD5 of the raw stream."""
    return F.col("stream") if "stream" in stream_table.columns else F.md5(F.array_join(F.col("raw"), SPLIT))


def owners(submissions: DataFrame) -> DataFrame:
    """``sub_id, assignment_id, student_id, grp``; of several values the least."""
    return submissions.where("sub_id IS NOT NULL").groupBy("sub_id").agg(*[F.min(c).alias(c) for c in ("assignment_id", "student_id", "grp")])


OWNER_SQL = "owner AS (SELECT sub_id, min(assignment_id) AS assignment_id, min(student_id) AS student_id, min(grp) AS grp FROM submissions WHERE sub_id IS NOT NULL GROUP BY sub_id)"


def classes(stream_table: DataFrame, languages: DataFrame | None, submissions: DataFrame, kept: tuple[str, ...] = ("raw", "norm")) -> DataFrame:
    """``rep, members, assignment_id, student_id, grp, lang`` and the streams ``kept`` of each class within an assignment; submissions of no assignment are left out. ``languages`` None: the streams have them."""
    told = stream_table.withColumn("stream", stream_key(stream_table)) if languages is None else stream_table.withColumn("stream", stream_key(stream_table)).join(languages, "sub_id")
    all_ = told.join(owners(submissions).where("assignment_id IS NOT NULL"), "sub_id")
    return all_.groupBy("assignment_id", "student_id", "grp", "lang", "stream").agg(
        F.min("sub_id").alias("rep"), F.count("*").alias("members"), *[F.min_by(c, "sub_id").alias(c) for c in kept]
    ).drop("stream")


def members(stream_table: DataFrame, languages: DataFrame | None, submissions: DataFrame) -> DataFrame:
    """``sub_id, rep, linked`` of each submission in a class. Two members are a pair of score 1 if ``linked``: their student is unknown and they have no group."""
    told = stream_table.withColumn("stream", stream_key(stream_table)).drop("raw", "norm", "places")
    all_ = (told if languages is None else told.join(languages, "sub_id")).join(owners(submissions).where("assignment_id IS NOT NULL"), "sub_id")
    w = Window.partitionBy("assignment_id", "student_id", "grp", "lang", "stream")
    unknown = (F.coalesce("student_id", F.lit("")) == "") & (F.coalesce("grp", F.lit("")) == "")
    return all_.select("sub_id", F.min("sub_id").over(w).alias("rep"), unknown.alias("linked"))


CLASS_SQL = f"""{OWNER_SQL}, {LANGUAGE_SQL},
stream AS (SELECT sub_id, md5(string_agg(tok, chr(1) ORDER BY spos)) AS stream FROM stok WHERE variant = 'raw' GROUP BY sub_id),
cls AS (SELECT assignment_id, student_id, grp, lang, min(sub_id) AS rep, count(*) AS members
  FROM stream JOIN sub_lang USING (sub_id) JOIN owner USING (sub_id) WHERE assignment_id IS NOT NULL GROUP BY assignment_id, student_id, grp, lang, stream)"""

BASE_SQL = f"{S.CANONICAL_SQL}, tok AS ({K.duck_tokens('canon', ['sub_id', 'file'])}), {STREAM_SQL}"


def sql_list(words) -> str:
    """Words as an SQL list."""
    return "(" + ", ".join(map(quote, words)) + ")"
