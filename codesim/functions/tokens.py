"""Tokens of source text, by one ordered alternation.

Raw tokens are the text's own; normalised ones stand for classes, so that renamed
variables, other literals, other loops and other basic types leave the same stream.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesim.functions.text import possessive, quote

#: Reserved words by language, and classes of words.
C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while"
KEYWORDS = {
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits yield",
    "c": C_WORDS,
    "cpp": C_WORDS + " alignas alignof and and_eq asm bitand bitor bool catch class compl concept consteval constexpr constinit co_await co_return co_yield decltype delete explicit export false friend mutable namespace new noexcept not not_eq nullptr operator or or_eq override private protected public requires static_assert static_cast dynamic_cast reinterpret_cast const_cast template this thread_local throw true try typeid typename using virtual wchar_t xor xor_eq",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "abstract arguments async await boolean break byte case catch char class const continue debugger default delete do double else enum export extends false final finally float for function goto if implements import in instanceof int interface let long native new null of package private protected public return short static super switch synchronized this throw throws transient true try typeof undefined var void volatile while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var true false nil",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
}
KEYWORDS = {k: tuple(v.split()) for k, v in KEYWORDS.items()}
KEYWORDS["typescript"] = KEYWORDS["javascript"]
LOOPS = tuple("for while do loop".split())
ACCESS = tuple("public private protected internal static final const constexpr abstract virtual override synchronized volatile transient inline extern register pub mut".split())
TYPES = tuple(
    (
        "int long short byte float double char boolean void unsigned signed ArrayList LinkedList HashMap HashSet TreeMap TreeSet LinkedHashMap LinkedHashSet ArrayDeque PriorityQueue List Map Set Queue Deque Collection Iterator "
        "Exception RuntimeException IllegalArgumentException NullPointerException IndexOutOfBoundsException IllegalStateException UnsupportedOperationException IOException ArithmeticException "
        "vector list map set unordered_map unordered_set deque queue stack pair string wstring str bool dict tuple"
    ).split()
)
OPERATORS = "<<= >>= ... == != >= <= && || ++ -- += -= *= /= %= -> :: << >> &= |= ^= ?: => ** & | ^ ~ ! + - * / % = > < ? : . , ; ( ) { } [ ] @".split()
CAP = 50_000  # tokens of a submission that count

# a raw string; RE2 cannot ask for the same delimiter again, so its form takes any
_RAW, _RAW_EXACT = r'R"[^()\\\s"]{0,16}\((?s:.*?)\)[^()\\\s"]{0,16}"', r'R"([^()\\\s"]{0,16})\((?s:.*?)\)\1"'
_PARTS = [
    r"\n",
    r"# --- [^\n]*",
    _RAW,
    r'"""(?s:.*?)"""',
    r"`[^`\\]*(?:\\[^\n][^`\\]*)*`",
    r'"[^"\\]*(?:\\[^\n][^"\\]*)*"',
    r"'[^'\\]*(?:\\[^\n][^'\\]*)*'",
    r"0[xX][0-9a-fA-F]+[lLuU]*",
    r"0[bB][01]+[lLuU]*",
    r"\d+\.\d*(?:[eE][+-]?\d+)?[fFdD]?|\d+[eE][+-]?\d+[fFdD]?|\.\d+(?:[eE][+-]?\d+)?[fFdD]?",
    r"\d+[lLuU]*",
    r"[A-Za-z_$][A-Za-z0-9_$]*",
    "|".join(map(re.escape, OPERATORS)),
]
PATTERN = "|".join(_PARTS)
HASH_PATTERN = "|".join([_PARTS[0], r"#[^\n]*", *_PARTS[2:]])  # of languages with hash comments
HASHED = ("python", "ruby")
_NAME, _NUMBER = r"^[A-Za-z_$]", r"^(?:[0-9]|\.[0-9])"


def pieces(text: Column, lang: Column) -> Column:
    """Line ends and tokens of a text, in order."""
    each = [F.regexp_extract_all(text, F.lit(possessive(p.replace(_RAW, _RAW_EXACT))), F.lit(0)) for p in (HASH_PATTERN, PATTERN)]
    return F.when(lang.isin(*HASHED), each[0]).otherwise(each[1])


def duck_pieces(text: str, lang: str) -> str:
    return f"CASE WHEN {lang} IN {HASHED} THEN regexp_extract_all({text}, {quote(HASH_PATTERN)}) ELSE regexp_extract_all({text}, {quote(PATTERN)}) END"


def _reserved(word: Column, lang: Column) -> Column:
    union = sorted({w for k in ("java", "cpp", "python", "javascript", "go", "rust") for w in KEYWORDS[k]})
    out = word.isin(*union)
    for name, words in KEYWORDS.items():
        out = F.when(lang == name, word.isin(*words)).otherwise(out)
    return out


def _duck_reserved(word: str, lang: str) -> str:
    inside = lambda ws: f"{word} IN ({', '.join(map(quote, ws))})"
    union = sorted({w for k in ("java", "cpp", "python", "javascript", "go", "rust") for w in KEYWORDS[k]})
    return "CASE " + " ".join(f"WHEN {lang} = '{k}' THEN {inside(ws)}" for k, ws in KEYWORDS.items()) + f" ELSE {inside(union)} END"


def norm(piece: Column, lang: Column) -> Column:
    """The class of a token; null if it does not count (access modifiers)."""
    named = (
        F.when(_reserved(piece, lang), F.when(piece.isin(*ACCESS), F.lit(None)).when(piece.isin(*LOOPS), F.lit("LOOP")).otherwise(piece))
        .when(piece.isin(*TYPES), F.lit("TYPE"))
        .otherwise(F.lit("ID"))
    )
    return (
        F.when(piece.rlike(r"^(?:[\"`]|R\")"), F.lit("STR"))
        .when(piece.startswith("'"), F.lit("CHR"))
        .when(piece.rlike(_NUMBER), F.lit("NUM"))
        .when(piece.rlike(_NAME), named)
        .otherwise(piece)
    )


def duck_norm(piece: str, lang: str) -> str:
    within = lambda ws: f"{piece} IN ({', '.join(map(quote, ws))})"
    return (
        f"CASE WHEN regexp_matches({piece}, '^(?:[\"`]|R\")') THEN 'STR' WHEN {piece} LIKE '''%' THEN 'CHR' WHEN regexp_matches({piece}, '{_NUMBER}') THEN 'NUM' "
        f"WHEN regexp_matches({piece}, '{_NAME}') THEN CASE WHEN {_duck_reserved(piece, lang)} THEN CASE WHEN {within(ACCESS)} THEN NULL WHEN {within(LOOPS)} THEN 'LOOP' ELSE {piece} END "
        f"WHEN {within(TYPES)} THEN 'TYPE' ELSE 'ID' END ELSE {piece} END"
    )


def token_table(files: DataFrame, key: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, pos (from 0 within the key), line (from 1), raw, norm (null for access modifiers), npos (place among normalised tokens).

    Tokens over several lines (text blocks, raw and back-quoted strings) count their line ends, plain
    strings over several lines do not. One row a token; a null text has none.
    """
    w = Window.partitionBy(*key).orderBy("at")
    raw = F.col("raw")
    breaks = F.when(raw.rlike(r'^(?:"""|`|R")'), F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))).when(raw == "\n", 1).otherwise(0)
    t = files.select(*key, lang, F.posexplode(pieces(F.col(text), F.col(lang))).alias("at", "raw"))
    t = t.withColumn("line", F.coalesce(F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    t = t.where((raw != "\n") & ~raw.startswith("#")).withColumn("norm", norm(raw, F.col(lang)))
    t = t.withColumn("pos", F.row_number().over(w) - 1)
    return t.withColumn("npos", F.when(F.col("norm").isNotNull(), F.count("norm").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)).select(*key, "pos", F.col("line").cast("int").alias("line"), "raw", "norm", F.col("npos").cast("int").alias("npos"))


def duck_tokens(files: str, key: list[str], text: str = "text", lang: str = "lang") -> str:
    """The same as a SELECT over the CTE ``files``."""
    k = ", ".join(key)
    w = f"(PARTITION BY {k} ORDER BY \"at\")"
    upto = f"(PARTITION BY {k} ORDER BY \"at\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
SELECT {k}, CAST(row_number() OVER {w} - 1 AS INTEGER) AS pos, CAST(line AS INTEGER) AS line, raw, norm,
  CASE WHEN norm IS NOT NULL THEN CAST(count(norm) OVER (PARTITION BY {k} ORDER BY "at" ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) END AS npos
FROM (SELECT *, {duck_norm('raw', lang)} AS norm FROM (
  SELECT *, 1 + coalesce(sum(CASE WHEN raw = chr(10) THEN 1 WHEN regexp_matches(raw, '^(?:\"\"\"|`|R\")') THEN length(raw) - length(replace(raw, chr(10), '')) ELSE 0 END) OVER {upto}, 0) AS line
  FROM (SELECT {k}, {lang}, unnest(p) AS raw, unnest(range(1, len(p) + 1)) AS "at" FROM (SELECT *, {duck_pieces(text, lang)} AS p FROM {files})))
  WHERE raw <> chr(10) AND raw NOT LIKE '#%')"""


# -- the same by Python, a whole text at a time, for plans that need no row a token


@cache
def _pattern(hashed: bool, raw: bool) -> re.Pattern:
    p = HASH_PATTERN if hashed else PATTERN
    return re.compile(possessive(p.replace(_RAW, _RAW_EXACT) if raw else p.replace(_RAW + "|", "")), re.ASCII)


@cache
def _words(lang: str | None) -> frozenset[str]:
    return frozenset(KEYWORDS[lang]) if lang in KEYWORDS else frozenset(w for k in ("java", "cpp", "python", "javascript", "go", "rust") for w in KEYWORDS[k])


def text_pieces(text: str, lang: str | None) -> list[str]:
    """``pieces`` of one text."""
    if 'R"' in text:
        return [m.group() for m in _pattern(lang in HASHED, True).finditer(text)]
    return _pattern(lang in HASHED, False).findall(text)


def piece_norm(piece: str, lang: str | None) -> str | None:
    """``norm`` of one piece."""
    c = piece[0]
    if c in "\"`" or piece.startswith('R"'):
        return "STR"
    if c == "'":
        return "CHR"
    if c in "0123456789" or c == "." and piece[1:2] in tuple("0123456789"):
        return "NUM"
    if c in "_$" or c.isascii() and c.isalpha():
        if piece in _words(lang):
            return None if piece in ACCESS else "LOOP" if piece in LOOPS else piece
        return "TYPE" if piece in TYPES else "ID"
    return piece


def piece_breaks(piece: str) -> int:
    """Line ends that a piece counts."""
    return 1 if piece == "\n" else piece.count("\n") if piece.startswith(('"""', "`", 'R"')) else 0
