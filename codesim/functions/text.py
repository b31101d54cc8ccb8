"""Line-preserving rewrites of source text, as rules that Spark and DuckDB both apply.

A rule is a pattern and a replacement in the syntax that Java's and RE2's regular expressions
share (\\1 for a group). ``^`` and ``$`` are ends of lines, which end in \\n alone. Every
rewrite keeps the number of lines, so line numbers stay those of the original.
Null text stays null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of files and the language they stand for.
LANGUAGES = {
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "python": ("py",),
    "javascript": ("js",),
    "typescript": ("ts",),
    "csharp": ("cs",),
    "go": ("go",),
    "rust": ("rs",),
    "ruby": ("rb",),
}
C_FAMILY = ("c", "cpp")


@dataclass(frozen=True)
class Rule:
    """Replace a pattern everywhere, in texts of some languages (all if there are none)."""

    pattern: str
    by: str = ""
    langs: tuple[str, ...] = ()


def quote(s: str) -> str:
    """An SQL string literal for DuckDB."""
    return "'" + s.replace("'", "''") + "'"


def spark_replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit("(?md)" + pattern), F.lit(re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))))


def possessive(pattern: str) -> str:
    """Repeated groups that do not give back: Java then loops over them instead of recursing, so a literal of any length is read."""
    return pattern.replace(")*", ")*+")


def duck_replace(e: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({e}, {quote('(?m)' + pattern)}, {quote(by)}, 'g')"


def merged(rules: list[Rule]) -> list[Rule]:
    """Neighbouring rules that blank what they match, as one rule: one pass over the text instead of several."""
    out: list[Rule] = []
    for r in rules:
        if out and not r.by and not out[-1].by:
            out[-1] = Rule(f"{out[-1].pattern}|{r.pattern}")
        else:
            out.append(r)
    return out


def apply_rules(c: Column, rules: list[Rule], lang: Column | None = None) -> Column:
    """The rules in their order. Rules for some languages only need ``lang``."""
    if lang is None:
        for r in merged(rules):
            c = spark_replace(c, r.pattern, r.by)
        return c
    named = sorted({x for r in rules for x in r.langs})
    every = [r for r in rules if not r.langs or "mixed" in r.langs]
    out = apply_rules(c, every)
    for name in named:
        if name != "mixed":
            own = [r for r in rules if not r.langs or name in r.langs]
            out = F.when(lang == name, apply_rules(c, own)).otherwise(out)
    return out


def duck_rules(e: str, rules: list[Rule], lang: str | None = None) -> str:
    """The same as SQL; ``e`` and ``lang`` are columns."""
    if lang is None:
        for r in merged(rules):
            e = duck_replace(e, r.pattern, r.by)
        return e
    named = sorted({x for r in rules for x in r.langs} - {"mixed"})
    cases = " ".join(f"WHEN {lang} = '{n}' THEN {duck_rules(e, [r for r in rules if not r.langs or n in r.langs])}" for n in named)
    return f"CASE {cases} ELSE {duck_rules(e, [r for r in rules if not r.langs or 'mixed' in r.langs])} END"


# -- characters

NEWLINES = [Rule(r"\r\n?", "\n"), Rule("\\A\ufeff")]
CONTROLS = [Rule(r"[\x00-\x08\x0B-\x1F]")]
TRAILING = [Rule(r"[ \t]+$")]

# -- files


def suffix(file: Column) -> Column:
    """The last suffix of a path, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(file, r"\.([^./\\]*)$", 1))


def duck_suffix(file: str) -> str:
    return f"lower(regexp_extract({file}, '\\.([^./\\\\]*)$', 1))"


SNIFF_CHARACTERS = 2000
#: What the head of a text without suffix must contain to be of a language; all of one list.
SNIFF = [
    ("java", ("public class ",)),
    ("java", ("import java.",)),
    ("cpp", ("#include", "{", "class ")),
    ("cpp", ("#include", "{", "namespace ")),
    ("cpp", ("#include", "{", "template")),
    ("c", ("#include", "{")),
    ("python", ("def ", "import ")),
    ("go", ("func ", "package ")),
    ("rust", ("fn ", "let mut")),
    ("rust", ("fn ", "use std")),
]


def sniffed(text: Column) -> Column:
    """The language by the first SNIFF_CHARACTERS characters, null if none is recognised."""
    head = F.substring(text, 1, SNIFF_CHARACTERS)
    out = F.lit(None).cast("string")
    for lang, words in reversed(SNIFF):
        test = F.lit(True)
        for w in words:
            test = test & head.contains(w)
        out = F.when(test, F.lit(lang)).otherwise(out)
    return out


def duck_sniffed(text: str) -> str:
    cases = " ".join("WHEN " + " AND ".join(f"contains(substr({text}, 1, {SNIFF_CHARACTERS}), {quote(w)})" for w in words) + f" THEN '{lang}'" for lang, words in SNIFF)
    return f"CASE {cases} END"


def file_lang(file: Column, text: Column) -> Column:
    """The language of a file by its suffix, else by its text, else 'mixed'."""
    s = suffix(file)
    return F.coalesce(*[F.when(s.isin(*ends), F.lit(name)) for name, ends in LANGUAGES.items()], sniffed(text), F.lit("mixed"))


def duck_file_lang(file: str, text: str) -> str:
    s = duck_suffix(file)
    cases = " ".join(f"WHEN {s} IN ({', '.join(map(quote, ends))}) THEN '{name}'" for name, ends in LANGUAGES.items())
    return f"coalesce(CASE {cases} END, {duck_sniffed(text)}, 'mixed')"


# -- comments

_LITERALS = r""""[^"\\]*(?:\\(?s:.)[^"\\]*)*(?:"|\\?\z)|'[^'\\]*(?:\\(?s:.)[^'\\]*)*(?:'|\\?\z)"""
#: Pieces of a text with a newline in front: comments, directives, literals, and the rest.
PIECES = {
    "c": r"\n[ \t]*#(?:[^\n]*\\\n)*[^\n]*|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|" + _LITERALS + r"""|[^"'/\n]+|(?s:.)""",
    "other": r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|" + _LITERALS + r"""|[^"'/\n]+|(?s:.)""",
    "ruby": r"""\n[ \t]*=begin(?s:.*?)(?:\n[ \t]*=end[^\n]*|\z)|#[^\n]*|"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"?|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'?|[^"'#\n]+|(?s:.)""",
    "python": r'"""(?s:.*?)(?:"""|\z)' + r"|'''(?s:.*?)(?:'''|\z)|#[^\n]*|" + _LITERALS + r"""|[^"'#\n]+|(?s:.)""",
}
_GONE = {"c": r"^(?://|/\*|\n[ \t]*#)", "other": r"^(?://|/\*)", "ruby": r"^(?:#|\n[ \t]*=begin)", "python": r"""^(?:#|\"\"\"|''')"""}
_KIND = {"c": "c", "cpp": "c", "mixed": "c", "python": "python", "ruby": "ruby"}
_KINDS = {kind: [lang for lang, k in _KIND.items() if k == kind] for kind in dict.fromkeys(_KIND.values())}


def strip_comments(text: Column, lang: Column) -> Column:
    """Comments (and directives of C and C++, docstrings of Python) taken out, their line ends kept. Of Ruby those are ``#`` and =begin to =end."""

    def by(kind: str) -> Column:
        pieces = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(possessive(PIECES[kind])), F.lit(0))
        kept = F.transform(pieces, lambda p: F.when(p.rlike(_GONE[kind]), F.regexp_replace(p, r"[^\n]+", "")).otherwise(p))
        return F.substring(F.array_join(kept, ""), 2, 1 << 30)

    return _Spark.choose([(lang.isin(*langs), by(kind)) for kind, langs in _KINDS.items()], by("other"))


def duck_strip_comments(text: str, lang: str) -> str:
    def by(kind: str) -> str:
        pieces = f"regexp_extract_all(chr(10) || {text}, {quote(PIECES[kind])})"
        return f"substr(array_to_string(list_transform({pieces}, lambda p: CASE WHEN regexp_matches(p, {quote(_GONE[kind])}) THEN regexp_replace(p, '[^\\n]+', '', 'g') ELSE p END), ''), 2)"

    return _Duck.choose([(_Duck.within(lang, langs), by(kind)) for kind, langs in _KINDS.items()], by("other"))


# -- boilerplate

#: Packages, headers and modules that come with the languages.
JAVA_PACKAGES = "java.lang java.util java.io java.nio java.net java.math java.text java.time java.awt java.swing javax.swing javax.servlet javax.xml javax.crypto java.applet java.beans java.security java.sql javafx org.junit org.hamcrest".split()
JAVA_ANNOTATIONS = "Override SuppressWarnings Deprecated FunctionalInterface SafeVarargs".split()
C_HEADERS = (
    "stdio.h stdlib.h string.h math.h ctype.h time.h assert.h limits.h float.h stddef.h stdint.h stdbool.h stdarg.h errno.h signal.h setjmp.h locale.h complex.h fenv.h inttypes.h iso646.h wchar.h wctype.h tgmath.h "
    "iostream fstream sstream string vector list map set unordered_map unordered_set queue stack deque array tuple pair algorithm numeric functional iterator memory utility typeinfo type_traits exception stdexcept "
    "cassert cmath cstring cstdlib cstdio ctime climits cctype chrono thread mutex condition_variable future regex random ratio atomic bitset initializer_list any optional variant filesystem windows.h pthread.h "
    "iomanip ios iosfwd ostream istream streambuf"
).split()
PYTHON_MODULES = (
    "os sys re math random time datetime collections itertools functools operator json csv io pathlib shutil glob typing abc copy enum dataclasses unittest pytest doctest string textwrap struct array heapq bisect "
    "queue threading multiprocessing subprocess socket http urllib hashlib logging argparse configparser pprint pickle shelve sqlite3"
).split()
JS_MODULES = "fs path http https os util stream events".split()


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"

#: Callees of output and input, and how their arguments must be for the call to say nothing about the program.
LABELS = {
    "java": ("System.out.*", "System.err.*"),
    "c": ("printf", "fprintf", "sprintf", "snprintf", "puts", "fputs", "perror", "putchar", "putc", "vprintf", "vfprintf"),
}  # literals alone
READS = {
    "c": ("scanf", "fscanf", "sscanf", "gets", "fgets", "getchar", "getc", "fflush"),
    "python": ("print",),
    "script": ("console.log", "console.warn", "console.error", "console.info", "console.debug"),
}  # anything
SCANNED = ("", "Line", "Int", "Double", "Float", "Long", "Short", "Byte", "Boolean")
GUARDED = {"java": ("null", ("null", "false", "true", "0", "-1", "0.0")), "c": ("NULL", ("NULL", "false", "true", "0", "-1"))}

JAVA, CC, PYTHON, SCRIPT = ("java", "mixed"), ("c", "cpp", "mixed"), ("python", "mixed"), ("javascript", "typescript", "mixed")
FAMILIES = {"java": JAVA, "c": CC, "python": PYTHON, "script": SCRIPT}


def _callee(names: tuple[str, ...]) -> str:
    """Dotted names; ``*`` stands for any last part."""
    return "(?:" + "|".join(re.escape(n).replace(r"\*", r"\w+") for n in names) + ")"


def _guard(nothing: str, values: tuple[str, ...]) -> str:
    """Leaving a function because an argument is missing."""
    told = "|".join(re.escape(v) if v.startswith("-") else " " + re.escape(v) for v in values)
    return rf"if\(\w+=={nothing}\)return(?:{told})?;"


#: What a line that only feeds or prints is, in its compact form: blanks only between words, every literal as "".
SILENT = {
    "java": [
        _callee(LABELS["java"]) + r'\((?:"")?\);',
        rf"(?:\w+=)?\w+\.next(?:{'|'.join(SCANNED)})\(\);",
        r"(?:(?:public|private|protected) )?(?:static )?void main\(String\[\]\w*\)(?:throws [\w ,]+)?\{?",
        _guard(*GUARDED["java"]),
        r"this\.\w+=\w+;",
    ],
    "c": [
        _callee(LABELS["c"]) + r'\((?:(?:std(?:err|out),)?"")?\);',
        _callee(READS["c"]) + r"\(.*\);",
        r"(?:std::)?(?:cin|clog)>>.*;",
        r'(?:std::)?(?:cout|cerr|clog)(?:<<(?:""|(?:std::)?endl))+;',
        r"using namespace \w+;",
        r"(?:int|void) main\([^{;]*\)\{?",
        _guard(*GUARDED["c"]),
    ],
    "python": [_callee(READS["python"]) + r"\(.*\)", r"(?:\w+=)?input\(.*\)"],
    "script": [_callee(READS["script"]) + r"\(.*\);?"],
}
_SILENT_HINT = {"java": "System|next|main|null|this", "c": "print|put|perror|scan|get|fflush|std|c(?:in|out|err|log)|using|main|NULL", "python": "print|input", "script": "console"}
_LITERAL = r""""[^"]*"|'[^']*'"""
_TIGHT = r"[ \t]*([^\w \t])[ \t]*"


class _Spark:
    """The few functions lines are judged by, as Spark columns."""

    replace = staticmethod(lambda c, p, by: F.regexp_replace(c, F.lit(p), F.lit(re.sub(r"\\(\d)", r"$\1", by))))
    extract = staticmethod(lambda c, p: F.regexp_extract(c, p, 1))
    like = staticmethod(lambda c, p: c.rlike(p))
    within = staticmethod(lambda c, words: c.isin(*words))
    trim = staticmethod(lambda c: F.trim(c))
    every = staticmethod(lambda c, sep, test: F.forall(F.split(c, sep), test))
    before = staticmethod(lambda c, sep: F.split_part(c, F.lit(sep), F.lit(1)))
    after = staticmethod(lambda c, sep: F.element_at(F.split(c, sep), -1))
    either = staticmethod(lambda *cs: reduce(lambda a, b: a | b, cs))
    both = staticmethod(lambda *cs: reduce(lambda a, b: a & b, cs))

    @staticmethod
    def choose(cases: list[tuple], other):
        out = other
        for test, value in reversed(cases):
            out = F.when(test, value).otherwise(out)
        return out

    @staticmethod
    def lines(c: Column, hint: str, compact, keep) -> Column:
        told = F.transform(F.split(c, "\n", -1), lambda x: F.struct(x.alias("x"), F.when(x.rlike(hint), compact(x)).alias("c")))
        return F.array_join(F.transform(told, lambda s: F.when(s["c"].isNull(), s["x"]).otherwise(keep(s["x"], s["c"]))), "\n")


class _Duck:
    """The same as SQL."""

    replace = staticmethod(lambda e, p, by: f"regexp_replace({e}, {quote(p)}, {quote(by)}, 'g')")
    extract = staticmethod(lambda e, p: f"regexp_extract({e}, {quote(p)}, 1)")
    like = staticmethod(lambda e, p: f"regexp_matches({e}, {quote(p)})")
    within = staticmethod(lambda e, words: f"{e} IN ({', '.join(map(quote, words))})")
    trim = staticmethod(lambda e: f"trim({e})")
    every = staticmethod(lambda e, sep, test: f"len(list_filter(string_split({e}, {quote(sep)}), lambda q: NOT ({test('q')}))) = 0")
    before = staticmethod(lambda e, sep: f"split_part({e}, {quote(sep)}, 1)")
    after = staticmethod(lambda e, sep: f"split_part({e}, {quote(sep)}, -1)")
    either = staticmethod(lambda *es: "(" + " OR ".join(es) + ")")
    both = staticmethod(lambda *es: "(" + " AND ".join(es) + ")")

    @staticmethod
    def choose(cases: list[tuple], other) -> str:
        return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in cases) + f" ELSE {other} END"

    @staticmethod
    def lines(e: str, hint: str, compact, keep) -> str:
        told = f"list_transform(string_split({e}, chr(10)), lambda x: {{'x': x, 'c': CASE WHEN regexp_matches(x, {quote(hint)}) THEN {compact('x')} END}})"
        return f"array_to_string(list_transform({told}, lambda s: CASE WHEN s.c IS NULL THEN s.x ELSE {keep('s.x', 's.c')} END), chr(10))"


def _compact(e, line, literals: bool):
    """A line without blanks but those between two words; its literals emptied if they do not matter."""
    if not literals:
        line = e.replace(line, _LITERAL, '""')
    return e.trim(e.replace(e.replace(line, _TIGHT, r"\1"), r"[ \t]+", " "))


def _nothing(e):
    return F.lit("") if e is _Spark else "''"


def _silent(e, family: str):
    test = "^(?:" + "|".join(SILENT[family]) + ")$"
    return _SILENT_HINT[family], lambda x: _compact(e, x, False), lambda x, c: e.choose([(e.like(c, test), _nothing(e))], x)


def _imported(e, family: str):
    """What is left of a line that brings in what comes with the language: a declaration goes up to its end, other lines as a whole."""
    if family == "java":
        name = lambda c: e.extract(c, r"^import (?:static )?([\w.]+(?:\.\*)?);")
        own = _any(JAVA_PACKAGES)
        standard = lambda c: e.either(e.like(name(c), rf"^{own}(?:\.|$)"), e.like(name(c), rf"^{own}.*\.\*$"))
        keep = lambda x, c: e.choose([(e.like(c, "^@" + _any(JAVA_ANNOTATIONS) + r"\b"), _nothing(e)), (e.either(e.like(c, r"^package [\w.]+;"), standard(c)), e.replace(x, r"^[^;]*;", ""))], x)
        return "@|package|import", lambda x: _compact(e, x, True), keep
    if family == "c":
        header = lambda c: e.extract(c, r'^#include[<"]([\w./]+)[>"]')
        guard = r"^#(?:pragma once|(?:ifndef|define|endif) \w+_H(?:PP|XX)?(?://.*)?)$"
        keep = lambda x, c: e.choose([(e.like(c, guard), _nothing(e)), (e.within(e.after(header(c), "/"), C_HEADERS), e.replace(x, r"""^[^<"]*[<"][^>"]*[>"]""", ""))], x)
        return "#", lambda x: _compact(e, x, True), keep
    if family == "python":
        source = lambda c: e.before(e.extract(c, r"^from ([\w.]+) import\b"), ".")
        listed = lambda c: e.extract(c, r"^import ([\w., ]+)$")
        root = lambda m: e.within(e.before(m, "."), PYTHON_MODULES)
        gone = lambda c: e.either(e.within(source(c), PYTHON_MODULES), e.every(listed(c), ",", root), e.like(c, r"""^if __name__==["']__main__["']:$"""))
        return "import|__main__", lambda x: _compact(e, x, True), lambda x, c: e.choose([(gone(c), _nothing(e))], x)
    module = rf"['\"](?:{_any(JS_MODULES)}|node:[^'\"]*)['\"]"
    gone = rf"^(?:import\b.*\bfrom{module};?|(?:const|let|var) \w+=require\({module}\);?)$"
    return "import|require", lambda x: _compact(e, x, True), lambda x, c: e.choose([(e.like(c, gone), _nothing(e))], x)


def _by_family(e, text, lang, told):
    """The judgement of each family's lines, by a text's language; all of them, one after another, where it is mixed."""
    every = text
    for family in FAMILIES:
        every = e.lines(every, *told(e, family))
    mine = [(e.within(lang, [x for x in langs if x != "mixed"]), e.lines(text, *told(e, family))) for family, langs in FAMILIES.items()]
    return e.choose([*mine, (e.within(lang, ["mixed"]), every)], text)


def without_imports(text: Column, lang: Column) -> Column:
    """Lines blanked that every program of the language has: package and import lines of what comes with it, guards, annotations, the main test."""
    return _by_family(_Spark, text, lang, _imported)


def duck_without_imports(text: str, lang: str) -> str:
    return _by_family(_Duck, text, lang, _imported)


def without_output(text: Column, lang: Column) -> Column:
    """Lines blanked that print labels, read input, begin ``main``, leave on null or keep an argument. A statement over several lines stays."""
    return _by_family(_Spark, text, lang, _silent)


def duck_without_output(text: str, lang: str) -> str:
    return _by_family(_Duck, text, lang, _silent)


def _answer(yes: str, no: str, by: str) -> Rule:
    """A condition returned by way of if and else; the line ends between its parts stay."""
    return Rule(rf"\bif[ \t]*\(([^)\n]+)\)(\s*)return[ \t]+{yes}[ \t]*;(\s*)else(\s+)return[ \t]+{no}[ \t]*;", by + r"\2\3\4")


CONTROL_FLOW = [
    *[Rule(rf"(\w+)[ \t]*{re.escape(sign * 2)}|{re.escape(sign * 2)}[ \t]*(\w+)", rf"\1\2 {sign}= 1") for sign in "+-"],  # a step on either side
    Rule(r"\b(\w+)[ \t]*([-+*/%])=[ \t]*([^\n;]+);", r"\1 = \1 \2 \3;"),
    _answer("true", "false", r"return \1;"),
    _answer("false", "true", r"return !(\1);"),
    Rule(r"\bnull[ \t]*([!=]=)[ \t]*(\w+)", r"\2 \1 null"),
]
HEADER = [Rule(r"^[ \t]*(?:import\b|package\b|from\b[^\n]+\bimport\b|#[ \t]*(?:include|define|pragma|ifndef|ifdef|endif)\b|using[ \t]+namespace\b|using\b[^\n]+;|extern[ \t]+\"C\")[^\n]*$")]


def canonical(text: Column, lang: Column) -> Column:
    """A file's text as it is fingerprinted, line by line in the place of the original's."""
    t = apply_rules(text, NEWLINES + CONTROLS)
    t = strip_comments(t, lang)
    t = without_imports(t, lang)
    t = apply_rules(t, CONTROL_FLOW + TRAILING)
    return without_output(t, lang)


#: Lines that carry no code of their own.
TRIVIAL_LINES = ("{", "}", "};", "{;", "});", "})")
TRIVIAL_TEMPLATE = ("{", "}", "};", "*/", "*", "/*", "//")


def meaningful(line: Column) -> Column:
    return (F.trim(line) != "") & ~F.trim(line).isin(*TRIVIAL_LINES)


# -- paths


def clean_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``, with forward slashes."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda x: ~x.isin("", ".", "..")), "/")
