"""Text rewrites, tokens and fingerprints against plain models."""

import random

from pyspark.sql import functions as F

from codesim.functions import fingerprints as P
from codesim.functions import text as T
from codesim.functions import tokens as K


def rewrite(spark, f, texts, lang="java"):
    df = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "i int, text string, lang string")
    return [r.t for r in df.select("i", f(F.col("text"), F.col("lang")).alias("t")).orderBy("i").collect()]


def test_comments_go_and_strings_stay(spark):
    src = 'int a; // x\nString s = "// no"; /* b\n c */ char q = \'"\';\n"a\\"/*"'
    got = rewrite(spark, T.strip_comments, [src, "", None, "/* open", "'open // x"])
    assert got[0] == 'int a; \nString s = "// no"; \n char q = \'"\';\n"a\\"/*"'
    assert got[1:] == ["", None, "", "'open // x"]
    assert rewrite(spark, T.strip_comments, ["#include <a>\nint a;\n  #define X \\\n 3\nx"], "c") == ["\nint a;\n\n\nx"]
    assert rewrite(spark, T.strip_comments, ['def f():\n  """doc\n  x"""\n  return "#" # c'], "python") == ['def f():\n  \n\n  return "#" ']


def test_rewrites_keep_lines(spark):
    src = "package a.b;\r\nimport java.util.List;\r\nimport my.Own;\r@Override\n  i++;\n x += 2;\n if (a) return true; else return false;\n null != x;\t\n"
    one = rewrite(spark, lambda t, lang: T.canonical(t, lang), [src])[0]
    assert one.split("\n") == ["", "", "import my.Own;", "", "  i += 1;".replace("i += 1;", "i = i + 1;"), " x = x + 2;", " return a;", " x != null;", ""]


def test_boilerplate(spark):
    assert rewrite(spark, lambda t, lang: T.without_output(t, lang), ['  System.out.println("x");\n  System.out.println("x" + y);', "this.a = b;"]) == ['\n  System.out.println("x" + y);', ""]
    py = "import os, sys\nimport os, mine\nfrom math import pi\nprint(x)"
    assert rewrite(spark, lambda t, lang: T.without_output(T.without_imports(t, lang), lang), [py], "python") == ["\nimport os, mine\n\n"]


def test_languages_and_paths(spark):
    df = spark.createDataFrame([("A.JAVA", ""), ("x.h", ""), ("Makefile", "#include <a>\nint main() {"), ("b", "#include <a>\nclass X {"), ("c", "plain"), ("s.py", None)], "file string, text string")
    assert [r[0] for r in df.select(T.file_lang(F.col("file"), F.col("text"))).collect()] == ["java", "c", "c", "cpp", "mixed", "python"]
    df = spark.createDataFrame([("../../etc/passwd",), ("a\\..\\b//c/./d",), ("",)], "p string")
    assert [r[0] for r in df.select(T.clean_path(F.col("p"))).collect()] == ["etc/passwd", "a/b/c/d", ""]


def tokens(spark, text, lang="java"):
    df = spark.createDataFrame([("s", "f", lang, text)], "sub_id string, file string, lang string, text string")
    return K.token_table(df, ["sub_id", "file"]).orderBy("pos").collect()


def test_token_classes_and_lines(spark):
    got = tokens(spark, 'public int f(int x) {\n  while (x >>= 0x1F) y = "a\\"b" + \'c\' + 1.5e3;\n  ArrayList z;\n}')
    assert [t.raw for t in got if t.norm is None] == ["public"]
    assert [t.norm for t in got if t.norm][:8] == ["int", "ID", "(", "int", "ID", ")", "{", "LOOP"]
    by = {t.raw: t for t in got}
    assert by["0x1F"].norm == "NUM" and by['"a\\"b"'].norm == "STR" and by["'c'"].norm == "CHR" and by["1.5e3"].norm == "NUM" and by["ArrayList"].norm == "TYPE"
    assert by[">>="].line == 2 and by["ArrayList"].line == 3 and [t.pos for t in got] == list(range(len(got)))
    block = tokens(spark, '"""a\nb""" x\n# --- f ---\ny')
    assert [(t.norm, t.line) for t in block] == [("STR", 1), ("ID", 2), ("ID", 4)]
    assert tokens(spark, "") == [] and tokens(spark, None) == []
    assert [t.raw for t in tokens(spark, "x # y\nz", "python")] == ["x", "z"]


def naive_hash(toks):
    h = 0
    for t in toks:
        for c in t:
            h = (h * 31 + ord(c)) % ((1 << 61) - 1)
        h = (h * 31 + 0x7F) % ((1 << 61) - 1)
    return h


def test_gram_hashes_and_winnowing():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 40):
        toks = [rng.choice(["ID", "=", "NUM", "é", "x" * 30]) for _ in range(n)]
        for k in (1, 3, 8):
            assert P.gram_hashes(toks, k) == [naive_hash(toks[i : i + k]) for i in range(n - k + 1)]
    for _ in range(200):
        hs = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        w = rng.randrange(1, 8)
        want = []
        for i in range(len(hs) - w + 1):
            best = max(p for p in range(i, i + w) if hs[p] == min(hs[i : i + w]))
            if not want or want[-1] != best:
                want.append(best)
        assert P.winnowed(hs, w) == (want if len(hs) >= w else list(range(len(hs))))
    assert len(set(P.gram_hashes(["a"] * 50, 8))) == 1


def test_stream_and_function_k(spark):
    assert [P.stream_k(n) for n in (0, 1799, 1801, 5000)] == [(8, 4), (8, 4), (9, 4), (15, 7)]
    ns = [5, 19, 20, 49, 50, 149, 150, 299, 300, 600, 100000]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    assert [r[0] for r in df.select(P.function_k(F.col("n"))).collect()] == [3, 3, 5, 5, 8, 8, 12, 12, 15, 16, 18]


def test_shared_run_is_found():
    rng = random.Random(5)
    for _ in range(50):
        shared = [str(rng.random()) for _ in range(11)]
        a = [str(rng.random()) for _ in range(20)] + shared + [str(rng.random()) for _ in range(9)]
        b = [str(rng.random()) for _ in range(5)] + shared
        fa, fb = ({P.gram_hashes(s, 8)[p] for p in P.winnowed(P.gram_hashes(s, 8), 4)} for s in (a, b))
        assert fa & fb


def test_very_long_texts(spark):
    long = 'x = "' + "\\n" * 60_000 + '"; // ' + "c" * 100_000 + "\n/*" + "*" * 100_000 + "*/ y"
    got = rewrite(spark, T.strip_comments, [long, "'" * 99_999, "#define A \\\n" * 20_000], "c")
    assert got[0].endswith('"; \n y') and got[1] == "'" * 99_999 and got[2] == "\n" * 20_000
    assert [t.norm for t in tokens(spark, got[0])] == ["ID", "=", "STR", ";", "ID"]


def test_lines_of_each_language(spark):
    both = lambda t, lang: T.without_output(T.without_imports(t, lang), lang)
    java = 'package a . b ;\nimport static java.util.Arrays.*; int x;\nimport java.utilx.Own;\nimport javafx.*;\n@Override public void f()\nSystem . err.print ( );\n  int y = in.nextInt();\nn = s.next();\nif (x == null) return -1;\nif (x == null) return y;\npublic static void main(String[] args) throws E, F {\nSystem.out.println(\n"x");'
    assert rewrite(spark, both, [java])[0].split("\n") == ["", " int x;", "import java.utilx.Own;", "", "", "", "  int y = in.nextInt();", "", "", "if (x == null) return y;", "", "System.out.println(", '"x");']
    c = '#include <sys/string.h> // a\n#include "mine.h"\n# pragma once\n#ifndef A_HPP\nprintf ( "a" ) ;\nfprintf(stderr, "x");\nprintf("%d", x);\nscanf("%d", &x);\nstd :: cout << "a" << std::endl;\ncout << x;\nusing namespace std;\nint main(void) {\nif (p == NULL) return;'
    want = [" // a", '#include "mine.h"', "", "", "", "", 'printf("%d", x);', "", "", "cout << x;", "", "", ""]
    assert rewrite(spark, both, [c], "cpp")[0].split("\n") == want
    js = "import * as fs from 'fs';\nimport x from './x'\nconst p = require( 'node:zlib' )\nconsole . log (x, y)\nlet q = f(1);"
    assert rewrite(spark, both, [js], "typescript")[0].split("\n") == ["", "import x from './x'", "", "", "let q = f(1);"]
    python = "import os.path as p, re\nimport os as o\nfrom math import *\nfrom .math import x\nif __name__ == '__main__':\nx = input('?')\nx = 1"
    assert rewrite(spark, both, [python], "python")[0].split("\n") == ["", "import os as o", "", "from .math import x", "", "", "x = 1"]
    mixed = 'import java.io.File;\n#include <stdio.h>\nimport os\nprint(x)\nconsole.log(1)'
    assert rewrite(spark, both, [mixed, "", None], "mixed") == ["\n" * 4, "", None]
    assert rewrite(spark, both, [mixed], "go") == [mixed]


def test_control_flow_keeps_lines(spark):
    src = "i ++; ++j; a[k]--;\nx *= y + 1; z -= 2;\nif (a)\n  return true;\nelse\n  return false;\nif (b) return false; else return true;\nif (null == p && null != q)"
    want = "i = i + 1; j = j + 1; a[k]--;\nx = x * y + 1; z = z - 2;\nreturn a;\n  \n\n  \nreturn !(b);   \nif (p == null && q != null)"
    got = rewrite(spark, lambda t, lang: T.apply_rules(t, T.CONTROL_FLOW), [src])[0]
    assert got.count("\n") == src.count("\n")
    assert [x.strip() for x in got.split("\n")] == [x.strip() for x in want.split("\n")]


def test_ruby_comments_and_raw_strings(spark):
    ruby = 'x = "a # b" # c\n=begin\n y\n=end z\np \'#\'#d\n'
    assert rewrite(spark, T.strip_comments, [ruby], "ruby") == ['x = "a # b" \n\n\n\np \'#\'\n']
    got = tokens(spark, 'auto s = R"xy(a )z" b\n)xy" + t;', "cpp")
    assert [t.raw for t in got] == ["auto", "s", "=", 'R"xy(a )z" b\n)xy"', "+", "t", ";"] and got[-1].line == 2
