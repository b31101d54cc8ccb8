"""Syntax of source files: grammars, chunks and tables."""

import random

import pytest
from pyspark.sql import functions as F

from codesim.llm import syntax as S

GOOD = {
    "java": [
        "class A { }",
        "package a.b; import java.util.*; import static a.B.c; public class A<T extends B & C> extends D<T> implements E, F<G<H>> { private final int x = 1, y[] = {1, 2,}; A(int... a) throws X { super(a); this.x = a[0]; } }",
        'class A { void f() { for (int i = 0, j = 1; i < 3 && j > 2; i++, --j) { if (i >= 2) continue; else if (x) break; else { } } for (final String s : xs) g(s); while (true); do { i <<= 2; } while (i < 3); } }',
        "class A { int f(Object o) { try (var r = open(); s) { return (int) r.x; } catch (A | B e) { throw new X(e) { int y; }; } finally { } } abstract <T> List<? extends T> g(); static { } { } }",
        'enum E implements I { A(1) { void f() { } }, B, ; int x; } interface I { default void f() { } int g() throws X; } @interface Q { int v() default 3; String[] w() default {"a"}; }',
        'record P(int x, String... y) implements I { P { } } class A { Object f(int k) { return switch (k) { case 1, 2 -> "a"; case 3 -> { yield x; } default -> throw new E(); }; } }',
        "class A { void f() { Runnable r = () -> { }; g(x -> x + 1, (a, b) -> a, String::length, int[]::new, A.B<C>::new); int[][] m = new int[3][]; var z = new int[] {1}; Object o = (Runnable & S) () -> f(); } }",
        'class A { String s = """\n  "quoted" \\""" }\n"""; char c = \'\\u0041\', d = \'{\'; /* } */ // }\n }',
        "class A { boolean f(Object o) { switch (x) { case 1: case 2: f(); break; default: } label: for (;;) { break label; } synchronized (this) { } assert x : y; return o instanceof String s && !(o instanceof Integer) ? a : b; } }",
        "@A(x = 1, y = {@B, @C(2)}) class D { @Override public final synchronized void f(@N final int a) { int x = y = 3; x++; (x)++; a.b.c[3].d(1)[2] = 4; new A().b(); A.super.f(); int i = 1_000L + 0x1FL + 0b11 + 1e-3f; } }",
        ";", "// only a comment",
    ],
    "c": [
        "int main(void) { return 0; }",
        "#include <stdio.h>\n#define X(a) \\\n  ((a) + 1)\n#if 0\n}}}\n#else\nint y;\n#endif\nstatic const char *const s = \"a\" \"b\\\"\", *t[] = {\"x\", [2] = \"y\"};",
        "typedef struct node { int v : 3; struct node *next; union { int a; float b; }; } node_t; enum e { A = 1, B, }; int (*fp)(int, char *), *g(void), (*arr[3])(void);",
        "void f(int n, char a[static 3], ...) { for (;;) { if (n) goto end; } switch (n) { case 1: n = 2; break; default: n--; } do n++; while (n < 3); end: ; { int x = (int) n * sizeof(int) + sizeof x; struct p q = { .x = 1, .y = { 2 } }; *a = (n) ? -n : ~n, n ^= 1; } }",
        "unsigned long long x = 0xFFull, y = 1.5e-3f, z = 'ab'; size_t n = (size_t) -1; my_t *p = (my_t *) malloc(sizeof *p); _Static_assert(1, \"x\");",
        "int a[3][4]; extern int f(), g(int); inline static int h(register int x) { int (*q)[3] = &a; return q[0][1] + (*fp)(x) + s->p.q[1]++ - --x; }", "/* } */ // {\n",
    ],
    "cpp": [
        "#include <vector>\nusing namespace std; namespace a::b { template <typename T, int N = 3, class... R> class V : public std::vector<T>, private W<N> { public: V() : x(1), y{2} { } virtual ~V() = default; V(const V &) = delete; T operator[](int i) const override { return p[i]; } operator bool() const; friend class Q; private: int x = 0, y; T *p; }; }",
        "auto f(int &&x, const std::string &s = \"a\") -> decltype(x) { auto g = [&, x, this](auto y) mutable -> int { return y; }; for (const auto &[k, v] : m) { std::cout << k << v << std::endl; } return static_cast<int>(x) + std::max<int>(1, 2); }",
        "int main() { std::map<int, std::vector<std::pair<int, int>>> m{{1, {}}}; int *p = new int[3], *q = new A(1, 2); delete[] p; try { throw X(\"a\"); } catch (const E &e) { } catch (...) { throw; } if (auto it = m.find(1); it != m.end()) { } if constexpr (true) { } while (int c = get()) { } }",
        "extern \"C\" { int f(void); } enum class C : char { A, B = 'x' }; struct S; template <> struct S2<int> { static constexpr int n = 1'000'000; }; std::string A::b(int x) const noexcept { return R\"d(} \" )d\"; } A::A(int x) : B(x) { } A::~A() { } bool operator==(const A &a, const A &b) { return a.x == b.x; }",
        "typedef std::vector<int> vi; using T = std::function<void(int, int)>; vi v(3), w{1, 2}; constexpr double pi = 3.14; [[nodiscard]] static inline int f(int) { return nullptr == 0 ? 1 : 2; } class K : public B<int> { int a[3]; int b : 2; public: explicit K(int = 3); void g() &&; };",
        "int f(void) { return g(3) % 2; }",
    ],
    "python": ["", "x = 1\n", "def f(a, *, b: int = 3, **k) -> int:\n    '''doc {'''\n    match a:\n        case [1, *r] if r: return r\n    return f'{a!r:>{b}}'\n", "async def g():\n    async with a as b, c:\n        await x\n", "if True:\n\tx\nelse:\n\ty\n"],
}
BAD = {
    "java": ["class A {", "class A { } }", "class A { void f() { int x = ; } }", "class A { void f() { x + 1; } }", "class A { void f() { if (x { } } }", "class A { void f() { return return; } }", "class A { int f( { } }", "<<<<<<< HEAD\nclass A { }\n=======\nclass B { }\n>>>>>>> x", 'class A { String s = "x; }', "class A { /* }", "class A { char c = ''; }", "import a.b; package c;", "class A { } import b;", "#include <a>\nint main() { }", "def f():\n  pass", "int x = 1;", "class A { void f() { else { } } }", "class A { void f() { try { } } }", "class A { void f() { case 1: } int; }", "class A { void f() { foo() } }", "class A { void f() { x = “a”; } }", "class A { int x = 1x; }", "class A { void f() { for (int i = 0; i &lt; 3; i++) { } } }", "a\ufffdb", "class A { String s = \"\\q\"; }", "Dear all, see the notes.", "class A { void f() { f(a b); } }", "class A { void f() { int a[ = 3; } }", "class A { void f() { do { } } }"],
    "c": ["int main() {", "int main() } {", "int f() { return 0 }", "x = 1;", "return 3;", "int f() { if x { } }", "#include stdio.h\nint x;", "#endif\nint x;", "#if 1\nint x;", "#frob\n", 'char *s = "x\n";', "int f() { a ++ b; }", "public class A { }", "import java.util.*;", "int f() { int x = (3; }", "int f() { 1 = ; }", "std::vector<int> v;", "class A { };", "int f() { else x; }", "int f() { printf(“a”); }", "struct { int a }", "int f(int a, ) { }", "print('x')", "int x = 08x;", "int f() { for (i = 0; i < 3) { } }"],
    "cpp": ["int main() {", "class A { public int x; };", "class A { }", "int f() { std::cout << ; }", "template <typename T class A { };", "public class A { }", "int f() { throw }", "namespace a { int x;", "int f() { [x { return 1; }; }", "int f() { catch (...) { } }", "=======\nint x;", "int f() { while (x &lt; 3) { } }", "for (;;) { }", "int f() { new; }", "#include <a>\nusing namespace;"],
    "python": ["def f(:\n", "if x\n  y", "  x = 1\ny = 2\n z", "print 'x'", "x = (", "x = 'a\n", "<<<<<<< HEAD\n", "// c\nint x;", "def f():\n", "a\x00b"],
}


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, ts in GOOD.items() for t in ts])
def test_good(lang, text):
    assert S.valid(text, lang) and S.valid("\ufeff" + text, lang) and S.valid(text.replace("\n", "\r\n"), lang)


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, ts in BAD.items() for t in ts])
def test_bad(lang, text):
    assert not S.valid(text, lang)


def test_statements_alone_decide_as_the_whole_grammar():
    rng = random.Random(3)
    for lang in ("java", "c", "cpp"):
        for text in GOOD[lang] + BAD[lang]:
            for cut in range(20):
                t = text if not cut else text[: rng.randrange(len(text) + 1)] + text[rng.randrange(len(text) + 1) :]
                s = S.shape(S.blanked(t, lang), lang).strip()
                if S.WRONG not in s and S.settled(s, lang):
                    assert S.derives(s, lang), t


def test_chunks_do_not_matter():
    rng = random.Random(7)
    pieces = ["int a;\n", "/* x\n y\n*/\n", 'char *s = "a // b";\n', "int f() {\n", "}\n", "// }\n", "#define A \\\n 1\n", "'{';\n", "x = 1;\n", "/*\n", "*/\n", '"""\n', 'R"(\n', ')"\n', 'R"d(\n', ')d";\n', '"\n']
    for lang in ("java", "c", "cpp"):
        for _ in range(300):
            t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
            whole = S.whole([S.summary(t, lang)])
            for size in (1, 9, 30):
                cut = S.chunks(t, size)
                assert "".join(cut) == t
                parts = S.whole([S.summary(c, lang) for c in cut])
                assert S.valid_blanked(parts, lang) == S.valid_blanked(whole, lang), (lang, size, t)


def test_composition_is_associative():
    t = ['a /* "\n', 'b */ R"x(\n', ')x" c\n', "/* d\n", '")"\n']
    a, b, c, d, e = (S.summary(x, "cpp") for x in t)
    left = S.composed(S.composed(S.composed(S.composed(a, b), c), d), e)
    right = S.composed(a, S.composed(b, S.composed(c, S.composed(d, e))))
    assert left["code"] == right["code"] and left["comment"] == right["comment"]


def test_balance():
    assert S.balance("( [ ] ) }") == ("}", "") and S.balance("{ (") == ("", "{(") and S.balance("( ]") is None


def test_deep_and_long():
    assert S.valid("int x = " + "(" * 300 + "1" + ")" * 300 + ";", "c")
    assert S.valid("int f() { " + "{" * 300 + "}" * 300 + " }", "c")
    assert not S.valid("(" * 200_000, "java") and not S.valid("{" * 200_000, "c")
    assert S.valid("int x;\n" * 100_000, "c") and not S.valid("int x;\n" * 100_000 + "}", "c")
    for text in ("(" * 300 + "1" + ")" * 300, "(T) " * 300 + "1", "a" + "<b" * 300, "f([&](int a) { return " * 60 + "1" + "; })" * 60, "a ? " * 300 + "1" + ": 2" * 300):
        assert S.valid(f"int x = {text};", "cpp")
    assert not S.valid("int x;\n" * 30_000 + "x = ;", "c") and not S.valid("x(" * 50_000, "cpp")
    assert isinstance(S.valid("(" * 50_000 + ")" * 50_000, "python"), bool)


def test_tables(spark, monkeypatch):
    files = spark.createDataFrame(
        [(1, "s1", "A.java", "class A {", "r"), (2, "s1", "A.JAVA", "class A { }", "r"), (3, "s2", "x.bak", "int x", "r"), (4, "s2", "README", "int x;", None), (5, "s3", "y.orig", "}", "r"), (6, "s1", "e.c", "", "r"), (7, "s1", "e.c", None, "r"), (8, "s1", "e.py", " \n", "r"), (9, None, "z.h", "int f( {", "q"), (9, None, "z.h", "int f( {", "q"), (10, "s1", None, "}", "q"), (11, "s1", "big.c", "int x;\n" * 60_000 + "/*", "q"), (12, "s1", "big.c", "int x;\n" * 60_000, "q"), (13, "s1", "w.py", "if x", "q")],
        "file_id bigint, sub_id string, file string, text string, repository_id string",
    ).withColumn("lang", F.lit("clash"))
    subs = spark.createDataFrame([("s1", "a1"), ("s1", "a1"), ("s2", "a2"), ("s3", "a3"), ("s3", None)], "sub_id string, assignment_id string")
    assignments = spark.createDataFrame([("a1", None), ("a1", " Java "), ("a2", "c"), ("a3", "cobol")], "assignment_id string, language string")
    assert sorted(r.file_id for r in S.broken_files(files.drop("lang"), subs, assignments).collect()) == [1, 3, 9, 10, 11, 13]
    assert sorted(r.file_id for r in S.broken_files(files, subs, assignments).collect()) == [1, 3, 9, 10, 11, 13]
    rates = {(r.repository_id, r.lang): (r.files, r.broken) for r in S.broken_rates(files, subs, assignments).collect()}
    assert rates["r", "java"] == (2, 1) and rates["q", "c"] == (3, 2) and rates[None, "c"] == (1, 0)
    assert S.broken_files(files.limit(0), subs, assignments).count() == 0
    assert S.broken_files(files, subs.limit(0), assignments.limit(0)).count() == 4


def test_python_lines_decide_as_the_whole_grammar():
    import ast
    import warnings

    warnings.simplefilter("ignore")
    rng = random.Random(13)
    src = "import a.b as c, d\n@dec(1)\nclass A(B):\n    x = [1, 2,\n         3]\n    def f(self, y=2, *z):\n        if y == 1 and not z:\n            return y ** 2 // 3\n        elif y:\n            pass\n        else:\n            y += lambda q: q\n        try:\n            del y\n        except E as e:\n            raise\n        finally:\n            print('a', \"b\")\n        for i in range(3):\n            continue\n        else:\n            x = {i: 1 for i in y}\n        while x:\n            break\n        with open(x) as g:\n            yield g\n"
    settled = 0
    for k in range(6000):
        a, b = sorted(rng.randrange(len(src) + 1) for _ in range(2))
        t = src if not k else src[:a] + rng.choice(["", " ", "\n", "(", ")", ":", "'", '"""', "#", "else:", "try:\n", "@x\n", "  ", "\t", "\\\n", "=", "=", "1x"]) + (src[b:] if rng.random() < 0.5 else src[a:])
        blanked = S.whole([S.summary(c, "python") for c in S.chunks(t, rng.choice([20, 10**6]))])
        if S.python_settled(blanked):
            settled += 1
            ast.parse(t)
        else:
            assert k, "the sound text is settled line by line"
    assert settled > 100


def test_depth_is_no_excuse():
    n = 20_000
    for lang, head, tail in (("java", "class A { int f() { return ", "; } }"), ("c", "int f(int x) { return ", "; }"), ("cpp", "int f(int x) { return ", "; }")):
        for a, b in (("(", ")"), ("f(", ")"), ("- ", ""), ("(int)", ""), ("x ? 1 : ", "")):
            assert S.valid(head + a * n + "1" + b * n + tail, lang) is True, (lang, a)
            assert S.valid(head + a * n + "1 + " + b * n + tail, lang) is False, (lang, a)
    assert S.valid("int f(int x) { " + "if (x) {" * n + "x++;" + "}" * n + " }", "c") is True
    for text in ("x = " + "-" * 200_000 + "1{}\n", "x = " + "not " * 200_000 + "1{}\n", "x = " + "1 + " * 200_000 + "1{}\n", "x = " + "1 if 1 else " * 100_000 + "1{}\n", "x = a" + ".b" * 100_000 + "{}\n"):
        assert S.valid(text.format(""), "python") is True, text[:20]
        assert S.valid(text.format(" +"), "python") is False, text[:20]


def test_undecided_is_neither(monkeypatch):
    monkeypatch.setattr(S, "derives", lambda *_: None)
    monkeypatch.setattr(S, "settled", lambda *_: None)
    assert S.valid("int x;", "c") is None and S.valid("int x; }", "c") is False


def test_long_files_are_reduced_from_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 400)
    java = "class A {\n" + "".join(f'  /* {i}\n " */ int f{i}(int x) {{ return "}}" + x; }}\n  String s{i} = """\n   a }} {{\n  """;\n' for i in range(40)) + "}\n"
    cpp = "#include <a(>\n" + "".join(f'int f{i}(int x) {{ auto s = R"k(a }} )" \n)k"; return x; }}\n' for i in range(40))
    py = "".join(f'def f{i}(x):\n    """a (\n    b"""\n    return [x,\n      f"{{x}}", b"\\x41"]\n' for i in range(40))
    good = {"java": java, "cpp": cpp, "python": py}
    rows = []
    for lang, t in good.items():
        half = len(t) // 2
        at = t.index("x;" if lang != "python" else "return", half)
        bad = [t + "}", t[: t.rindex("x")], t[:at] + ")" + t[at:], "(" + t, t[: t.rindex("*/")] if lang == "java" else t + '"', t[:at] + " + ; " + t[at:]]
        rows += [(len(rows) + i, x, lang, i == 0) for i, x in enumerate([t, *bad])]
    assert all(len(r[1]) > 1000 for r in rows)
    df = spark.createDataFrame(rows, "file_id int, text string, lang string, want boolean")
    got = {r.file_id: r.ok for r in S.parsed(df, "file_id", "text", "lang").collect()}
    assert got == {r[0]: r[3] for r in rows}
    assert {k: S.valid(t, lang, 400) for k, t, lang, _ in rows} == {k: S.valid(t, lang, 10**9) for k, t, lang, _ in rows} == got


def test_local_verdicts_are_those_of_the_whole_grammar():
    rng = random.Random(11)
    texts = [("java", "package a;\nclass A<T> {\n int x = 1;\n void f(int y) throws E {\n  for (int i = 0; i < 3; i++) { if (y > i) x += y; else f(y); }\n  try { g(); } catch (E e) { h(e); }\n  do { x--; } while (x > 0);\n }\n}\n"), ("c", "#include <a.h>\nstruct s { int a; };\nint f(int a[], char *b) {\n  switch (*b) { case 1: a[0] = 2; break; default: return 1; }\n  while (a[0]) a[0]--;\n  return 0;\n}\n"), ("cpp", "template <class T> class B : A {\npublic:\n  B() : x(1) {}\n  int g() const { auto h = x + 1; return h; }\n  int x;\n};\n")]
    seen = set()
    for lang, text in texts:
        for _ in range(1500):
            t = list(text)
            for _ in range(rng.choice([1, 1, 2, 3])):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(2)] = rng.choice(["", ";", "{", "}", "(", ")", "x", "+", "=", " ", "int "])
            s = S.shape(S.whole([S.summary("".join(t), lang)]), lang).strip()
            local = S.settled(s, lang)
            seen.add((lang, local))
            if S.WRONG not in s and local is not None:
                assert local == (S.balance(s) == ("", "") and S.derives(s, lang)), "".join(t)
    assert len(seen) == 9


def test_rates(spark):
    rows = [(1, "r", "c", "int x;"), (2, "r", "c", "int x"), (2, "r", "c", "int x"), (3, "r", "java", "class A {}"), (4, None, "c", "int f( {"), (5, "q", "c", " "), (6, "q", "c", None)]
    files = spark.createDataFrame([(i, "s", r, f"a.{e}", t) for i, r, e, t in rows], "file_id bigint, sub_id string, repository_id string, file string, text string")
    none = spark.createDataFrame([], "sub_id string, assignment_id string, language string")
    got = {tuple(r) for r in S.broken_rates(files, none, none).collect()}
    assert got == {("r", "c", 2, 1, 0.5), ("r", "java", 1, 0, 0.0), (None, "c", 1, 1, 1.0)}
