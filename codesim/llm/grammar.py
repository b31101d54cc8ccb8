"""Local grammars of Java, C and C++ over shapes of source text.

A shape is a list of words: keywords as they are, ``i`` for names, ``n`` for numbers, ``S`` and ``C``
for string and character literals, and the punctuators. ``Parser`` decides whether a
shape derives from the language's grammar; names and types need not resolve, so what is
ambiguous without them (declaration or expression, cast or parenthesis) passes if
either reading does.
"""

from __future__ import annotations

import re
import sys

#: The reserved words of the languages, and words that are special in places only.
C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local"
CPP_WORDS = "alignas alignof asm auto bool break case catch char char8_t char16_t char32_t class const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while concept requires"
CPP_SPECIAL = "override final"
JAVA_WORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
JAVA_SPECIAL = "var record yield sealed permits when non"
KEYWORDS = {"c": frozenset(C_WORDS.split()), "cpp": frozenset((CPP_WORDS + " " + CPP_SPECIAL).split()), "java": frozenset((JAVA_WORDS + " " + JAVA_SPECIAL).split())}
SPECIAL = {"c": frozenset(), "cpp": frozenset(CPP_SPECIAL.split()), "java": frozenset(JAVA_SPECIAL.split())}

C_TYPES = frozenset("void char short int long float double signed unsigned bool wchar_t char8_t char16_t char32_t _Bool _Complex".split())
C_QUALIFIERS = frozenset("const volatile restrict static extern register inline typedef auto mutable virtual explicit constexpr consteval constinit friend thread_local _Thread_local _Noreturn _Atomic".split())
JAVA_TYPES = frozenset("boolean byte char short int long float double".split())
JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
BINARY = frozenset("+ - * / % & | ^ << >> >>> && || == != < > <= >= <=> .* ->*".split())
DEEPEST = 2_000_000  # calls of the parser inside each other; about 200 bytes each
PREFIX = frozenset("+ - ! ~ ++ --".split())

WORD = re.compile(r"[A-Za-z_0-9]+|>>>=|<<=|>>=|>>>|->\*|\.\.\.|<=>|\.\*|->|::|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|>>|[^\s]")
JAVA_WORD = re.compile(r"[A-Za-z_0-9]+|>>>=|<<=|>>=|>>>|\.\.\.|->|::|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|>>|[^\s]")


class Bad(Exception):
    """The shape does not derive."""


class Parser:
    """A recursive descent over one shape. ``opened`` maps places of ``{`` to what they begin: func, class, file, or other."""

    def __init__(self, shape: str, lang: str) -> None:
        self.t = (JAVA_WORD if lang == "java" else WORD).findall(shape) + ["", "", "", ""]
        self.n = len(self.t) - 4
        self.p = 0
        self.lang, self.java = lang, lang == "java"
        self.special = SPECIAL[lang]
        self.opened: dict[int, str] = {}
        self.undo: list[tuple[int, str]] = []  # words that were cut, for going back
        self.tried: dict[tuple, int] = {}  # attempts: where they ended, -1 where they failed
        self.arrows: dict[int, bool] | None = None

    # -- words

    def name(self) -> bool:
        w = self.t[self.p]
        return w == "i" or w in self.special

    def take(self, word: str) -> bool:
        if self.t[self.p] == word:
            self.p += 1
            return True
        return False

    def need(self, word: str) -> None:
        if self.t[self.p] != word:
            raise Bad
        self.p += 1

    def need_name(self) -> None:
        if not self.name():
            raise Bad
        self.p += 1

    def open(self, kind: str) -> None:
        if self.t[self.p] != "{":
            raise Bad
        self.opened[self.p] = kind
        self.p += 1

    def attempt(self, rule, *args) -> bool:
        """Try a rule; on failure go back."""
        p, kept = self.p, len(self.undo)
        key = (rule.__name__, args, p, kept, self.undo[-1] if kept else None)
        known = self.tried.get(key)
        if known is not None:  # no text makes alternatives inside alternatives run again and again
            if known < 0:
                return False
            self.p = known
            return True
        try:
            rule.__func__(*(self, *args))  # called as a function, so that depth costs memory, not the interpreter's own stack
            if len(self.undo) == kept:
                self.tried[key] = self.p
            return True
        except Bad:
            self.p = p
            while len(self.undo) > kept:
                at, word = self.undo.pop()
                self.t[at] = word
            self.tried[key] = -1
            return False

    def close_angle(self) -> None:
        """One ``>``, also of a longer punctuator."""
        w = self.t[self.p]
        if w == ">":
            self.p += 1
        elif w in (">>", ">>>", ">=", ">>=", ">>>="):
            self.undo.append((self.p, w))
            self.t[self.p] = w[1:]
        else:
            raise Bad

    def items(self, ctx: str) -> None:
        """All of the shape as items of a context."""
        one = {"file": self.file_item, "class": self.member, "func": self.statement}[ctx]
        while self.p < self.n:
            one()

    def body(self, kind: str, one) -> None:
        self.open(kind)
        while not self.take("}"):
            if self.p >= self.n:
                raise Bad
            one()

    def block(self) -> None:
        self.body("func", self.statement)

    # -- types

    def type_args(self) -> None:
        self.need("<")
        if self.t[self.p][:1] != ">":
            while True:
                if self.java:
                    self.annotations()
                    if self.take("?"):
                        if self.take("extends") or self.take("super"):
                            self.type()
                    else:
                        self.type()
                        while self.take("&"):
                            self.type()
                else:
                    if not (self.attempt(self.template_type_arg)):
                        self.conditional(True)
                    self.take("...")
                if not self.take(","):
                    break
        self.close_angle()

    def template_type_arg(self) -> None:
        self.type_id()
        w = self.t[self.p]
        if w not in (",", "...") and w[:1] != ">":
            raise Bad

    def qualified(self) -> None:
        """A possibly qualified name with type arguments."""
        if self.java:
            while True:
                self.annotations()
                self.need_name()
                if self.t[self.p] == "<":
                    self.type_args()
                if self.t[self.p] == "." and (self.t[self.p + 1] == "i" or self.t[self.p + 1] in self.special or self.t[self.p + 1] == "@"):
                    self.p += 1
                    continue
                return
        self.take("::")
        while True:
            self.take("template")
            self.need_name()
            if self.lang == "cpp" and self.t[self.p] == "<":
                self.attempt(self.type_args)
            if self.lang == "cpp" and self.t[self.p] == "::" and (self.t[self.p + 1] in ("i", "template") or self.t[self.p + 1] in self.special):
                self.p += 1
                continue
            return

    def type(self) -> None:
        """A Java type."""
        self.annotations()
        if self.t[self.p] in JAVA_TYPES:
            self.p += 1
        else:
            self.qualified()
        self.dims()

    def dims(self) -> None:
        while self.t[self.p] == "[" and self.t[self.p + 1] == "]":
            self.p += 2

    def specifiers(self, bodies: bool = True) -> tuple[bool, bool]:
        """Declaration specifiers of C and C++: is there a type, is it one with a tag."""
        typed = tagged = words = False
        start = self.p
        while True:
            w = self.t[self.p]
            if w == "extern" and self.t[self.p + 1] == "S":
                self.p += 2
            elif w == "auto":
                self.p += 1
                words = True
                if self.lang == "cpp":
                    typed = True
            elif w in C_QUALIFIERS:
                self.p += 1
                if w == "explicit" and self.t[self.p] == "(":
                    self.parens()
            elif w in ("alignas", "_Alignas"):
                self.p += 1
                self.parens()
            elif w == "[" and self.t[self.p + 1] == "[":
                self.attributes()
            elif w in C_TYPES:
                if typed and not words:
                    raise Bad
                typed = words = True
                self.p += 1
            elif w in ("struct", "union", "class", "enum") and (w != "class" or self.lang == "cpp"):
                if typed:
                    raise Bad
                typed = tagged = True
                self.tag(w, bodies)
            elif w == "decltype" or w == "typename":
                if typed:
                    raise Bad
                typed = True
                self.p += 1
                if w == "decltype":
                    self.parens()
                else:
                    self.qualified()
            elif not typed and (self.name() or w == "::" and self.lang == "cpp"):
                typed = True
                self.qualified()
            else:
                break
        if self.p == start:
            raise Bad
        return typed, tagged

    def tag(self, w: str, bodies: bool) -> None:
        self.p += 1
        if w == "enum" and self.lang == "cpp":
            self.take("class") or self.take("struct")
        self.attributes()
        named = self.name() or self.t[self.p] == "::"
        if named:
            self.qualified()
            if self.t[self.p] == "final":
                self.p += 1
        if w == "enum":
            if self.lang == "cpp" and self.t[self.p] == ":" and bodies:
                self.p += 1
                self.specifiers(False)
            if bodies and self.t[self.p] == "{":
                self.open("other")
                while not self.take("}"):
                    self.need_name()
                    if self.take("="):
                        self.conditional()
                    if not self.take(",") and self.t[self.p] != "}":
                        raise Bad
                return
        else:
            if bodies and self.lang == "cpp" and self.t[self.p] == ":":
                self.p += 1
                while True:
                    while self.t[self.p] in ("public", "private", "protected", "virtual"):
                        self.p += 1
                    self.qualified()
                    self.take("...")
                    if not self.take(","):
                        break
                if self.t[self.p] != "{":
                    raise Bad
            if bodies and self.t[self.p] == "{":
                self.body("class", self.member)
                return
        if not named:
            raise Bad

    def attributes(self) -> None:
        while self.t[self.p] == "[" and self.t[self.p + 1] == "[":
            self.p += 2
            while not (self.t[self.p] == "]" and self.t[self.p + 1] == "]"):
                if self.p >= self.n:
                    raise Bad
                if self.t[self.p] == "(":
                    self.parens()
                else:
                    self.p += 1
            self.p += 2

    def parens(self) -> None:
        """Any balanced parenthesis."""
        self.need("(")
        depth = 1
        while depth:
            if self.p >= self.n:
                raise Bad
            w = self.t[self.p]
            depth += (w in "([{") - (w in ")]}") if len(w) == 1 else 0
            self.p += 1

    def pointers(self) -> None:
        while True:
            w = self.t[self.p]
            if w in ("*", "const", "volatile", "restrict") or self.lang == "cpp" and w in ("&", "&&"):
                self.p += 1
            elif self.lang == "cpp" and w == "i" and self.t[self.p + 1] == "::" and self.t[self.p + 2] == "*":
                self.p += 3
            else:
                return

    def type_id(self) -> None:
        """A type with an abstract declarator."""
        typed, _ = self.specifiers(False)
        if not typed:
            raise Bad
        self.declarator(True, False)

    def declarator(self, abstract: bool, named: bool = True) -> bool:
        """A declarator; True if it ends in a parameter list."""
        self.pointers()
        self.take("...")
        function = False
        if self.t[self.p] == "(" and (self.t[self.p + 1] in ("*", "&", "&&") or self.t[self.p + 1] == "i" and self.t[self.p + 2] in (")", "::", "[", "(") and not abstract):
            inner = self.p
            self.p += 1
            if not self.attempt(self.declarator, abstract, named) or not self.take(")"):
                self.p = inner
                if not abstract:
                    raise Bad
        elif named and (self.name() or self.t[self.p] in ("::", "~", "operator")):
            self.declared_name()
        elif not abstract:
            raise Bad
        while True:
            w = self.t[self.p]
            if w == "[" and self.t[self.p + 1] != "[":
                self.p += 1
                while self.t[self.p] in ("static", "const", "restrict", "volatile"):
                    self.p += 1
                if not self.take("]"):
                    self.conditional()
                    self.need("]")
            elif w == "(":
                if not self.attempt(self.parameters):
                    return function
                function = True
                self.after_parameters()
            elif w == "[":
                self.attributes()
            else:
                return function

    def after_parameters(self) -> None:
        if self.lang != "cpp":
            return
        while True:
            w = self.t[self.p]
            if w in ("const", "volatile", "override", "final", "&", "&&"):
                self.p += 1
            elif w in ("noexcept", "throw"):
                self.p += 1
                if self.t[self.p] == "(":
                    self.parens()
            elif w == "->":
                self.p += 1
                self.type_id()
            else:
                return

    def declared_name(self) -> None:
        self.take("::")
        while True:
            if self.lang == "cpp" and self.take("~"):
                self.need_name()
                return
            if self.lang == "cpp" and self.take("operator"):
                w = self.t[self.p]
                if w == "(" and self.t[self.p + 1] == ")":
                    self.p += 2
                elif w == "[" and self.t[self.p + 1] == "]":
                    self.p += 2
                elif w in ("new", "delete"):
                    self.p += 1
                    if self.t[self.p] == "[":
                        self.p += 2
                elif w in ASSIGN or w in BINARY or w in PREFIX or w in ("->", ","):
                    self.p += 1
                elif w == "S":
                    self.p += 2
                else:
                    self.specifiers(False)
                    self.pointers()
                return
            self.need_name()
            if self.lang == "cpp" and self.t[self.p] == "<":
                p = self.p
                if not self.attempt(self.type_args) or self.t[self.p] not in ("::", "("):
                    self.p = p
            if self.lang == "cpp" and self.take("::"):
                continue
            return

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.attributes()
            if self.t[self.p] == "...":
                self.p += 1
                break
            self.specifiers(False)
            self.declarator(True)
            if self.lang == "cpp" and self.take("="):
                self.initializer()
            if not self.take(","):
                break
        self.need(")")

    def initializer(self) -> None:
        if self.t[self.p] == "{":
            self.braced()
        else:
            self.assignment()

    def braced(self) -> None:
        self.open("other")
        while not self.take("}"):
            if self.java:
                self.initializer()
            else:
                while self.t[self.p] in (".", "[") and not (self.t[self.p] == "[" and self.lang == "cpp"):
                    if self.take("."):
                        self.need_name()
                    else:
                        self.p += 1
                        self.conditional()
                        if self.take("..."):
                            self.conditional()
                        self.need("]")
                self.take("=")
                self.initializer()
                self.take("...")
            if not self.take(",") and self.t[self.p] != "}":
                raise Bad

    # -- declarations of C and C++

    def c_declaration(self, ctx: str) -> None:
        """A declaration or, outside functions, a function definition."""
        self.attributes()
        if self.t[self.p] == "i" and ctx == "class" and self.t[self.p + 1] == "(" or self.t[self.p] == "~" and ctx == "class":
            typed, tagged = True, False  # constructor, destructor
        elif ctx != "func" and self.attempt(self.unspecified):
            typed, tagged = True, False
        else:
            typed, tagged = self.specifiers()
        if self.take(";"):
            if not tagged:
                raise Bad
            return
        if not typed and not (self.lang == "cpp" and self.t[self.p] in ("i", "~", "operator", "[")):
            raise Bad
        first = True
        while True:
            if self.lang == "cpp" and self.t[self.p] == "[" and first:  # structured binding
                self.p += 1
                while True:
                    self.need_name()
                    if not self.take(","):
                        break
                self.need("]")
                function = False
            elif ctx == "class" and self.t[self.p] == ":":
                function = False
            else:
                if self.lang == "cpp" and self.t[self.p] in ("&", "&&") and self.t[self.p + 1] == "[":
                    self.p += 1
                    continue
                function = self.declarator(False)
            if function and first and ctx != "func":
                if self.lang == "cpp" and self.t[self.p] == ":":
                    self.p += 1
                    while True:
                        self.qualified()
                        if self.t[self.p] == "{":
                            self.braced()
                        else:
                            self.arguments()
                        self.take("...")
                        if not self.take(","):
                            break
                    self.block()
                    return
                if self.t[self.p] == "{":
                    self.block()
                    return
                if self.t[self.p] == "try" and self.lang == "cpp":
                    self.statement()
                    return
            if ctx == "class" and self.take(":"):
                self.conditional()
            if self.take("="):
                if self.lang == "cpp" and self.t[self.p] in ("default", "delete"):
                    self.p += 1
                else:
                    self.initializer()
            elif self.lang == "cpp" and self.t[self.p] == "{":
                self.braced()
            elif self.lang == "cpp" and self.t[self.p] == "(" and not function:
                self.arguments()
            first = False
            if self.take(";"):
                return
            self.need(",")

    def unspecified(self) -> None:
        """A member function named from outside its class that has no type: look ahead only."""
        if self.lang != "cpp":
            raise Bad
        p = self.p
        while self.t[self.p] in C_QUALIFIERS:
            self.p += 1
        after = self.p
        if self.t[self.p] == "operator" or self.t[self.p] == "i" and self.t[self.p + 1] == "(" and after > p:
            return
        if self.t[self.p] != "i":
            raise Bad
        self.p += 1
        if self.t[self.p] == "<":
            self.type_args()
        if self.t[self.p] != "::" or not (self.t[self.p + 1] == "i" and self.t[self.p + 2] == "(" or self.t[self.p + 1] in ("~", "operator")):
            raise Bad
        self.p = after

    def template(self) -> None:
        self.need("template")
        if self.t[self.p] == "<":
            self.template_parameters()

    def template_parameters(self) -> None:
        if self.take("<"):
            if self.t[self.p] != ">":
                while True:
                    if self.t[self.p] in ("typename", "class") and (self.t[self.p + 1] in ("i", ",", ">", "=", "...")):
                        self.p += 1
                        self.take("...")
                        if self.name():
                            self.p += 1
                        if self.take("="):
                            self.type_id()
                    elif self.t[self.p] == "template":
                        self.template()
                        self.p += 1
                        self.take("...")
                        if self.name():
                            self.p += 1
                    else:
                        self.specifiers(False)
                        self.declarator(True)
                        if self.take("="):
                            self.conditional(True)
                    if not self.take(","):
                        break
            self.close_angle()
            if self.take("requires"):
                self.conditional()

    def file_item(self) -> None:
        if self.java:
            self.java_file_item()
        else:
            self.c_item("file")

    def c_item(self, ctx: str) -> None:
        w = self.t[self.p]
        if w == ";":
            self.p += 1
        elif w in ("_Static_assert", "static_assert", "asm"):
            self.p += 1
            self.parens()
            self.need(";")
        elif w == "extern" and self.t[self.p + 1] == "S" and self.t[self.p + 2] == "{" and self.lang == "cpp":
            self.p += 2
            self.body("file", self.file_item)
        elif self.lang == "cpp" and (w == "namespace" or w == "inline" and self.t[self.p + 1] == "namespace"):
            self.p += 1 + (w == "inline")
            self.attributes()
            if self.name():
                self.qualified()
                if self.take("="):
                    self.qualified()
                    self.need(";")
                    return
            self.body("file", self.file_item)
        elif self.lang == "cpp" and w == "using":
            self.p += 1
            if self.take("namespace"):
                self.qualified()
            elif self.name() and self.t[self.p + 1] == "=":
                self.p += 2
                self.type_id()
            else:
                self.take("typename")
                self.declared_name()
                while self.take(","):
                    self.declared_name()
            self.need(";")
        elif self.lang == "cpp" and w == "template":
            self.template()
            if self.take("concept"):
                self.need_name()
                self.need("=")
                self.conditional()
                self.need(";")
            else:
                self.c_item(ctx)
        elif ctx == "class" and w in ("public", "private", "protected") and self.lang == "cpp":
            self.p += 1
            self.need(":")
        else:
            self.c_declaration(ctx)

    def member(self) -> None:
        if self.java:
            self.java_member("class")
        else:
            self.c_item("class")

    # -- declarations of Java

    def annotations(self) -> None:
        while self.t[self.p] == "@" and self.t[self.p + 1] != "interface":
            self.p += 1
            while True:
                self.need_name()
                if self.t[self.p] == "." and self.t[self.p + 1] == "i":
                    self.p += 1
                    continue
                break
            if self.take("("):
                if not self.take(")"):
                    while True:
                        if self.name() and self.t[self.p + 1] == "=":
                            self.p += 2
                        self.annotation_value()
                        if not self.take(","):
                            break
                    self.need(")")

    def annotation_value(self) -> None:
        if self.t[self.p] == "@":
            self.annotations()
        elif self.t[self.p] == "{":
            self.open("other")
            while not self.take("}"):
                self.annotation_value()
                if not self.take(",") and self.t[self.p] != "}":
                    raise Bad
        else:
            self.conditional()

    def modifiers(self) -> None:
        while True:
            self.annotations()
            w = self.t[self.p]
            if w == "sealed" and self.t[self.p + 1] not in ("class", "interface", "abstract", "public", "static", "private", "protected", "strictfp"):
                return
            if w == "default" and self.t[self.p + 1] in (":", "->"):
                return
            if w in JAVA_MODIFIERS:
                self.p += 1
            elif w == "non" and self.t[self.p + 1] == "-" and self.t[self.p + 2] == "sealed":
                self.p += 3
            else:
                return

    def java_file_item(self) -> None:
        if self.take(";"):
            return
        p = self.p
        self.annotations()
        if self.take("package"):
            if p or self.p - 1 != p:
                if any(w in ("import", "class", "interface", "enum") for w in self.t[:p]) or p and self.t[0] == "package":
                    raise Bad
            self.dotted()
            self.need(";")
            return
        self.p = p
        if self.take("import"):
            if any(w == "{" for w in self.t[:p]):
                raise Bad
            self.take("static")
            self.dotted(True)
            self.need(";")
            return
        self.modifiers()
        if not self.java_type_decl():
            raise Bad

    def dotted(self, star: bool = False) -> None:
        self.need_name()
        while self.take("."):
            if star and self.take("*"):
                return
            self.need_name()

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.need_name()
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.close_angle()

    def types(self) -> None:
        while True:
            self.type()
            if not self.take(","):
                return

    def java_type_decl(self) -> bool:
        w = self.t[self.p]
        if w in ("class", "interface") or w == "@" and self.t[self.p + 1] == "interface":
            self.p += 1 + (w == "@")
            self.need_name()
            if self.t[self.p] == "<":
                self.type_parameters()
            if self.take("extends"):
                self.types()
            if self.take("implements"):
                self.types()
            if self.take("permits"):
                self.types()
            self.body("class", lambda: self.java_member("class"))
            return True
        if w == "record" and (self.t[self.p + 1] == "i") and self.t[self.p + 2] in ("(", "<"):
            self.p += 2
            if self.t[self.p] == "<":
                self.type_parameters()
            self.java_parameters()
            if self.take("implements"):
                self.types()
            self.body("class", lambda: self.java_member("class"))
            return True
        if w == "enum":
            self.p += 1
            self.need_name()
            if self.take("implements"):
                self.types()
            self.open("other")
            while True:
                self.annotations()
                if self.name():
                    self.p += 1
                    if self.t[self.p] == "(":
                        self.arguments()
                    if self.t[self.p] == "{":
                        self.body("class", lambda: self.java_member("class"))
                    if self.take(","):
                        continue
                break
            if self.take(";"):
                while self.t[self.p] != "}":
                    if self.p >= self.n:
                        raise Bad
                    self.java_member("class")
            self.need("}")
            return True
        return False

    def java_parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.take("...")
            if self.take("this"):
                pass
            else:
                self.need_name()
            self.dims()
            if not self.take(","):
                break
        self.need(")")

    def java_member(self, ctx: str) -> None:
        if self.take(";"):
            return
        if self.t[self.p] == "{":
            self.block()
            return
        if self.t[self.p] == "static" and self.t[self.p + 1] == "{":
            self.p += 1
            self.block()
            return
        self.modifiers()
        if self.java_type_decl():
            return
        if self.t[self.p] == "<":
            self.type_parameters()
        if self.name() and self.t[self.p + 1] == "(":  # constructor
            self.p += 1
            self.java_parameters()
            if self.take("throws"):
                self.types()
            self.block()
            return
        if self.name() and self.t[self.p + 1] == "{":  # compact constructor
            self.p += 1
            self.block()
            return
        if not self.take("void"):
            self.type()
        self.need_name()
        if self.t[self.p] == "(":
            self.java_parameters()
            self.dims()
            if self.take("throws"):
                self.types()
            if self.take("default"):
                self.annotation_value()
            if not self.take(";"):
                self.block()
            return
        self.java_declarators()
        self.need(";")

    def java_declarators(self) -> None:
        """What follows the first variable's name."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.need_name()

    def java_local(self) -> None:
        self.modifiers()
        self.type()
        self.need_name()
        if self.t[self.p] not in ("=", ";", ",", "[", ":", ")"):
            raise Bad
        self.java_declarators()

    # -- statements

    def condition(self, init: bool = False) -> None:
        self.need("(")
        if self.lang == "cpp":
            if self.attempt(self.cpp_condition, init):
                return
        self.expression()
        self.need(")")

    def cpp_condition(self, init: bool) -> None:
        """A declaration as a condition, or (in if and switch) an init statement before it."""
        if init and self.attempt(self.simple):
            if self.attempt(self.cpp_condition, False):
                return
            self.expression()
            self.need(")")
            return
        self.specifiers(False)
        self.declarator(False)
        if self.take("="):
            self.initializer()
        else:
            self.braced()
        self.need(")")

    def simple(self) -> None:
        """A simple statement with its semicolon: a declaration or an expression."""
        if self.take(";"):
            return
        if self.java:
            if self.attempt(self.local_ended):
                return
        elif self.attempt(self.c_declaration, "func"):
            return
        kind = self.expression()
        if self.java and kind not in ("assign", "step", "call", "new"):
            raise Bad
        self.need(";")

    def local_ended(self) -> None:
        self.java_local()
        self.need(";")

    def for_head(self) -> None:
        self.need("(")
        if self.attempt(self.for_each):
            return
        if self.java and not self.attempt(self.local_ended):
            if not self.take(";"):
                self.expressions()
                self.need(";")
        elif not self.java:
            self.simple()
        if not self.take(";"):
            self.expression()
            self.need(";")
        if self.t[self.p] != ")":
            self.expressions() if self.java else self.expression()
        self.need(")")

    def for_each(self) -> None:
        if self.java:
            self.modifiers()
            self.type()
            self.need_name()
        elif self.lang == "cpp":
            self.specifiers(False)
            self.pointers()
            if self.take("["):
                while True:
                    self.need_name()
                    if not self.take(","):
                        break
                self.need("]")
            else:
                self.need_name()
        else:
            raise Bad
        self.need(":")
        self.initializer()
        self.need(")")

    def expressions(self) -> None:
        while True:
            kind = self.assignment()
            if self.java and kind not in ("assign", "step", "call", "new"):
                raise Bad
            if not self.take(","):
                return

    def statement(self) -> None:
        w = self.t[self.p]
        if w == "{":
            self.block()
        elif w == "if":
            self.p += 1
            if self.lang == "cpp":
                self.take("constexpr")
            self.condition(True)
            self.sub()
            if self.take("else"):
                self.sub()
        elif w == "while":
            self.p += 1
            self.condition()
            self.sub()
        elif w == "do":
            self.p += 1
            self.sub()
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.need(";")
        elif w == "for":
            self.p += 1
            self.for_head()
            self.sub()
        elif w == "switch":
            self.p += 1
            self.condition(True)
            if self.java:
                self.switch_body()
            else:
                self.sub()
        elif w in ("case", "default") and not (self.java and w == "default" and self.t[self.p + 1] != ":"):
            self.p += 1
            if w == "case":
                self.conditional()
                if self.take("..."):
                    self.conditional()
                while self.java and self.take(","):
                    self.conditional()
            self.need(":")
        elif w == "return":
            self.p += 1
            if self.t[self.p] != ";":
                if self.t[self.p] == "{" and self.lang == "cpp":
                    self.braced()
                else:
                    self.expression()
            self.need(";")
        elif w in ("break", "continue"):
            self.p += 1
            if self.java and self.name():
                self.p += 1
            self.need(";")
        elif w == "goto" and not self.java:
            self.p += 1
            self.need_name()
            self.need(";")
        elif w == "throw" and self.lang != "c":
            self.p += 1
            if self.t[self.p] != ";" or self.java:
                self.expression()
            self.need(";")
        elif w == "try" and self.lang != "c":
            self.try_statement()
        elif w == "synchronized" and self.java and self.t[self.p + 1] == "(":
            self.p += 1
            self.condition()
            self.block()
        elif w == "assert" and self.java:
            self.p += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif w == "yield" and self.java and self.t[self.p + 1] not in ("=", ".", "(", "[", "++", "--", "+=", "-="):
            self.p += 1
            self.expression()
            self.need(";")
        elif self.name() and self.t[self.p + 1] == ":" and self.t[self.p + 2] != ":":
            self.p += 2
            if self.t[self.p] != "}":
                self.statement()
        elif self.java:
            p = self.p
            self.modifiers()
            if self.t[self.p] in ("class", "interface", "enum") or self.t[self.p] == "record" and self.t[self.p + 1] == "i":
                if self.java_type_decl():
                    return
            self.p = p
            self.simple()
        elif w in ("using", "namespace", "static_assert", "_Static_assert", "asm", "template") and (w == "_Static_assert" or self.lang == "cpp"):
            self.c_item("func")
        else:
            self.simple()

    def sub(self) -> None:
        """A statement that is part of another: no declaration."""
        if self.t[self.p] in ("{", ";", "if", "while", "do", "for", "switch", "return", "break", "continue", "goto", "throw", "try", "synchronized", "assert", "case", "default"):
            self.statement()
        elif self.java:
            if self.name() and self.t[self.p + 1] == ":" or self.t[self.p] == "yield":
                self.statement()
                return
            if self.expression() not in ("assign", "step", "call", "new"):
                raise Bad
            self.need(";")
        elif self.lang == "c" and not (self.name() and self.t[self.p + 1] == ":"):
            self.expression()
            self.need(";")
        else:
            self.statement()

    def try_statement(self) -> None:
        self.p += 1
        resources = False
        if self.java and self.take("("):
            resources = True
            while True:
                if not self.attempt(self.java_local):
                    self.expression()
                if not self.take(";") or self.t[self.p] == ")":
                    break
            self.need(")")
        self.block()
        handlers = 0
        while self.take("catch"):
            handlers += 1
            self.need("(")
            if self.java:
                self.modifiers()
                self.type()
                while self.take("|"):
                    self.type()
                self.need_name()
            elif not self.take("..."):
                self.specifiers(False)
                self.declarator(True)
            self.need(")")
            self.block()
        if self.java and self.take("finally"):
            handlers += 1
            self.block()
        if not handlers and not resources:
            raise Bad

    def switch_body(self) -> None:
        """A Java switch, old or with arrows."""
        self.open("other")
        while not self.take("}"):
            if self.t[self.p] in ("case", "default"):
                case = self.t[self.p] == "case"
                self.p += 1
                if case:
                    while True:
                        if not self.take("default") and not self.attempt(self.pattern):
                            self.conditional()
                        if not self.take(","):
                            break
                    if self.take("when"):
                        self.conditional()
                if self.take("->"):
                    if self.t[self.p] == "{":
                        self.block()
                    elif self.t[self.p] == "throw":
                        self.statement()
                    else:
                        self.expression()
                        self.need(";")
                else:
                    self.need(":")
            elif self.p >= self.n:
                raise Bad
            else:
                self.statement()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            if not self.take(")"):
                while True:
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")
            if self.name() and self.t[self.p] != "when":
                self.p += 1
        else:
            self.need_name()
        if self.t[self.p] not in (":", "->", ",", ")", "when"):
            raise Bad

    # -- expressions; each rule returns what its outermost operation is

    def expression(self) -> str:
        kind = self.assignment()
        while not self.java and self.take(","):
            self.assignment()
            kind = "other"
        return kind

    def assignment(self) -> str:
        if self.lang == "cpp" and self.t[self.p] in ("throw", "co_yield"):
            self.p += 1
            if self.t[self.p] not in (")", ";", ",", ":"):
                self.assignment()
            return "other"
        if self.java and (self.name() and self.t[self.p + 1] == "->" or self.t[self.p] == "(" and self.lambda_ahead()):
            return self.java_lambda()
        kind = self.conditional()
        if self.t[self.p] in ASSIGN:
            if self.java and kind in ("other", "call", "step", "new", "literal"):
                raise Bad
            self.p += 1
            if self.t[self.p] == "{" and self.lang == "cpp":
                self.braced()
            else:
                self.assignment()
            return "assign"
        return kind

    def lambda_ahead(self) -> bool:
        if self.arrows is None:  # of each parenthesis whether an arrow follows its closer, with no statement in between
            self.arrows, open_ = {}, []
            for p in range(self.n):
                w = self.t[p]
                if w == "(":
                    open_.append(p)
                elif w == ")":
                    if open_:
                        self.arrows[open_.pop()] = self.t[p + 1] == "->"
                elif w in (";", "{", "}"):
                    open_.clear()
        return self.arrows.get(self.p, False)

    def java_lambda(self) -> str:
        if self.take("("):
            if not self.take(")"):
                while True:
                    if not (self.name() and self.t[self.p + 1] in (",", ")")):
                        self.modifiers()
                        self.type()
                        self.take("...")
                    self.need_name()
                    self.dims()
                    if not self.take(","):
                        break
                self.need(")")
        else:
            self.need_name()
        self.need("->")
        if self.t[self.p] == "{":
            self.block()
        else:
            self.assignment()
        return "other"

    def conditional(self, angled: bool = False) -> str:
        kind = self.binary(angled)
        if self.take("?"):
            if not self.java and self.t[self.p] == ":":
                pass
            elif self.java:
                self.assignment()
            else:
                self.expression()
            self.need(":")
            if self.java and (self.name() and self.t[self.p + 1] == "->" or self.t[self.p] == "(" and self.lambda_ahead()):
                self.java_lambda()
            elif self.java:
                self.conditional()
            else:
                self.assignment()
            return "other"
        return kind

    def binary(self, angled: bool = False) -> str:
        kind = self.unary()
        while True:
            w = self.t[self.p]
            if w in BINARY and not (angled and w[:1] == ">"):
                if self.java and w in ("<=>", ".*", "->*") or self.lang == "c" and w in ("<=>", ".*", "->*", ">>>") or self.lang == "cpp" and w == ">>>":
                    raise Bad
                self.p += 1
                self.unary()
                kind = "other"
            elif self.java and w == "instanceof":
                self.p += 1
                self.take("final")
                if not self.attempt(self.instance_pattern):
                    self.type()
                kind = "other"
            else:
                return kind

    def instance_pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            if not self.take(")"):
                while True:
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")
        else:
            self.need_name()

    def unary(self) -> str:
        w = self.t[self.p]
        if w in PREFIX or not self.java and w in ("*", "&") or w == "&&" and self.lang == "c":
            self.p += 1
            self.unary()
            return "step" if w in ("++", "--") else "deref" if w == "*" else "other"
        if not self.java:
            if w in ("sizeof", "alignof", "_Alignof"):
                self.p += 1
                if self.take("..."):
                    self.parens()
                elif not (self.t[self.p] == "(" and self.attempt(self.type_in_parens)):
                    self.unary()
                return "other"
            if self.lang == "cpp":
                if w == "delete":
                    self.p += 1
                    if self.take("["):
                        self.need("]")
                    self.unary()
                    return "call"
                if w in ("noexcept", "typeid"):
                    self.p += 1
                    self.parens()
                    return self.postfix("other")
                if w == "co_await":
                    self.p += 1
                    return self.unary()
        if w == "(" and self.attempt(self.cast):
            return "other"
        return self.postfix(self.primary())

    def type_in_parens(self) -> None:
        self.need("(")
        self.type_id()
        self.need(")")

    def cast(self) -> None:
        self.need("(")
        if self.java:
            primitive = self.t[self.p] in JAVA_TYPES
            self.type()
            while self.take("&"):
                self.type()
            self.need(")")
            if primitive and self.t[self.p - 2] != "]":
                self.unary()
                return
            w = self.t[self.p]
            if not (self.name() or w in ("n", "S", "C", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or w in JAVA_TYPES):
                raise Bad
            if self.name() and self.t[self.p + 1] == "->" or w == "(" and self.lambda_ahead():
                self.java_lambda()
            else:
                self.unary()
            return
        self.type_id()
        self.need(")")
        if self.t[self.p] == "{" and self.lang == "c":
            self.braced()
            self.postfix("other")
            return
        self.unary()

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.initializer() if self.lang == "cpp" else self.assignment()
            self.take("...") if self.lang == "cpp" else None
            if not self.take(","):
                break
        self.need(")")

    def primary(self) -> str:
        w = self.t[self.p]
        if w in ("n", "C"):
            self.p += 1
            return "literal"
        if w == "S":
            self.p += 1
            while not self.java and self.t[self.p] in ("S",):
                self.p += 1
            return "literal"
        if w == "(":
            self.p += 1
            if self.lang != "java" and self.t[self.p] == "{":  # statement expression
                self.block()
                self.need(")")
                return "other"
            kind = self.expression()
            self.need(")")
            return "other" if self.java and kind != "name" else "paren"
        if w in ("true", "false", "null", "nullptr") and w in KEYWORDS[self.lang]:
            self.p += 1
            return "literal"
        if w == "this" and self.lang != "c":
            self.p += 1
            if self.java and self.t[self.p] == "(":
                self.arguments()
                return "call"
            return "value"
        if self.java:
            return self.java_primary(w)
        if self.lang == "cpp":
            if w == "new" or w == "::" and self.t[self.p + 1] == "new":
                self.p += 1 + (w == "::")
                if self.t[self.p] == "(" and not self.attempt(self.type_in_parens):
                    self.arguments()
                if self.t[self.p - 1] != ")" or self.name() or self.t[self.p] in C_TYPES:
                    self.specifiers(False)
                    self.pointers()
                while self.take("["):
                    if not self.take("]"):
                        self.expression()
                        self.need("]")
                if self.t[self.p] == "(":
                    self.arguments()
                elif self.t[self.p] == "{":
                    self.braced()
                return "new"
            if w in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"):
                self.p += 1
                self.need("<")
                self.type_id()
                self.close_angle()
                self.need("(")
                self.expression()
                self.need(")")
                return "call"
            if w == "[":
                return self.cpp_lambda()
            if w in C_TYPES or w in ("typename", "decltype", "auto"):
                self.specifiers(False)
                if self.t[self.p] == "{":
                    self.braced()
                elif self.t[self.p] == "::":
                    self.p += 1
                    self.declared_name()
                else:
                    self.arguments()
                return "call"
            if w in ("operator", "~", "::") or self.name():
                self.take("::")
                while True:
                    self.take("template")
                    if self.t[self.p] in ("operator", "~"):
                        self.declared_name()
                        break
                    self.need_name()
                    if self.t[self.p] == "<":
                        p = self.p
                        if not (self.attempt(self.type_args) and self.t[self.p] in ("(", "::", "{", ")", ",", ";")):
                            self.p = p
                    if self.take("::"):
                        continue
                    break
                if self.t[self.p] == "{" and self.attempt(self.braced):
                    return "call"
                return "name"
        if w == "_Generic":
            self.p += 1
            self.parens()
            return "other"
        self.need_name()
        return "name"

    def cpp_lambda(self) -> str:
        self.need("[")
        while not self.take("]"):
            if self.take("=") or self.take("&") and not self.name() and self.t[self.p] != "...":
                pass
            elif self.take("*"):
                self.need("this")
            elif self.take("this"):
                pass
            else:
                self.take("...")
                self.need_name()
                self.take("...")
                if self.take("="):
                    self.initializer()
                elif self.t[self.p] in ("{", "("):
                    self.initializer()
            if not self.take(",") and self.t[self.p] != "]":
                raise Bad
        if self.t[self.p] == "<":
            self.template_parameters()
        if self.t[self.p] == "(":
            self.parameters()
        while self.t[self.p] in ("mutable", "constexpr", "static"):
            self.p += 1
        self.after_parameters()
        self.block()
        return "other"

    def java_primary(self, w: str) -> str:
        if w == "super":
            self.p += 1
            if self.t[self.p] == "(":
                self.arguments()
                return "call"
            if self.t[self.p] not in (".", "::"):
                raise Bad
            return "value"
        if w == "new":
            self.p += 1
            self.annotations()
            if self.t[self.p] == "<":
                self.type_args()
            primitive = self.t[self.p] in JAVA_TYPES
            if primitive:
                self.p += 1
            else:
                self.diamond()
            if self.t[self.p] == "[":
                sized = False
                while self.t[self.p] == "[":
                    self.p += 1
                    if not self.take("]"):
                        self.expression()
                        self.need("]")
                        sized = True
                if self.t[self.p] == "{":
                    if sized:
                        raise Bad
                    self.braced()
                elif not sized:
                    raise Bad
                return "array"
            if primitive:
                raise Bad
            self.arguments()
            if self.t[self.p] == "{":
                self.body("class", lambda: self.java_member("class"))
            return "new"
        if w == "switch":
            self.p += 1
            self.condition()
            self.switch_body()
            return "other"
        if w in JAVA_TYPES or w == "void":
            self.p += 1
            self.dims()
            if self.take("."):
                self.need("class")
            else:
                self.need("::")
                self.need("new")
            return "other"
        if self.name() and self.t[self.p + 1] in ("<", "[", ".") and self.attempt(self.typed_reference):
            return "other"
        self.need_name()
        if self.t[self.p] == "(":
            self.arguments()
            return "call"
        return "name"

    def diamond(self) -> None:
        while True:
            self.annotations()
            self.need_name()
            if self.t[self.p] == "<":
                self.type_args()
            if not self.take("."):
                return

    def typed_reference(self) -> None:
        """A generic or array type before :: or .class."""
        self.type()
        if self.take("::"):
            if not self.take("new"):
                self.need_name()
        else:
            self.need(".")
            self.need("class")

    def postfix(self, kind: str) -> str:
        while True:
            w = self.t[self.p]
            if w == "[" and not (self.lang == "cpp" and self.t[self.p + 1] == "["):
                if self.java and kind in ("literal", "new") or kind == "literal" and self.t[self.p - 1] == "C":
                    raise Bad
                self.p += 1
                if self.java and self.t[self.p] == "]":
                    raise Bad
                self.expression()
                self.need("]")
                kind = "element"
            elif w == "(":
                if self.java or kind == "literal":
                    raise Bad
                self.arguments()
                kind = "call"
            elif w == ".":
                self.p += 1
                if self.java:
                    if self.t[self.p] == "<":
                        self.type_args()
                    if self.take("new"):
                        self.diamond()
                        self.arguments()
                        if self.t[self.p] == "{":
                            self.body("class", lambda: self.java_member("class"))
                        kind = "new"
                        continue
                    if self.t[self.p] in ("this", "class"):
                        self.p += 1
                        kind = "value"
                        continue
                    if self.take("super"):
                        kind = "value"
                        if self.t[self.p] == "(":
                            self.arguments()
                            kind = "call"
                        continue
                    self.need_name()
                    kind = "field"
                    if self.t[self.p] == "(":
                        self.arguments()
                        kind = "call"
                else:
                    self.take("template")
                    self.member_name()
                    kind = "field"
            elif w == "->" and not self.java:
                self.p += 1
                self.take("template")
                self.member_name()
                kind = "field"
            elif w == "::" and self.java:
                self.p += 1
                if self.t[self.p] == "<":
                    self.type_args()
                if not self.take("new"):
                    self.need_name()
                kind = "other"
            elif w in ("++", "--"):
                if self.java and kind not in ("name", "field", "element", "paren"):
                    raise Bad
                self.p += 1
                kind = "step"
            else:
                return kind

    def member_name(self) -> None:
        if self.lang == "cpp":
            self.declared_name()
        else:
            self.need_name()


def flattened(words: list[str]) -> list[str]:
    """Words in which repetition that changes no verdict is cut: of brackets that enclose each other directly two stay, of equal prefix operators in a row as well."""
    close: dict[int, int] = {}
    open_: list[int] = []
    for p, w in enumerate(words):
        if w in ("(", "{"):
            open_.append(p)
        elif w in (")", "}") and open_:
            close[open_.pop()] = p
    gone = set()
    for p in close:
        if p + 2 in close and p + 1 in close and words[p] == words[p + 1] == words[p + 2] and close[p] == close[p + 1] + 1 == close[p + 2] + 2:
            gone.update((p, close[p]))
    out: list[str] = []
    for p, w in enumerate(words):
        if p in gone or w in ("-", "+", "!", "~") and len(out) > 2 and out[-1] == out[-2] == out[-3] == w:
            continue
        out.append(w)
    return out


def derives(shape: str, lang: str, ctx: str = "file") -> bool | None:
    """Is the shape a sequence of items of the context? None where it nests too deep to tell (DEEPEST calls)."""
    parser = Parser(shape, lang)
    if len(parser.t) > 2_000:
        parser.t = [*flattened(parser.t[:-4]), "", "", "", ""]
        parser.n = len(parser.t) - 4
    if sys.getrecursionlimit() < DEEPEST:
        sys.setrecursionlimit(DEEPEST)
    try:
        parser.items(ctx)
    except Bad:
        return False
    except RecursionError:
        return None
    return True
