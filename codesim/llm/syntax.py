"""Source files that do not parse in their language.

A text is cut into chunks at line ends. A chunk is summarised for every state the lexer may be
in where it begins (code, or inside a comment, text block or raw string): the state in
which it ends, and the shape of its code, from which its bracket summary follows (closers that
find no opener, openers left open). Summaries of neighbours compose, so those of a
file's chunks, made in any partition, reduce associatively; a file of one chunk needs no
exchange at all. A composed shape whose brackets balance is split into its statements
and the heads of its blocks, and each is parsed by the local grammar of the
context it stands in (``grammar``); as shapes recur, a worker parses each of them once.
Texts that the statement pass does not settle are parsed as a whole.

Python has lexer states and brackets of its own; its local grammar is the interpreter's,
applied to one logical line at a time, with a stack of indents for the blocks.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesim.llm.grammar import KEYWORDS, Bad, Parser, derives
from codesim.session import spread

CHUNK = 1 << 18  # characters
SHAPES_KEPT = 200_000
UNTOLD = "\x02"  # stands for what the statement pass leaves to the whole grammar
WRONG = "\x00"  # stands in a shape for what the lexer cannot read

#: Suffixes and the languages they stand for.
SUFFIXES = {"java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "py": "python"}
#: How assignments spell languages.
SPELLINGS = {"java": "java", "c": "c", "c++": "cpp", "cpp": "cpp", "python": "python", "python3": "python", "python 3": "python", "py": "python"}

# -- lexing

_C_TOKEN = r'''//(?:[^\n\\]|\\(?:\r?\n|.)?)*|/\*.*?(?:\*/|\Z)|\b\d[\w.]*(?:'[\w.]+)+|(?:\b(?:u8|[uUL]))?"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*(?:"|(?=\n)|\Z)|(?:\b(?:u8|[uUL]))?'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*(?:'|(?=\n)|\Z)'''
_RAW = r'''\b(?:u8|[uUL])?R"(?P<d>[^()\\\s"]{0,16})\((?:.*?)(?:\)(?P=d)"|\Z)|'''
_JAVA_TOKEN = r'''//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:[^\\]|\\[\s\S])*?(?:"""|\Z)|"(?:[^"\\\n]|\\[^\n])*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[^\n])*(?:'|(?=\n)|\Z)'''
_PY_TOKEN = r'''#[^\n]*|(?:\b[rbuftRBUFT]{1,2})?(?:"""(?:[^\\]|\\[\s\S])*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\[\s\S])*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)|\'(?:[^\'\\\n]|\\[\s\S])*(?:\'|(?=\n)|\Z))'''
TOKENS = {"python": re.compile(_PY_TOKEN), "c": re.compile(_C_TOKEN, re.S), "cpp": re.compile(_RAW + _C_TOKEN, re.S), "java": re.compile(_JAVA_TOKEN, re.S)}
_JAVA_CHAR = re.compile(r"""'(?:[^'\\\n]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'\Z""")
_JAVA_ESCAPES = re.compile(r"""\\(?![btnfrs"'\\0-7\n]|u+[0-9a-fA-F]{4})""")
_NAMES = re.compile(r"(?<![\w.])(?:\.?\d(?:[eEpP][-+]|[\w.])*)|[^\W\d]\w*|\$[\w$]*")
_NUMBER = {
    "c": re.compile(r"(?:0[xX](?:[\da-fA-F]+\.?[\da-fA-F]*|\.[\da-fA-F]+)(?:[pP][-+]?\d+)?|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?:[uUlLfFzZ]{0,3}|[ij])\Z"),
    "java": re.compile(r"(?:0[xX](?:[\da-fA-F_]+\.?[\da-fA-F_]*|\.[\da-fA-F_]+)(?:[pP][-+]?[\d_]+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?[\d_]+)?)[lLfFdD]?\Z"),
}
_NUMBER["cpp"] = re.compile(_NUMBER["c"].pattern.replace(r"\Z", r"(?:_\w+|s|ms|us|ns|min|h)?\Z"))
_DIRECTIVE = re.compile(r"^[ \t]*#((?:[^\n\\]|\\(?:\r?\n|.)?)*)$", re.M)
#: Preprocessing directives.
DIRECTIVES = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif pragma error warning line embed ident".split())
_SPACE = re.compile(r"\s+")


def _python_literal(m: re.Match) -> str:
    """The same for Python. Strings with a prefix or with escapes that may be malformed are parsed by themselves."""
    s = m.group()
    if s[0] == "#":
        return "" if "\0" not in s else WRONG
    body = s.lstrip("rbuftRBUFT")
    mark = body[:3] if body[:3] in ('"""', "\'\'\'") else body[0]
    if len(body) < 2 * len(mark) or not body.endswith(mark):
        return WRONG
    if (s[0] != body[0] or _PYTHON_DOUBT.search(s)) and not _python_line(s):
        return WRONG
    return "b\'\'" if "b" in s[: len(s) - len(body)].lower() else "\'\'"


#: Escapes that may be malformed, and NUL.
_PYTHON_DOUBT = re.compile(r"\\[xuUN]|\0")
_py_kept: dict[str, bool | None] = {}


def _python_line(line: str) -> bool | None:
    """Does the interpreter's grammar take one logical line (of shapes, heads with a body put in) or literal? None where it is too deep for it."""
    ok = _py_kept.get(line, UNTOLD)
    if ok == UNTOLD:
        if len(line) > 2_000 and line[0] not in _QUOTING:
            line = _flattened(line)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(line)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        except (RecursionError, MemoryError):
            ok = None
        if len(_py_kept) >= SHAPES_KEPT:
            _py_kept.clear()
        _py_kept[line] = ok
    return ok


_QUOTING = frozenset("\"'rbuftRBUFT")  # a literal by itself is no line of shapes
_ATOM = r"(?:i|1|'')"
#: Repetition that changes no verdict but nests the tree: of its parts two stay.
_REPEATED = [re.compile(rf"({p}){{3,}}") for p in (r"\. i ", r"[-+~] ", r"not ", rf"{_ATOM} if {_ATOM} else ", r"lambda : ", rf"{_ATOM}(?: \. i)* (?:[-+*/%&|^@]|//|<<|>>|\*\*|and|or) ")]


def _flattened(line: str) -> str:
    """A line of shapes with long repetitions cut."""
    for p in _REPEATED:
        line = p.sub(r"\1\1", line)
    return line


def _literal(lang: str):
    """Replaces comments and literals by their class."""
    if lang == "python":
        return _python_literal

    def replace(m: re.Match) -> str:
        s = m.group()
        head = s[0]
        if head == "/":
            if s[1] == "/":
                return " "
            return " " if len(s) >= 4 and s.endswith("*/") else WRONG
        if head.isdigit():
            return " 1 "
        if lang == "java" and s.startswith('"""'):
            return ' ""' if len(s) >= 6 and s.endswith('"""') else WRONG
        if head == "R" or s[:3].find('R"') >= 0 and lang == "cpp" and m.lastgroup == "d":
            return ' ""' if s.endswith(f'){m.group("d")}"') else WRONG
        if head not in "\"'":
            s = s[s.index('"') :] if '"' in s[:3] else s[s.index("'") :]
            head = s[0]
        if len(s) < 2 or s[-1] != head or head == "'" and len(s) < 3:
            return WRONG
        if lang == "java":
            if head == "'":
                return " ''" if _JAVA_CHAR.match(s) else WRONG
            if "\\" in s and _JAVA_ESCAPES.search(s.replace("\\\\", "")):
                return WRONG
        return ' ""' if head == '"' else " ''"

    return replace


_LITERALS = {lang: _literal(lang) for lang in TOKENS}
_WORDS: dict[str, dict[str, str]] = {lang: {k: k for k in words} for lang, words in KEYWORDS.items()}


def _word(lang: str):
    """Replaces names and numbers by their class."""
    words, number = _WORDS[lang].get, _NUMBER[lang].match

    def replace(m: re.Match) -> str:
        s = m.group()
        if s[0].isdigit() or s[0] == ".":
            return " n " if number(s) else WRONG
        return words(s) or "i"

    return replace


_WORD_CLASSES = {lang: _word(lang) for lang in TOKENS if lang in KEYWORDS}


def _preprocessed(text: str) -> str:
    """Directives taken out, of alternatives the first kept, but not that of ``#if 0``."""
    if "#" not in text:
        return text
    out, at, keep = [], 0, []  # keep: of each open #if [is this branch kept, was one kept]
    for m in _DIRECTIVE.finditer(text):
        if all(k[0] for k in keep):
            out.append(text[at : m.start()])
        at = m.end()
        body = m.group(1).strip()
        word = re.match(r"\w*", body).group()
        rest = body[len(word) :].strip()
        if not all(k[0] for k in keep) and word not in ("if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif"):
            continue
        if body and word not in DIRECTIVES:
            out.append(WRONG)
        elif word in ("include", "import", "include_next"):
            if not re.match(r'<[^<>\n]+>$|""$|[A-Za-z_]\w*(?:\(.*\))?$', rest):
                out.append(WRONG)
        elif word in ("define", "undef", "ifdef", "ifndef"):
            if not re.match(r"[A-Za-z_]", rest):
                out.append(WRONG)
            if word in ("ifdef", "ifndef"):
                keep.append([True, True])
        elif word == "if":
            taken = rest not in ("0", "(0)", "false", "1 0")
            taken = taken and not re.fullmatch(r"\(?\s*0\s*\)?", rest)
            keep.append([taken, taken])
            if not rest:
                out.append(WRONG)
        elif word in ("elif", "elifdef", "elifndef", "else"):
            if not keep:
                out.append(WRONG)
            else:
                keep[-1] = [not keep[-1][1], True]
        elif word == "endif":
            if not keep:
                out.append(WRONG)
            else:
                keep.pop()
    if all(k[0] for k in keep):
        out.append(text[at:])
    if keep:
        out.append(WRONG)
    return "".join(out)


def blanked(text: str, lang: str) -> str:
    """Comments taken out and literals replaced by empty ones; WRONG where a literal or comment does not end."""
    return TOKENS[lang].sub(_LITERALS[lang], text)


def shape(text: str, lang: str) -> str:
    """The shape of a text whose literals are blanked."""
    if lang != "java":
        text = _preprocessed(text.replace("\\\r\n", "").replace("\\\n", ""))
    text = _NAMES.sub(_WORD_CLASSES[lang], text).replace('""', " S ").replace("''", " C ")
    return _SPACE.sub(" ", text)


# -- chunks

_COMMENT_END = re.compile(r"\*/")
_TEXT_END = re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""')
_BRANCH = re.compile(r"^[ \t]*#[ \t]*(?:if|el)", re.M)
_RAW_END = re.compile(r'\)([^()\\\s"]{0,16})"')


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text cut after line ends (not continued ones), in pieces of about ``size``."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find("\n", at + size - 1)
        while cut >= 0 and text[cut - 1 : cut] == "\\":
            cut = text.find("\n", cut + 1)
        if cut < 0:
            break
        out.append(text[at : cut + 1])
        at = cut + 1
    return [*out, text[at:]]


def _from_code(text: str, lang: str) -> tuple[str, str, tuple | str | None]:
    """End state, blanked text and bracket summary of a chunk that begins in code. Brackets of a chunk with conditional directives are not summed up (UNTOLD): of its branches one counts."""
    end, blank = _ended(text, lang)
    if lang not in ("c", "cpp") or "#" not in blank:
        return end, blank, balance(blank)
    return end, blank, UNTOLD if _BRANCH.search(blank) else balance(_DIRECTIVE.sub("", blank))


def _ended(text: str, lang: str) -> tuple[str, str]:
    last = None
    for m in TOKENS[lang].finditer(text):
        last = m
    if last is not None and last.end() == len(text):
        s = last.group()
        opens = None
        if s.startswith("/*") and not (len(s) >= 4 and s.endswith("*/")):
            opens = "comment"
        elif lang == "java" and s.startswith('"""') and not (len(s) >= 6 and s.endswith('"""')):
            opens = "text"
        elif lang == "python" and s[-1:] != "\n" and (body := s.lstrip("rbuftRBUFT"))[:3] in ('"""', "\'\'\'") and not (len(body) >= 6 and body.endswith(body[:3])):
            opens = body[:3]
        elif lang == "cpp" and last.lastgroup == "d" and not s.endswith(f'){last.group("d")}"'):
            opens = "raw:" + last.group("d")
        if opens:
            begun = "" if opens == "comment" else "\'\'" if lang == "python" else ' ""'
            return opens, blanked(text[: last.start()], lang) + begun + " "
    return "code", blanked(text, lang)


def summary(text: str, lang: str, states: tuple[str, ...] | None = None) -> dict[str, tuple]:
    """For each lexer state at the chunk's start: the state at its end, its blanked text, and its bracket summary.

    A raw string's state holds its delimiter; those not listed do not end here. The
    first chunk of a file begins in code: ``states`` are those that are asked for.
    """
    out = {"code": _from_code(text, lang)}
    if states == ("code",):
        return out
    if lang == "python":
        for mark in ('"""', "\'\'\'"):
            m = re.match(rf"(?:[^\\]|\\[\s\S])*?{mark}", text)
            out[mark] = _from_code(text[m.end() :], lang) if m else (mark, "", ("", ""))
        return out
    m = _COMMENT_END.search(text)
    out["comment"] = _from_code(text[m.end() :], lang) if m else ("comment", "", ("", ""))
    if lang == "java":
        m = _TEXT_END.match(text)
        out["text"] = _from_code(text[m.end() :], lang) if m else ("text", "", ("", ""))
    elif lang == "cpp":
        for m in _RAW_END.finditer(text):
            state = "raw:" + m.group(1)
            if state not in out:
                out[state] = _from_code(text[m.end() :], lang)
    return out


def composed(first: dict, second: dict) -> dict:
    """The summary of two neighbours. Associative: states are followed through, texts and brackets joined."""
    out = {}
    for state in {*first, *(s for s in second if s.startswith("raw:"))}:
        middle, a, x = first.get(state, (state, "", ("", "")))
        end, b, y = second.get(middle, (middle, "", ("", "")))
        out[state] = (end, a + b, None if x is None or y is None else UNTOLD if UNTOLD in (x, y) else joined(x, y))
    return out


def reduced(summaries: list[dict]) -> tuple[str, tuple | str | None]:
    """The blanked text of the file with these chunks, in order, and its bracket summary."""
    out = summaries[0]
    for s in summaries[1:]:
        out = composed(out, s)
    end, text, brackets = out["code"]
    return (text if end == "code" else text + WRONG), brackets


def whole(summaries: list[dict]) -> str:
    """The blanked text alone."""
    return reduced(summaries)[0]


def balance(shape_: str) -> tuple[str, str] | None:
    """The bracket summary: closers without opener, openers left open; None if brackets cross."""
    closers, openers = [], []
    for c in _BRACKETS.findall(shape_):
        if c in _PAIRS:
            if openers:
                if openers.pop() != _PAIRS[c]:
                    return None
            else:
                closers.append(c)
        else:
            openers.append(c)
    return "".join(closers), "".join(openers)


def joined(first: tuple[str, str] | None, second: tuple[str, str] | None) -> tuple[str, str] | None:
    """The bracket summary of two neighbours, from theirs. Associative."""
    if first is None or second is None:
        return None
    n = min(len(first[1]), len(second[0]))
    for k in range(n):
        if first[1][-1 - k] != _PAIRS[second[0][k]]:
            return None
    return first[0] + second[0][n:], first[1][: len(first[1]) - n] + second[1]


# -- statements

_BRACKETS = re.compile(r"[()\[\]{}]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_SEGMENT_END = re.compile(r"(?<=[;{}])")
_BEFORE = {"if": "if ( n ) { } ", "do": "do { } ", "try": "try { } ", "catch": "try { } catch ( i i ) { } ", "tag": "struct i { } "}
_AFTER = {"do": " while ( n ) ;", "try": {"java": " finally { }", "cpp": " catch ( ... ) { }"}, "tag": " ;"}
_NEIGHBOURS = frozenset("else catch finally while case default".split())  # first words of what belongs to a statement before, or holds another one
BROKEN = ("broken", "")
_kept: dict[tuple, tuple | None] = {}


def _segment(lang: str, ctx: str, before: str, seg: str) -> tuple | None:
    """What a statement or a head of a block does: (context it opens or "", kind of what it ends or opens); BROKEN if the local grammar refuses a whole statement, None if it leaves it open."""
    key = (lang, ctx, before, seg)
    try:
        return _kept[key]
    except KeyError:
        pass
    words = seg.split(None, 2)
    first = words[0] if words else ""
    kind = first if first in ("if", "do", "try", "catch") else ""
    if before == "if" and seg.startswith("else if"):
        kind = "if"
    if lang != "java" and ctx != "func" and seg.endswith("{") and re.search(r"\b(?:struct|union|class)\b", seg) and "(" not in seg:
        kind = "tag"
    after = ""
    if seg.endswith("{"):
        after = "}"
        extra = _AFTER.get(kind, "")
        after += extra if isinstance(extra, str) else extra.get(lang, "")
    head = _BEFORE.get(before, "")
    if before == "catch" and lang == "cpp":
        head = "try { } catch ( ... ) { } "
    parser = Parser(head + seg + after, lang)
    found: tuple | None = None
    try:
        parser.items(ctx)
        if seg.endswith("{"):
            at = len(Parser(head + seg, lang).t) - 5
            opened = parser.opened.get(at)
            found = (opened, kind) if opened in ("func", "class", "file") else None
        else:
            found = ("", "if" if kind == "if" else "")
            if before == "do" or kind in ("do", "try", "catch"):
                found = ("", "") if before == "do" else None
    except Bad:
        # a statement without blocks, in a known context, that no neighbour can complete
        found = BROKEN if seg.endswith(";") and not kind and not before and first not in _NEIGHBOURS and (lang == "java" or ctx == "func") else None
    except RecursionError:
        found = None
    if len(_kept) >= SHAPES_KEPT:
        _kept.clear()
    _kept[key] = found
    return found


def settled(shape_: str, lang: str) -> bool | None:
    """Do the local grammars accept every statement and head? False as soon as they refuse one, or a block is closed that was never opened; None leaves the file to the whole grammar."""
    stack: list[tuple[str, str]] = [("file", "")]
    last, phase, held, depth = "", 0, "", 0
    *segments, tail = _SEGMENT_END.split(shape_)
    for part in segments:
        seg = held + part.strip()
        depth += part.count("(") - part.count(")")
        if depth:
            if depth < 0:
                return False
            if not seg.endswith(";"):
                return None
            held = seg + " "
            continue
        headed, held = bool(held), ""
        if seg == "}":
            if len(stack) == 1:
                return False
            if last in ("do", "try", "tag"):
                return None
            last = stack.pop()[1]
            continue
        if seg.endswith("}"):
            return None
        ctx = stack[-1][0]
        before = ""
        if last in ("do", "try", "tag") or last == "if" and seg.startswith("else") or last in ("try", "catch") and seg.startswith(("catch", "finally")):
            before = last
        if lang == "java" and ctx == "file":
            if seg.startswith("package"):
                if phase:
                    return None
                phase = 1
            elif seg.startswith("import"):
                if phase > 1:
                    return None
                phase = 1
            else:
                phase = 2
        found = _segment(lang, ctx, before, seg)
        if found == BROKEN:
            return None if headed else False
        if found is None:
            return None
        if found[0]:
            stack.append(found)
            last = ""
        else:
            last = found[1]
    return True if len(stack) == 1 and last not in ("do", "try", "tag") and not held and not tail.strip() else None


def judged(text: str, lang: str) -> tuple[bool | None, str]:
    """Is a text with blanked literals valid (None if it nests too deep to tell), and what told: lexer, statements, brackets or the whole grammar."""
    s = shape(text, lang).strip()
    if WRONG in s:
        return False, "lexer"
    told = settled(s, lang)
    if told is not None:
        return told, "statements"
    if balance(s) != ("", ""):
        return False, "brackets"
    return derives(s, lang), "whole"


def valid_blanked(text: str, lang: str) -> bool | None:
    """Is a text with blanked literals valid?"""
    return judged(text, lang)[0]


# -- Python

_PY_PIECE = re.compile(r"\\\r?\n|\r?\n|\r|b?''|[^\W\d]\w*|\d[\w.]*|[()\[\]{}]|[ \t\f]+|\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%&|^@=!<>:]=|->|\*\*|//|<<|>>|.", re.S)
_PY_HEADS = {"elif": "if i: pass\n", "else": "if i: pass\n", "except": "try: pass\n", "finally": "try: pass\n"}
#: What may stand before a clause, on its level.
_PY_AFTER = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "tryelse")}
_PY_BLOCKS = frozenset("if elif else for while def class with try except finally async".split())

def python_lines(text: str) -> list[tuple[int, str]] | bool | None:
    """(indent, shape) of the logical lines of a blanked text; False where brackets do not fit, None where the pass cannot tell."""
    out: list[tuple[int, str]] = []
    open_: list[str] = []
    words: list[str] = []
    indent, begun = 0, False
    for m in _PY_PIECE.finditer(text + "\n"):
        t = m.group()
        if t in ("\n", "\r\n", "\r"):
            if open_:
                continue
            if words:
                out.append((indent, " ".join(words)))
            words, indent, begun = [], 0, False
        elif t[0] == "\\":
            return None
        elif t[0] in " \t\f":
            if not begun:
                if t.strip(" "):
                    return None  # tabs: how deep is for the whole grammar to say
                indent = len(t)
        else:
            begun = True
            if t in ("(", "[", "{"):
                open_.append(t)
            elif t in _PAIRS and (not open_ or open_.pop() != _PAIRS[t]):
                return False
            if t[0].isdigit():
                t = "1" if t.isdigit() and t.isascii() and (t[0] != "0" or t == "0") else t
            elif t.isidentifier():
                if t in ("match", "case", "type"):
                    return None
                t = t if keyword.iskeyword(t) else "i"
            elif t not in ("\'\'", "b\'\'") and (not t.isascii() or not t.isprintable()):
                return None
            words.append(t)
    return False if open_ else out


def python_settled(text: str) -> bool | None:
    """Do the lines of a blanked text, one by one, and their indents make a valid module? None leaves it to the whole grammar."""
    lines = python_lines(text)
    if lines is None or lines is False:
        return lines
    levels: list[list] = [[0, ""]]  # indent and what the last statement was
    head = False  # a block must begin
    decorated = False
    for indent, line in lines:
        if decorated and indent != levels[-1][0]:
            return False
        if head:
            if indent <= levels[-1][0]:
                return False
            levels.append([indent, ""])
        else:
            while indent < levels[-1][0]:
                if levels.pop()[1] == "try":
                    return False
            if indent != levels[-1][0]:
                return False
        first = line.split(" ", 1)[0]
        before = levels[-1][1]
        if before == "try" and first not in ("except", "finally") or decorated and first not in ("def", "class", "async", "@"):
            return False
        head = first in _PY_BLOCKS and line.endswith(":")
        if first in _PY_BLOCKS and not head or line.startswith("except *"):
            return None
        if head:
            if first in _PY_AFTER and before not in _PY_AFTER[first]:
                return False
            if first == "else" and before in ("for", "while"):
                whole_ = f"while i: pass\n{line} pass"
            elif first == "else" and before == "except":
                whole_ = f"try: pass\nexcept: pass\n{line} pass"
            else:
                whole_ = f"{_PY_HEADS.get(first, '')}{line} pass" + "\nfinally: pass" * (first == "try")
            levels[-1][1] = "tryelse" if first == "else" and before == "except" else "" if first in ("else", "finally") else first
        else:
            whole_ = line + "\ndef i(): pass" if first == "@" else line
            levels[-1][1] = ""
        ok = _python_line(whole_)
        if not ok:
            return ok
        decorated = first == "@"
    return not head and not decorated and all(kind != "try" for _, kind in levels)


def judged_python(text: str) -> tuple[bool | None, str]:
    """The verdict on a text with blanked literals: by lines one by one, and for what they leave open by the interpreter's grammar on all of it."""
    if WRONG in text or "\0" in text:
        return False, "lexer"
    told = python_settled(text)
    if told is not None:
        return told, "statements"
    return _python_whole(text.replace("\'\'", "\'\' ")), "whole"


def _python_whole(text: str) -> bool | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):
            return None
    return True


def verdict(text: str, brackets: tuple | str | None, lang: str) -> tuple[bool | None, str]:
    """Is a file with this blanked text and bracket summary valid, and what told."""
    if brackets is None or brackets != UNTOLD and brackets != ("", ""):
        return False, "brackets"
    return judged_python(text) if lang == "python" else judged(text, lang)


def told(text: str, lang: str, size: int = CHUNK) -> tuple[bool | None, str]:
    """The verdict on a file's text, and what told. (A byte-order mark in front is no part of it.)"""
    parts = chunks(text.removeprefix("\ufeff"), size)
    if len(parts) == 1:  # nothing to reduce: brackets are counted if statements leave the file open
        end, blank = _ended(parts[0], lang)
        return verdict(blank if end == "code" else blank + WRONG, UNTOLD, lang)
    return verdict(*reduced([summary(c, lang, ("code",) if i == 0 else None) for i, c in enumerate(parts)]), lang)


def valid(text: str, lang: str, size: int = CHUNK) -> bool | None:
    """Is the text syntactically valid in java, c, cpp or python? None if it nests too deep to tell."""
    return told(text, lang, size)[0]


def valid_python(text: str, size: int = CHUNK) -> bool | None:
    return valid(text, "python", size)


# -- tables


def file_language(file: Column, language: Column) -> Column:
    """java, c, cpp or python by the file's last suffix, else by the assignment's language; null if neither is known."""
    suffix = F.lower(F.regexp_extract(F.coalesce(file, F.lit("")), r"\.([^./\\]*)$", 1))
    by = lambda c, table: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])
    return F.coalesce(by(suffix, SUFFIXES), by(F.lower(F.trim(language)), SPELLINGS))


def with_language(files: DataFrame, submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """``files`` with ``lang``. Of several assignments or languages of a submission the smallest known one counts."""
    spelled = F.coalesce(*[F.when(F.lower(F.trim("language")) == k, F.lit(v)) for k, v in SPELLINGS.items()])
    known = assignments.select("assignment_id", spelled.alias("by")).where("by IS NOT NULL").groupBy("assignment_id").agg(F.min("by").alias("by"))
    subs = submissions.where("assignment_id IS NOT NULL").select("sub_id", "assignment_id").distinct().join(known, "assignment_id").groupBy("sub_id").agg(F.min("by").alias("by"))
    own = files.withColumn("lang", file_language(F.col("file"), F.lit(None).cast("string")))
    # only files without a telling suffix need the join
    rest = own.where("lang IS NULL").drop("lang").join(subs, "sub_id", "left").withColumnRenamed("by", "lang")
    return own.where("lang IS NOT NULL").select(*files.columns, "lang").union(rest.select(*files.columns, "lang"))


def _verdicts(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [valid(t, lang) for t, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ok, pa.bool_())], ["key", "lang", "ok"])

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key, chunk, lang, no in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            for start, (end, text, brackets) in summary(chunk, lang, ("code",) if no == 0 else None).items():
                both = ("", UNTOLD) if brackets == UNTOLD else brackets or (None, None)
                rows.append((key, lang, no, start, end, text, *both))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        types = [batch.schema.field(0).type, pa.string(), pa.int32(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "lang", "no", "start", "end", "text", "closers", "openers"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            parts = chunks(text.removeprefix("\ufeff"), CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(parts), batch.schema.field(0).type), pa.array(parts, pa.string()), pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32())], ["key", "chunk", "lang", "no"]
            )


def _reduced(table: pa.Table) -> pa.Table:
    by: dict[int, dict] = {}
    for r in table.select(["no", "start", "end", "text", "closers", "openers"]).to_pylist():
        brackets = UNTOLD if r["openers"] == UNTOLD else None if r["openers"] is None else (r["closers"], r["openers"])
        by.setdefault(r["no"], {})[r["start"]] = (r["end"], r["text"], brackets)
    lang = table.column("lang")[0].as_py()
    ok, _ = verdict(*reduced([by[k] for k in sorted(by)]), lang)
    return pa.table({"key": table.column("key").slice(0, 1), "lang": table.column("lang").slice(0, 1), "ok": pa.array([ok], pa.bool_())})


def parsed(files: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, lang, ok`` of each row with a known language and a text that is not blank; ok is null where a text nests too deep to tell.

    Rows of one key are one file; equal rows come out as often as they are there. Files of
    more than CHUNK characters are summarised chunk by chunk and reduced per file.
    """
    kind = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"[^\s\x{FEFF}]"))
    small = rows.where(F.length("text") <= CHUNK)
    done = small.mapInArrow(_verdicts(None), f"key {kind}, lang string, ok boolean")
    large = rows.where(F.length("text") > CHUNK).distinct()
    cut = large.mapInArrow(_cut, f"key {kind}, chunk string, lang string, no int")
    cut = cut.repartition(F.col("key"), F.col("no"))  # chunks of one file go to different tasks
    parts = cut.mapInArrow(_summaries, f"key {kind}, lang string, no int, start string, end string, text string, closers string, openers string")
    reduced = parts.groupBy("key", "lang").applyInArrow(_reduced, f"key {kind}, lang string, ok boolean")
    return done.union(reduced).select(F.col("key").alias(key), "lang", "ok")


def broken_files(files: DataFrame, submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """``file_id`` of the source files whose text is not valid in their language. Null, empty and blank texts are no cases."""
    told = with_language(spread(files.select("file_id", "sub_id", "file", "text")), submissions, assignments)
    return parsed(told, "file_id", "text", "lang").where(~F.col("ok")).select("file_id").distinct()


def broken_rates(files: DataFrame, submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """``repository_id, lang, files, broken, rate`` over the files that could be judged; those that nest too deep are left out."""
    told = with_language(spread(files.select("file_id", "sub_id", "file", "text", "repository_id")), submissions, assignments)
    verdicts = parsed(told.withColumn("k", F.struct("file_id", "repository_id")), "k", "text", "lang").select("k.file_id", "k.repository_id", "lang", "ok").where("ok IS NOT NULL").distinct()
    rates = verdicts.groupBy("repository_id", "lang").agg(F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("broken"))
    return rates.withColumn("rate", F.round(F.col("broken") / F.col("files"), 4))
