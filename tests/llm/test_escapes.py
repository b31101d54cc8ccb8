"""Python that only the interpreter's grammar can judge."""

import ast

import pytest

from codesim.llm import syntax


@pytest.mark.parametrize("text", [
    'x = "C:\\Users\\n"\n', 'x = "\\x1"\n', 'x = "\\N{zz}"\n', "x = '\\u12'\n", 'x = "a\0b"\n', "x = 1  # a\0b\n", '"""' + "a " * 50 + '\\N{zz}"""\n', 'x = "\\x41"\n', 'x = "\\\\x1"\n', 'x = r"\\x1"\n', 'x = "\\N{BULLET}"\n', "x = 1\n"])
@pytest.mark.parametrize("size", [16, syntax.CHUNK])
def test_python_escapes_and_nul_are_the_interpreters(text, size):
    try:
        ast.parse(text)
        want = True
    except (SyntaxError, ValueError):
        want = False
    assert syntax.valid_python(text, size) == want
