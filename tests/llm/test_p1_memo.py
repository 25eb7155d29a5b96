import pytest

from graphloom.llm import syntax

PAIRS = [
    ("if (a) {\n  b()\n  c()\n}\n", "if (a) { b() c() }\n"),
    ("class A {\n  x = 1\n  y = 2\n}\n", "class A { x = 1 y = 2 }\n"),
    ("function f() {\n  throw a\n}\n", "function f() {\n  throw\n  a\n}\n"),
]


@pytest.mark.parametrize("lang", ["js", "ts"])
@pytest.mark.parametrize("good, bad", PAIRS)
@pytest.mark.parametrize("good_first", [True, False])
def test_line_breaks_are_remembered(lang, good, bad, good_first):
    syntax._MEMO.clear()
    for text in (good, bad) if good_first else (bad, good):
        assert bool(syntax.errors(lang, text)) == (text == bad)
