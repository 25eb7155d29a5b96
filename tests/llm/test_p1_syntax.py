import pytest

from graphloom.llm.syntax import LANGUAGES, errors

BRACKETS = {
    "js": ("x = ", "[", "]", ";"), "ts": ("x = ", "(", ")", ";"), "py": ("x = ", "[", "]", "\n"), "rb": ("x = ", "[", "]", "\n"),
    "go": ("package m\nvar x = ", "(", ")", "\n"), "java": ("class A { int x = ", "(", ")", "; }"), "rust": ("fn f() { let x = ", "(", ")", "; }"),
}
BLOCKS = {
    "js": ("", "if (a) {", "}", "b();", ""), "ts": ("", "if (a) {", "}", "b();", ""), "go": ("package m\nfunc f() {\n", "if a {", "}", "b()", "}\n"),
    "java": ("class A { void f() {\n", "if (a) {", "}", "b();", "} }\n"), "rust": ("fn f() {\n", "if a {", "}", "b();", "}\n"), "rb": ("", "if a", "end", "b", ""), "py": ("", "if a:", "", "b", ""),
}


@pytest.mark.parametrize("lang", LANGUAGES)
def test_deep_nesting_is_valid(lang):
    a, o, c, z = BRACKETS[lang]
    mid = "" if o == "[" else "1"
    assert errors(lang, a + o * 10_000 + mid + c * 10_000 + z) == []
    assert errors(lang, a + o * 10_000 + mid + c * 9_999 + z) != []
    head, o, c, mid, tail = BLOCKS[lang]
    n = 1000
    text = head + "".join(" " * i + o + "\n" for i in range(n)) + " " * n + mid + "\n" + ("" if lang == "py" else "".join(" " * i + c + "\n" for i in reversed(range(n)))) + tail
    assert errors(lang, text) == []


@pytest.mark.parametrize("lang", LANGUAGES)
def test_always_valid(lang):
    for text in ("", " \n\t", "﻿", "\r\n\r"):
        assert errors(lang, text) == []


def test_all_errors_are_reported():
    text = "function a(1) {\n}\nlet ok = 1;\nlet = = 2;\nlet fine = 3;\nif (x {\n}\n"
    lines = [line for line, _ in errors("js", text, memo=False)]
    assert lines[0] == 1 and len(lines) >= 2
    assert errors("py", "def f(:\n    pass\nx = 1\ny = = 2\n")[0][0] == 1


def test_conflicts_and_truncation():
    whole = "package m\n\nfunc f(a int) int {\n\treturn a + 1\n}\n"
    assert errors("go", whole) == []
    assert errors("go", whole[: whole.index("return") + 8]) != []
    assert errors("go", whole.replace("\treturn a + 1\n", "<<<<<<< HEAD\n\treturn a\n=======\n\treturn 1\n>>>>>>> b\n")) != []
    assert errors("py", "fn main() { println!(\"x\"); }\n") != []


def test_spark_rows(spark):
    from graphloom.llm.p1_syntax import parse_files

    rows = [(1, "r", "py", "x = (", "e"), (2, "r", "py", None, "e"), (3, "r", None, "x", "e"), (4, "r", "js", "", "e"), (1, "r", "py", "x = (", "e")]
    got = sorted((r["task_id"], r["n_errors"] > 0) for r in parse_files(spark.createDataFrame(rows, "task_id bigint, repository_id string, lang string, content string, n_errors string")).collect())
    assert got == [(1, True), (1, True), (4, False)]


def test_what_python_allows():
    for text in ("match x:\n    case y as v,:\n        pass\n", 'x = f"{a["b"]}"\n', "x\u0301 = 1\na\ufe00b = x\u0301\n", "def f():\n    return (yield)\n"):
        assert errors("py", text) == []
    for text in ("\u0301x = 1\n", "x \u0301 = 1\n", "a \u201cb\u201d = 1\n"):
        assert errors("py", text) != []
