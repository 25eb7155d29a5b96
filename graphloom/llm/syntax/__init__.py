"""Syntax check of single files: ``errors(lang, text)``."""

from __future__ import annotations

_MEMO: dict[str, dict] = {}

LANGUAGES = ("ts", "js", "py", "go", "java", "rust", "rb")


def _parser(lang: str):
    if lang in ("ts", "js"):
        from graphloom.llm.syntax import js

        return js.parse_ts if lang == "ts" else js.parse_js
    if lang == "py":
        from graphloom.llm.syntax.python import parse_py

        return parse_py
    if lang == "go":
        from graphloom.llm.syntax.go import parse_go

        return parse_go
    if lang == "java":
        from graphloom.llm.syntax.java import parse_java

        return parse_java
    if lang == "rust":
        from graphloom.llm.syntax.rust import parse_rust

        return parse_rust
    from graphloom.llm.syntax.ruby import parse_rb

    return parse_rb


def errors(lang: str, text: str, memo: bool = True) -> list[tuple[int, str]]:
    """(line, cause) of every syntax error; empty when the text is valid.

    A leading byte order mark is dropped, every kind of line end counts as a line break, and a text
    of white space only is valid in every language.
    """
    if text.startswith("﻿"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text or text.isspace():
        return []
    found = _parser(lang)(text, _MEMO.setdefault(lang, {}) if memo else {})
    return [(text.count("\n", 0, at) + 1, cause) for at, cause in found]
