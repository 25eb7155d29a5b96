"""Lexers of the languages with braces: ts, js, go, java, rust."""

from __future__ import annotations

import re

from graphloom.llm.syntax.base import Tokens, c_lines

# The reserved words and marks of each language.
JS_WORDS = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for
    function if import in instanceof new null return super switch this throw true try typeof var void while with
    yield let static await async of get set as from type interface namespace module declare abstract readonly public
    private protected implements keyof infer is asserts satisfies unique override global require constructor accessor
    out using""".split()
)
GO_WORDS = frozenset(
    """break case chan const continue default defer else fallthrough for func go goto if import interface map package
    range return select struct switch type var""".split()
)
JAVA_WORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends
    final finally float for goto if implements import instanceof int interface long native new package private
    protected public return short static strictfp super switch synchronized this throw throws transient try void
    volatile while true false null var record sealed permits yield when non module _""".split()
)
RUST_WORDS = frozenset(
    """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move
    mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules default
    auto raw _""".split()
)

_JS_PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@#]"
_GO_PUNCT = r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!~<>=:;,.(){}\[\]]"
_JAVA_PUNCT = r">>>=|\.\.\.|<<=|>>=|->|::|\+\+|--|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"
_RUST_PUNCT = r"<<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|\.\.|[-+*/%&|^!~<>=?:;,.(){}\[\]@#$]"

_NUM = r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?"
_ID = r"[^\W\d]\w*"


def _rx(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts))


_JS = _rx(
    r"(?P<sp>[ \t\f\v\xa0﻿]+|//[^\n  ]*)", r"(?P<nl>[\n  ]\s*)", r"(?P<cm>/\*(?:[^*]|\*(?!/))*\*/)",
    r"(?P<id>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4})*)", rf"(?P<num>(?:{_NUM})n?)",
    r"""(?P<str>"(?:[^"\\\n]|\\(?:[^\n]|\n))*"|'(?:[^'\\\n]|\\(?:[^\n]|\n))*')""", rf"(?P<op>{_JS_PUNCT})",
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
_GO = _rx(
    r"(?P<sp>[ \t\f\v\r]+|//[^\n]*)", r"(?P<nl>\n\s*)", r"(?P<cm>/\*(?:[^*]|\*(?!/))*\*/)", rf"(?P<id>{_ID})", rf"(?P<num>(?:{_NUM}|0[xX][0-9a-fA-F_.]+[pP][+-]?[0-9]+)i?)",
    r"""(?P<str>"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`)""", r"""(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))')""", rf"(?P<op>{_GO_PUNCT})",
)
_JAVA = _rx(
    r"(?P<sp>[ \t\f\r]+|//[^\n]*)", r"(?P<nl>\n\s*)", r"(?P<cm>/\*(?:[^*]|\*(?!/))*\*/)", r"(?P<id>(?:[^\W\d]|\$)(?:\w|\$)*)",
    rf"(?P<num>(?:{_NUM})[lLfFdD]?)", r'''(?P<str>"""[ \t\f]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?!"")(?:[^"\\\n]|\\[^\n])*"|""(?!"))''',
    r"(?P<chr>'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n]))')", rf"(?P<op>{_JAVA_PUNCT})",
)
_RUST = _rx(
    r"(?P<sp>[ \t\f\r]+|//[^\n]*)", r"(?P<nl>\n\s*)", r"(?P<cm>/\*)",
    r'''(?P<str>b?c?r(?P<h>\#*)"[\s\S]*?"(?P=h)(?!\#)|[bc]?"(?:[^"\\]|\\[\s\S])*")''',
    r"(?P<chr>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[nrt\\0'\"]))')", r"(?P<life>'[^\W\d]\w*)",
    r"(?P<id>(?:r\#)?[^\W\d]\w*)", r"(?P<num>0[xX][0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[bB][01_]+\w*|0[oO][0-7_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?(?:[iuf](?:8|16|32|64|128|size))?)",
    rf"(?P<op>{_RUST_PUNCT})",
)
_RUST_CM = re.compile(r"/\*|\*/")

# After these a slash divides; after anything else it starts a regular expression.
_ENDS = frozenset(["id", "num", "str", "tpl", "tpltail", "regex", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])
_GO_SEMI = frozenset(["id", "num", "str", "chr", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def lex_js(text: str) -> Tokens:
    t = Tokens()
    pos, n, nl = 0, len(text), True
    match, kinds = _JS.match, t.kinds
    stack: list[str] = []  # an open template's substitution is "${", other braces are "{"
    if text.startswith("#!"):
        pos = text.find("\n")
        pos = n if pos < 0 else pos
    while pos < n:
        m = match(text, pos)
        if m is None:
            if text[pos] == "`":
                pos = _template(t, text, pos, pos + 1, nl, stack, True)
            else:
                what = "text that never closes" if text[pos] in "\"'" else "unknown character"
                t.bad[len(kinds)] = what
                t.add("bad", pos, nl)
                pos += 1
            nl = False
            continue
        g = m.lastgroup
        if g == "sp":
            pos = m.end()
            continue
        if g == "nl":
            nl, pos = True, m.end()
            continue
        if g == "cm":
            nl, pos = nl or "\n" in m.group(), m.end()
            continue
        end = m.end()
        if g == "id":
            w = m.group()
            t.add(w if w in JS_WORDS else "id", pos, nl)
        elif g == "op":
            k = m.group()
            if k == "/" or k == "/=":
                prev = kinds[-1] if kinds else ""
                if prev not in _ENDS and not (prev in JS_WORDS and prev in _SOFT):
                    r = _JS_REGEX.match(text, pos)
                    if r:
                        t.add("regex", pos, nl)
                        pos, nl = r.end(), False
                        continue
            elif k == "{":
                stack.append("{")
            elif k == "}":
                if stack and stack.pop() == "${":
                    pos = _template(t, text, pos, end, nl, stack, False)
                    nl = False
                    continue
            if k == "/" and text.startswith("/*", pos):
                t.bad[len(kinds)] = "comment that never closes"
                t.add("bad", pos, nl)
                break
            t.add(k, pos, nl)
        elif g == "num" and end < n and (text[end].isalnum() or text[end] in "_$"):
            t.bad[len(kinds)] = "number that runs into a name"
            t.add("bad", pos, nl)
        else:
            t.add(g, pos, nl)
        pos, nl = end, False
    t.add("eof", n, True)
    c_lines(t, text)
    return t


_SOFT = frozenset("let static async of get set as from type interface namespace module declare abstract readonly public private protected is asserts global require".split())


def _template(t: Tokens, text: str, start: int, pos: int, nl: bool, stack: list[str], first: bool) -> int:
    m = _TPL.match(text, pos)
    if m.group(1) is None:
        t.bad[len(t.kinds)] = "template that never closes"
        t.add("bad", start, nl)
        return len(text)
    if m.group(1) == "`":
        t.add("tpl" if first else "tpltail", start, nl)
    else:
        t.add("tplhead" if first else "tplmid", start, nl)
        stack.append("${")
    return m.end()


def _plain(text: str, rx: re.Pattern, words: frozenset[str]) -> Tokens:
    t = Tokens()
    pos, n, nl = 0, len(text), True
    match, kinds = rx.match, t.kinds
    while pos < n:
        m = match(text, pos)
        if m is None:
            c = text[pos]
            t.bad[len(kinds)] = "text that never closes" if c in "\"'`" else "unknown character"
            t.add("bad", pos, nl)
            pos, nl = pos + 1, False
            continue
        g = m.lastgroup
        if g == "sp":
            pos = m.end()
            continue
        if g == "nl":
            nl, pos = True, m.end()
            continue
        if g == "cm":
            nl, pos = nl or "\n" in m.group(), m.end()
            continue
        end = m.end()
        if g == "id":
            w = m.group()
            t.add(w if w in words else "id", pos, nl)
        elif g == "op":
            k = m.group()
            if k == "/" and text.startswith("/*", pos):
                t.bad[len(kinds)] = "comment that never closes"
                t.add("bad", pos, nl)
                break
            t.add(k, pos, nl)
        elif g == "num" and end < n and (text[end].isalnum() or text[end] == "_"):
            t.bad[len(kinds)] = "number that runs into a name"
            t.add("bad", pos, nl)
        else:
            t.add(g, pos, nl)
        pos, nl = end, False
    t.add("eof", n, True)
    return t


def lex_java(text: str) -> Tokens:
    t = _plain(text, _JAVA, JAVA_WORDS)
    c_lines(t, text)
    return t


def lex_go(text: str) -> Tokens:
    """As the language asks, a line break behind a name, literal or closer becomes ``;``."""
    raw, t = _plain(text, _GO, GO_WORDS), Tokens()
    prev = ""
    for i, k in enumerate(raw.kinds):
        if raw.nl[i] and prev in _GO_SEMI:
            t.add(";", raw.starts[i], False)
        if i in raw.bad:
            t.bad[len(t.kinds)] = raw.bad[i]
        t.add(k, raw.starts[i], raw.nl[i])
        prev = k
    c_lines(t, text)
    return t


def lex_rust(text: str) -> Tokens:
    t = Tokens()
    pos, n, nl = 0, len(text), True
    match, kinds = _RUST.match, t.kinds
    if text.startswith("#!") and not text.startswith("#!["):
        pos = max(text.find("\n"), 0) or n
    while pos < n:
        m = match(text, pos)
        if m is None:
            t.bad[len(kinds)] = "text that never closes" if text[pos] in "\"'" else "unknown character"
            t.add("bad", pos, nl)
            pos, nl = pos + 1, False
            continue
        g = m.lastgroup
        end = m.end()
        if g == "sp":
            pos = end
            continue
        if g == "nl":
            nl, pos = True, end
            continue
        if g == "cm":
            depth, at = 1, end
            while depth:
                c = _RUST_CM.search(text, at)
                if c is None:
                    break
                depth, at = depth + (1 if c.group() == "/*" else -1), c.end()
            if depth:
                t.bad[len(kinds)] = "comment that never closes"
                t.add("bad", pos, nl)
                break
            nl, pos = nl or "\n" in text[pos:at], at
            continue
        if g == "id":
            w = m.group()
            t.add(w if w in RUST_WORDS else "id", pos, nl)
        elif g == "op":
            t.add(m.group(), pos, nl)
        elif g == "num" and end < n and (text[end].isalnum() or text[end] == "_"):
            t.bad[len(kinds)] = "number that runs into a name"
            t.add("bad", pos, nl)
        else:
            t.add("str" if g == "h" else g, pos, nl)
        pos, nl = end, False
    t.add("eof", n, True)
    c_lines(t, text)
    return t
