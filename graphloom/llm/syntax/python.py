"""py (3)."""

from __future__ import annotations

import re

from graphloom.llm.syntax.base import Parser, Tokens

# The keywords and operators of the language.
_WORDS = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global if
    import in is lambda nonlocal not or pass raise return try while with yield match case type _""".split()
)
_SOFT = frozenset(["match", "case", "type", "_"])
_STR = r"(?:[rRuUbBfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
# Combining marks and variation selectors, which go on with a name but are no word characters.
_MARKS = (
    "\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u0900-\u0903\u093a-\u093c\u093e-\u094f\u0e31\u0e34-\u0e3a"
    "\u0e47-\u0e4e\u1ab0-\u1abd\u1dc0-\u1dff\u20d0-\u20dc\u20e1\u20e5-\u20f0\u3099\u309a\ufe00-\ufe0f\ufe20-\ufe2f\U000e0100-\U000e01ef"
)
_RX = re.compile(
    "|".join([
        r"(?P<sp>[ \t\f]+|\\\n|#[^\n]*)", r"(?P<nl>\n)",
        _STR.join(["(?P<str>", r"""(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|""(?!")|''(?!')))"""]),
        rf"(?P<id>[^\W\d][\w{_MARKS}]*)",
        r"(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)",
        r"(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\*\*|//|>>|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])",
    ])
)
_INDENT = re.compile(r"[ \t\f]*")
_ASSIGN = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])
_BIN = {
    "or": 1, "and": 2, "in": 4, "is": 4, "not": 4, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4, "|": 5, "^": 6, "&": 7,
    "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10, "**": 12,
}
_STOP = frozenset(["newline", ";", "eof", ")", "]", "}", ":", "=", "dedent"])


def lex_py(text: str) -> Tokens:
    """Adds ``newline``, ``indent`` and ``dedent``; inside brackets line breaks are white space."""
    t = Tokens()
    kinds, add = t.kinds, t.add
    pos, n, depth, fresh = 0, len(text), 0, True
    if text.startswith("#!"):
        pos = max(text.find("\n"), 0) or n
    cols = [(0, 0)]
    match = _RX.match
    while pos < n:
        if fresh and not depth:
            m = _INDENT.match(text, pos)
            end = m.end()
            if end >= n or text[end] in "\n#" or text.startswith("\\\n", end):
                if text.startswith("\\\n", end):
                    fresh = False
                pos = end
                if end < n and text[end] == "#":
                    e = text.find("\n", end)
                    pos = n if e < 0 else e
                if pos < n and text[pos] == "\n":
                    pos += 1
                continue
            ws = text[pos:end]
            if "\f" in ws:
                ws = ws[ws.rfind("\f") + 1:]
            col, alt = _columns(ws)
            if (col, alt) != cols[-1]:
                if col > cols[-1][0] and alt > cols[-1][1]:
                    cols.append((col, alt))
                    add("indent", end, True)
                else:
                    while col < cols[-1][0]:
                        cols.pop()
                        add("dedent", end, True)
                    if (col, alt) != cols[-1]:
                        t.bad[len(kinds)] = "inconsistent indentation"
                        add("bad", end, True)
            t.lines.append((len(kinds), col))
            pos, fresh = end, False
        m = match(text, pos)
        if m is None:
            t.bad[len(kinds)] = "text that never closes" if text[pos] in "\"'" else "unknown character"
            add("bad", pos, False)
            if text[pos] in "\"'":
                e = text.find("\n", pos)
                pos = n if e < 0 else e
            else:
                pos += 1
            continue
        g, end = m.lastgroup, m.end()
        if g == "sp":
            pos = end
            continue
        if g == "nl":
            pos = end
            if not depth:
                if kinds and kinds[-1] != "newline":
                    add("newline", m.start(), False)
                fresh = True
            continue
        if g == "id":
            w = m.group()
            add(w if w in _WORDS else "id", pos, False)
        elif g == "op":
            k = m.group()
            if k in "([{":
                depth += 1
            elif k in ")]}" and depth:
                depth -= 1
            add(k, pos, False)
        elif g == "num" and end < n and (text[end].isalnum() or text[end] == "_"):
            tail = re.compile(r"(?:and|or|in|is|if|else|for|not)\b").match(text, end)
            if tail:
                add("num", pos, False)
            else:
                t.bad[len(kinds)] = "number that runs into a name"
                add("bad", pos, False)
        elif g == "num" and len(s := m.group()) > 1 and s[0] == "0" and s.replace("_", "").isdigit() and s.strip("0_"):
            t.bad[len(kinds)] = "number with a leading zero"
            add("bad", pos, False)
        else:
            add(g, pos, False)
        pos = end
    if kinds and kinds[-1] != "newline" and kinds[-1] != "dedent":
        add("newline", n, False)
    for _ in cols[1:]:
        add("dedent", n, True)
    add("eof", n, True)
    return t


def _columns(ws: str) -> tuple[int, int]:
    if "\t" not in ws:
        return len(ws), len(ws)
    col = alt = 0
    for c in ws:
        if c == "\t":
            col, alt = (col // 8 + 1) * 8, alt + 1
        else:
            col, alt = col + 1, alt + 1
    return col, alt


class Py(Parser):
    ID = frozenset(["id"]) | _SOFT
    BIN = {k: (p, k == "**") for k, p in _BIN.items()}
    CONT = frozenset(["else", "elif", "except", "finally", ")", "]", "}"])
    SYNC = frozenset(["newline"])
    START = frozenset("def class if for while try with return import from raise assert".split())

    def __init__(self, toks, memo):
        super().__init__(toks, memo)
        self._sums = None  # indents less dedents before each token
        self.kind = ""  # what the expression just read can stand for: target, call, tuple or else

    def chunk_end(self, i):
        j = super().chunk_end(i)
        # the dedents before the next line belong to the blocks above
        while j > 0 and self.K[j - 1] in ("dedent", "indent") and j - 1 > i:
            j -= 1
            if self.K[j] == "dedent" and self._depth(i, j) == 0:
                break
        if j == len(self.K) - 1:
            while j - 1 > i and self.K[j - 1] == "dedent":
                j -= 1
        if j <= i:
            return -1
        need = self._depth(i, j)
        while need > 0 and self.K[j] == "dedent":
            j, need = j + 1, need - 1
        return j if need == 0 else -1

    def _depth(self, i, j):
        if self._sums is None:
            self._sums = [0]
            for k in self.K:
                self._sums.append(self._sums[-1] + (k == "indent") - (k == "dedent"))
        return self._sums[j] - self._sums[i]

    def program(self):
        self.items(self.statement, "s", frozenset(["eof"]))

    def recover(self, i, end):
        """Panic mode: to the next line; indents met on the way are passed over with their blocks."""
        K = self.K
        while K[i] not in ("newline", "eof"):
            i += 1
        if K[i] == "newline":
            i += 1
        while K[i] == "indent" or K[i] == "dedent" and "dedent" not in end:
            i += 1
        self.i = i

    def suite(self):
        self.need(":")
        if not self.at("newline"):
            return self.simple_line()
        self.i += 1
        self.need("indent")
        self.items(self.statement, "s", frozenset(["dedent"]))
        self.need("dedent")

    def statement(self):
        K, i = self.K, self.i
        k = K[i]
        f = _COMPOUND.get(k)
        if f is not None and (k != "match" and k != "type" or self.soft(k)):
            return getattr(self, f)()
        if k in ("indent", "dedent"):
            self.fail("unexpected " + k)
        self.simple_line()

    def soft(self, k) -> bool:
        if k == "type":
            return False
        j = self.i + 1
        if self.K[j] in ("=", ".", ",", ")", ":", "newline") or self.K[j] in _ASSIGN:
            return False
        i = self.i
        self.i += 1
        ok = self.attempt(self.star_expressions) and self.at(":") and self.K[self.i + 1] == "newline" and self.K[self.i + 2] == "indent" and self.K[self.i + 3] == "case"
        self.i = i
        return ok

    def simple_line(self):
        while True:
            self.simple()
            if self.eat(";"):
                if self.eat("newline"):
                    return
                continue
            return self.need("newline")

    def simple(self):
        K = self.K
        k = K[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if K[self.i] not in _STOP:
                self.star_expressions()
        elif k == "raise":
            self.i += 1
            if K[self.i] not in _STOP:
                self.expression()
                if self.eat("from"):
                    self.expression()
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.eat(","):
                self.name()
        elif k == "del":
            self.i += 1
            self.targets()
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.eat(","):
                self.expression()
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.eat("as"):
                    self.name()
                if not self.eat(","):
                    break
        elif k == "from":
            self.from_()
        elif k == "type" and K[self.i + 1] in self.ID and K[self.i + 2] in ("=", "["):
            self.i += 2
            self.type_params()
            self.need("=")
            self.expression()
        else:
            self.expression_statement()

    def targets(self):
        while True:
            self.expression()
            if self.kind not in ("name", "target", "tuple"):
                self.fail("cannot delete this")
            if not self.eat(",") or self.K[self.i] in _STOP:
                return

    def dotted(self):
        self.name()
        while self.eat("."):
            self.name()

    def from_(self):
        self.need("from")
        dots = False
        while self.at(".") or self.at("..."):
            self.i += 1
            dots = True
        if not self.at("import") or not dots:
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return
        paren = self.eat("(")
        while True:
            self.name()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                break
            if paren and self.at(")"):
                break
        if paren:
            self.need(")")

    def expression_statement(self):
        K = self.K
        self.yield_or_stars()
        k = K[self.i]
        if k == ":":
            if self.kind not in ("name", "target"):
                self.fail("only a name can be annotated")
            self.i += 1
            self.expression()
            if self.eat("="):
                self.yield_or_stars()
        elif k in _ASSIGN:
            if self.kind not in ("name", "target"):
                self.fail("the left side cannot be assigned to")
            self.i += 1
            self.yield_or_stars()
        else:
            while self.at("="):
                if self.kind not in ("name", "target", "tuple"):
                    self.fail("the left side cannot be assigned to")
                self.i += 1
                self.yield_or_stars()

    def yield_or_stars(self):
        if self.at("yield"):
            self.yield_()
        else:
            self.star_expressions(True)

    def yield_(self):
        self.need("yield")
        if self.eat("from"):
            self.expression()
        elif self.K[self.i] not in _STOP:
            self.star_expressions()
        self.kind = ""

    # -- compound statements
    def c_if(self):
        self.i += 1
        self.named()
        self.suite()
        while self.eat("elif"):
            self.named()
            self.suite()
        if self.eat("else"):
            self.suite()

    def c_while(self):
        self.i += 1
        self.named()
        self.suite()
        if self.eat("else"):
            self.suite()

    def c_for(self):
        self.need("for")
        self.for_targets()
        self.need("in")
        self.star_expressions()
        self.suite()
        if self.eat("else"):
            self.suite()

    def for_targets(self):
        while True:
            self.eat("*")
            self.binary(5)
            if self.kind not in ("name", "target", "tuple"):
                self.fail("the loop target cannot be assigned to")
            if not self.eat(",") or self.at("in"):
                return

    def c_try(self):
        self.i += 1
        self.suite()
        handlers = False
        while self.at("except"):
            handlers = True
            self.i += 1
            self.eat("*")
            if not self.at(":"):
                self.expression()
                if self.eat("as"):
                    self.name()
            self.suite()
        if handlers and self.eat("else"):
            self.suite()
        if self.eat("finally"):
            self.suite()
        elif not handlers:
            self.fail("expected except or finally")

    def c_with(self):
        self.need("with")
        i = self.i
        if self.at("(") and self.attempt(self.with_paren):
            return self.suite()
        self.i = i
        self.with_items()
        self.suite()

    def with_paren(self):
        self.need("(")
        while not self.at(")"):
            self.with_item()
            if not self.eat(","):
                break
        self.need(")")
        if not self.at(":"):
            self.fail("expected :")

    def with_items(self):
        self.with_item()
        while self.eat(","):
            self.with_item()

    def with_item(self):
        self.expression()
        if self.eat("as"):
            self.eat("*")
            self.binary(5)
            if self.kind not in ("name", "target", "tuple"):
                self.fail("the target cannot be assigned to")

    def c_async(self):
        self.i += 1
        k = self.K[self.i]
        if k not in ("def", "for", "with"):
            self.fail(f"expected def, for or with, found {k}")
        getattr(self, "c_" + k)()

    def c_at(self):
        while self.eat("@"):
            self.named()
            self.need("newline")
        if self.K[self.i] not in ("def", "class", "async"):
            self.fail("expected a function or class behind a decorator")
        self.statement()

    def c_class(self):
        self.i += 1
        self.name()
        self.type_params()
        if self.at("("):
            self.args()
        self.suite()

    def c_def(self):
        self.need("def")
        self.name()
        self.type_params()
        self.need("(")
        self.params(")", True)
        self.need(")")
        if self.eat("->"):
            self.expression()
        self.suite()

    def type_params(self):
        if not self.eat("["):
            return
        while not self.at("]"):
            self.eat("*") or self.eat("**")
            self.name()
            if self.eat(":"):
                self.expression()
            if self.eat("="):
                self.expression()
            if not self.eat(","):
                break
        self.need("]")

    def params(self, end, annotated):
        star = default = False
        while not self.at(end):
            if self.eat("/"):
                pass
            elif self.eat("**"):
                self.name()
                if annotated and self.eat(":"):
                    self.expression()
                self.eat(",")
                break
            elif self.eat("*"):
                if star:
                    self.fail("a second * in parameters")
                star = True
                if not self.at(","):
                    self.name()
                    if annotated and self.eat(":"):
                        self.eat("*")
                        self.expression()
                elif self.K[self.i + 1] in (end, "**"):
                    self.fail("a name must follow a bare *")
            else:
                self.name()
                if annotated and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    default = True
                    self.expression()
                elif default and not star:
                    self.fail("a parameter without a default behind one with")
            if not self.eat(","):
                break

    def c_match(self):
        self.need("match")
        self.star_expressions()
        self.need(":")
        self.need("newline")
        self.need("indent")
        while not self.at("dedent"):
            self.need("case")
            self.pattern_list()
            if self.eat("if"):
                self.named()
            self.suite()
        self.need("dedent")

    def pattern_list(self):
        while True:
            self.eat("*")
            self.pattern()
            if not self.eat(",") or self.K[self.i] in (":", "if"):
                return

    def pattern(self):
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()
        if self.eat("as"):
            self.name()

    def pattern_one(self):
        K = self.K
        k = K[self.i]
        if k in self.ID:
            self.dotted()
            if self.eat("("):
                while not self.at(")"):
                    if K[self.i] in self.ID and K[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(")")
        elif k in ("(", "["):
            end = ")" if k == "(" else "]"
            self.i += 1
            while not self.at(end):
                self.eat("*")
                self.pattern()
                if not self.eat(","):
                    break
            self.need(end)
        elif k == "{":
            self.i += 1
            while not self.at("}"):
                if self.eat("**"):
                    self.name()
                else:
                    self.binary(9)
                    self.need(":")
                    self.pattern()
                if not self.eat(","):
                    break
            self.need("}")
        elif k in ("num", "-", "str", "None", "True", "False"):
            self.binary(9)
        else:
            self.fail(f"expected a pattern, found {k}")

    # -- expressions
    def star_expressions(self, walrus: bool = False):
        kind, n = "", 0
        ok = True
        while True:
            if self.eat("*"):
                self.binary(5)
                ok = ok and self.kind in ("name", "target", "tuple")
            else:
                self.expression()
                ok = ok and self.kind in ("name", "target", "tuple")
            n += 1
            kind = self.kind
            if not self.eat(","):
                break
            n += 1
            if self.K[self.i] in _STOP or self.K[self.i] in _ASSIGN:
                break
        self.kind = kind if n == 1 else "tuple" if ok else ""

    def named(self):
        if self.K[self.i] in self.ID and self.K[self.i + 1] == ":=":
            self.i += 2
            self.expression()
            self.kind = ""
        else:
            self.expression()

    def expression(self):
        if self.at("lambda"):
            self.i += 1
            self.params(":", False)
            self.need(":")
            self.expression()
            self.kind = ""
            return
        self.binary()
        if self.eat("if"):
            self.binary()
            self.need("else")
            self.expression()
            self.kind = ""

    def binary(self, least=0):
        K = self.K
        k = K[self.i]
        if k == "not":
            if least > 3:
                self.fail("unexpected not")
            self.i += 1
            self.binary(3)
            self.kind = ""
        else:
            self.unary()
        while True:
            k = K[self.i]
            p = self.BIN.get(k)
            if p is None or p[0] < least:
                return
            self.i += 1
            if k == "not":
                self.need("in")
            elif k == "is":
                self.eat("not")
            self.binary(p[0] if p[1] else p[0] + 1)
            self.kind = ""

    def unary(self):
        K = self.K
        k = K[self.i]
        if k in ("+", "-", "~"):
            self.i += 1
            self.binary(11)
            self.kind = ""
        elif k == "await":
            self.i += 1
            self.postfix()
            self.kind = ""
        else:
            self.postfix()

    def postfix(self):
        K = self.K
        self.primary()
        while True:
            k = K[self.i]
            if k == ".":
                self.i += 1
                self.name()
                self.kind = "target"
            elif k == "(":
                self.args()
                self.kind = ""
            elif k == "[":
                self.i += 1
                while True:
                    self.slice()
                    if not self.eat(",") or self.at("]"):
                        break
                self.need("]")
                self.kind = "target"
            else:
                return

    def slice(self):
        if self.eat("*"):
            return self.binary(5)
        if not self.at(":"):
            self.named()
        n = 0
        while n < 2 and self.eat(":"):
            n += 1
            if self.K[self.i] not in (":", "]", ","):
                self.expression()

    def args(self):
        K = self.K
        self.need("(")
        seen = 0
        while not self.at(")"):
            if self.eat("**"):
                seen = 2
                self.expression()
            elif self.eat("*"):
                self.expression()
            elif K[self.i] in self.ID and K[self.i + 1] == "=":
                self.i += 2
                seen = max(seen, 1)
                self.expression()
            else:
                self.named()
                if self.at("for") or self.at("async"):
                    self.comprehension()
                elif self.at("="):
                    self.fail("a keyword argument needs a name")
                elif seen:
                    self.fail("a positional argument behind a keyword argument")
            if not self.eat(","):
                break
        self.need(")")

    def comprehension(self):
        while self.at("for") or self.at("async"):
            self.eat("async")
            self.need("for")
            self.for_targets()
            self.need("in")
            self.binary()
            while self.eat("if"):
                if self.K[self.i] in self.ID and self.K[self.i + 1] == ":=":
                    self.i += 2
                if self.at("lambda"):
                    self.expression()
                else:
                    self.binary()

    def primary(self):
        K = self.K
        k = K[self.i]
        if k in self.ID:
            self.i += 1
            self.kind = "name"
        elif k == "str":
            self.i += 1
            while self.eat("str"):
                pass
            self.kind = ""
        elif k in ("num", "True", "False", "None", "..."):
            self.i += 1
            self.kind = ""
        elif k == "(":
            self.i += 1
            if self.eat(")"):
                self.kind = "tuple"
                return
            if self.at("yield"):
                self.yield_()
                self.need(")")
                return
            self.elements(")", True)
        elif k == "[":
            self.i += 1
            if self.eat("]"):
                self.kind = "tuple"
                return
            self.elements("]", False)
        elif k == "{":
            self.i += 1
            self.braces()
            self.kind = ""
        else:
            self.fail(f"expected an expression, found {k}")

    def elements(self, end, paren):
        ok, n, comma = True, 0, False
        while not self.at(end):
            star = self.eat("*")
            if star:
                self.binary(5)
            else:
                self.named()
            ok = ok and self.kind in ("name", "target", "tuple")
            one = self.kind
            n += 1
            if n == 1 and not star and (self.at("for") or self.at("async")):
                self.comprehension()
                ok = False
                break
            if not self.eat(","):
                if paren and n == 1 and star:
                    self.fail("a starred expression alone")
                comma = comma
                break
            comma = True
        self.need(end)
        self.kind = one if paren and n == 1 and not comma and ok else "tuple" if ok else ""

    def braces(self):
        if self.eat("}"):
            return
        first = True
        while not self.at("}"):
            if self.eat("**"):
                self.binary(5)
            elif self.eat("*"):
                self.binary(5)
            else:
                self.named()
                if self.eat(":"):
                    self.expression()
                if first and (self.at("for") or self.at("async")):
                    self.comprehension()
                    break
            first = False
            if not self.eat(","):
                break
        self.need("}")


_COMPOUND = {
    "if": "c_if", "while": "c_while", "for": "c_for", "try": "c_try", "with": "c_with", "async": "c_async", "@": "c_at",
    "class": "c_class", "def": "c_def", "match": "c_match",
}


def parse_py(text: str, memo: dict):
    return Py(lex_py(text), memo).run()
