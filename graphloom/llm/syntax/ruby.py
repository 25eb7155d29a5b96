"""rb."""

from __future__ import annotations

import re

from graphloom.llm.syntax.base import Parser, Tokens, c_lines

# The keywords of the language.
_WORDS = frozenset(
    """BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil
    not or redo rescue retry return self super then true undef unless until when while yield __method__ __FILE__
    __LINE__""".split()
)
_RX = re.compile(
    "|".join([
        r"(?P<sp>[ \t\f\r]+|\\\n|\#[^\n]*)", r"(?P<nl>\n)", r"(?P<id>[^\W\d]\w*[?!]?(?!=(?![=~>]))|[^\W\d]\w*)",
        r"(?P<var>@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|\d+|[~*$?!@/\;,.=:<>\"&`'+0_-]))",
        r"(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?)r?i?)",
        r"(?P<op>\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|&\.|\*\*|==|!=|>=|<=|&&|\|\||=~|!~|\.\.|::|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|=>|->|[-+*/%&|^!~<>=?:;,.(){}\[\]])",
    ])
)
_INTERP = r"\#\{(?:[^{}\"']|\"(?:[^\"\\]|\\.)*\"|'[^']*'|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_DQ = re.compile(rf'"(?:[^"\\#]|\\[\s\S]|{_INTERP}|\#)*"')
_SQ = re.compile(r"'(?:[^'\\]|\\[\s\S])*'")
_BT = re.compile(r"`(?:[^`\\]|\\[\s\S])*`")
_REGEX = re.compile(rf"/(?:[^/\\#\n]|\\[\s\S]|{_INTERP}|\#|\n)*/[a-z]*")
_HEREDOC = re.compile(r"<<([~-]?)(?:([\"'`])([^\n\"'`]+)\2|([^\W\d]\w*))")
_SYM = re.compile(r":(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+-]@|[-+*/%<>&|^~])")
_LABEL = re.compile(r"(?:[^\W\d]\w*[?!]?|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'):(?!:)")
_PCT = re.compile(r"%([wWiIqQrsx]?)([^\w\s])")
_CHAR = re.compile(r"\?(?:\\.|[^\s\w]|\w)(?!\w)")
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
# Behind these an operand has ended, so what follows is an operator.
_ENDS = frozenset(["id", "const", "var", "num", "str", "sym", "regex", ")", "]", "}", "end", "self", "true", "false", "nil", "super", "yield", "__method__", "__FILE__", "__LINE__", "redo", "retry"])
_GOES_ON = frozenset(
    """** <=> === ... << && || & == != >= <= =~ !~ .. :: >> += -= *= /= %= &= |= ^= **= <<= >>= &&= ||= => + - * / % ^ ! ~
    < > = ? : , . ( [ { &. and or not -> nl""".split()
)
_BIN = {
    "..": 2, "...": 2, "||": 3, "&&": 4, "<=>": 6, "==": 6, "===": 6, "!=": 6, "=~": 6, "!~": 6, "<": 7, "<=": 7, ">": 7,
    ">=": 7, "|": 8, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 14,
}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", "&=", "|=", "^=", "&&=", "||="])
_ARG = frozenset(
    """id const var num str sym regex label self nil true false not -> defined? case if unless while begin def yield super
    lambda __method__ __FILE__ __LINE__ :: class module""".split()
) - frozenset(["if", "unless", "while", "class", "module"])
_MODIFIERS = frozenset(["if", "unless", "while", "until", "rescue"])
_END = frozenset(["end"])
_BRANCH = frozenset(["end", "else", "elsif", "when", "in", "rescue", "ensure"])
_EOF = frozenset(["eof"])


def lex_rb(text: str) -> Tokens:
    """Line breaks that end a statement are ``nl``; ``sp`` marks tokens behind a space."""
    t = Tokens()
    kinds = t.kinds
    pos, n, first, space = 0, len(text), True, True
    if text.startswith("#!"):
        pos = max(text.find("\n"), 0) or n
    heredocs: list[tuple[str, str]] = []
    depth: list[str] = []

    def add(kind: str, start: int) -> None:
        nonlocal first, space
        t.add(kind, start, first)
        spaces.append(space)
        first = space = False

    spaces: list[bool] = []
    match = _RX.match
    end_at = re.compile(r"^__END__$", re.M).search(text)
    if end_at:
        n = end_at.start()
    while pos < n:
        c = text[pos]
        prev = kinds[-1] if kinds else "nl"
        operand = prev in _ENDS
        follows = operand and (prev == "id") and space and pos + 1 < n and not text[pos + 1].isspace()
        rx = None
        if c == '"':
            rx, kind = _DQ, "str"
        elif c == "'":
            rx, kind = _SQ, "str"
        elif c == "`" and prev not in (".", "def"):
            rx, kind = _BT, "str"
        elif c == "/" and (not operand or follows) and prev not in (".", "def"):
            rx, kind = _REGEX, "regex"
        if rx is not None:
            m = rx.match(text, pos)
            if m is None or m.end() > n:
                t.bad[len(kinds)] = "text that never closes"
                add("bad", pos)
                e = text.find("\n", pos)
                pos = n if e < 0 else e
                continue
            end = m.end()
            if kind == "str" and text.startswith(":", end) and not text.startswith("::", end) and prev in ("{", ",", "(", "nl", "id", "|") and not (prev == "?"):
                kind, end = "label", end + 1
            add(kind, pos)
            pos = end
            continue
        if c == ":" and (m := _SYM.match(text, pos)) and not text.startswith("::", pos) and not (operand and not space and prev != "id"):
            add("sym", pos)
            pos = m.end()
            continue
        if c == "<" and text.startswith("<<", pos) and (not operand or prev == "id" and space) and (m := _HEREDOC.match(text, pos)):
            heredocs.append((m.group(3) or m.group(4), m.group(1)))
            add("str", pos)
            pos = m.end()
            continue
        if c == "%" and (not operand or follows) and (m := _PCT.match(text, pos)):
            pos2 = _percent(text, m)
            if pos2 < 0:
                t.bad[len(kinds)] = "text that never closes"
                add("bad", pos)
                break
            add("regex" if m.group(1) == "r" else "str", pos)
            pos = pos2
            continue
        if c == "?" and not operand and (m := _CHAR.match(text, pos)):
            add("str", pos)
            pos = m.end()
            continue
        if first and text.startswith("=begin", pos) and (pos == 0 or text[pos - 1] == "\n"):
            e = re.compile(r"^=end[^\n]*$", re.M).search(text, pos)
            if e is None:
                t.bad[len(kinds)] = "comment that never closes"
                add("bad", pos)
                break
            pos = e.end()
            continue
        m = match(text, pos)
        if m is None:
            t.bad[len(kinds)] = "unknown character"
            add("bad", pos)
            pos += 1
            continue
        g, end = m.lastgroup, m.end()
        if g == "sp":
            space = True
            pos = end
            continue
        if g == "nl":
            pos = end
            for name, dash in heredocs:
                e = re.compile(rf"^{'[ \t]*' if dash else ''}{re.escape(name)}\r?$", re.M).search(text, pos)
                if e is None:
                    t.bad[len(kinds)] = "text that never closes"
                    add("bad", pos)
                    pos = n
                    break
                pos = min(e.end() + 1, n)
            heredocs.clear()
            space = True
            ahead = _AHEAD.match(text, pos)
            if prev not in _GOES_ON and not (depth and depth[-1] in "([") and not ahead:
                t.add("nl", m.start(), False)
                spaces.append(False)
            first = True
            continue
        if g == "id":
            w = m.group()
            lab = _LABEL.match(text, pos)
            if lab and prev not in ("?",) and not (prev == "." or prev == "&."):
                add("label", pos)
                pos = lab.end()
                continue
            if prev in (".", "&.", "::") and not w[0].isupper() or prev == "def" and w not in ("self",):
                kind = "id"
            elif w in _WORDS:
                kind = w
            elif w == "defined" and text.startswith("?", end):
                kind, end = "defined?", end + 1
            else:
                kind = "const" if w[0].isupper() and w[-1] not in "?!" else "id"
            add(kind, pos)
        elif g == "op":
            k = m.group()
            if k in "([{":
                depth.append(k)
            elif k in ")]}" and depth:
                depth.pop()
            elif k == "|" and depth:
                pass
            if k in ("[", "-", "*", "&", "**", "(", "::", "+", "!", "{") and space and prev == "id" and end < n and not text[end].isspace() and k not in ("(", "{"):
                k = "arg" + k  # may start an argument of a call without parentheses
            add(k, pos)
        elif g == "num" and end < n and (text[end].isalnum() or text[end] == "_"):
            t.bad[len(kinds)] = "number that runs into a name"
            add("bad", pos)
        else:
            add(g, pos)
        pos = end
    if heredocs:
        t.bad[len(kinds)] = "text that never closes"
        add("bad", n)
    t.add("nl", n, False)
    t.add("eof", n, True)
    c_lines(t, text)
    return t


_AHEAD = re.compile(r"(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*(?:\.(?![.])|&\.)")


def _percent(text: str, m: re.Match) -> int:
    o = m.group(2)
    c = _CLOSERS.get(o, o)
    depth, i, n = 1, m.end(), len(text)
    while i < n:
        ch = text[i]
        if ch == "\\":
            i += 2
            continue
        if ch == c:
            depth -= 1
            if not depth:
                i += 1
                while m.group(1) == "r" and i < n and text[i].isalpha():
                    i += 1
                return i
        elif ch == o:
            depth += 1
        i += 1
    return -1


class Rb(Parser):
    BREAKS = True
    ID = frozenset(["id", "const"])
    BIN = {k: (p, k == "**") for k, p in _BIN.items()}
    CONT = frozenset(["else", "elsif", "when", "in", "rescue", "ensure", "end", ")", "]", "}", ".", "&.", "&&", "||", "?", ":"])
    SYNC = frozenset(["nl", ";"])
    START = frozenset("def class module begin if unless while until case return raise".split())

    def __init__(self, toks, memo):
        super().__init__(toks, memo)
        self.no_do = False
        self.target = False

    def at(self, kind):
        k = self.K[self.i]
        return k == kind or k == "arg" + kind

    def eat(self, kind):
        k = self.K[self.i]
        if k == kind or k == "arg" + kind:
            self.i += 1
            return True
        return False

    def need(self, kind):
        if not self.eat(kind):
            self.fail(f"expected {kind}, found {self.K[self.i]}")

    def match(self, i):
        return -1

    def program(self):
        self.items(self.line, "s", _EOF)

    def skip(self):
        while self.K[self.i] in ("nl", ";"):
            self.i += 1

    def line(self):
        if self.K[self.i] in ("nl", ";"):
            self.i += 1
            return
        self.statement()
        if self.K[self.i] not in ("nl", ";", "eof", "end", "}", ")", "else", "elsif", "when", "in", "rescue", "ensure", "then"):
            self.fail(f"expected a line break, found {self.K[self.i]}")
        if self.K[self.i] in ("nl", ";"):
            self.i += 1

    def body(self, ends=_END):
        self.items(self.line, "s", ends)

    def statement(self):
        self.phrase()
        while self.K[self.i] in _MODIFIERS:
            self.i += 1
            self.phrase()

    def phrase(self):
        self.negated()
        while self.K[self.i] in ("and", "or"):
            self.i += 1
            while self.at("nl"):
                self.i += 1
            self.negated()
        if self.at("=>") or self.at("in") and not self.no_in:
            self.i += 1
            self.pattern()

    no_in = False

    def negated(self):
        if self.eat("not"):
            return self.negated()
        self.expression(True)

    def expression(self, multiple: bool = False):
        """Assignments, conditionals and operators; ``multiple`` allows ``a, b = b, a``."""
        K = self.K
        star = self.at("*") and multiple
        if star:
            self.i += 1
        self.ternary()
        if multiple and self.at(",") and (self.target or star):
            i = self.i
            if self.attempt(self.more_targets):
                pass
            else:
                self.i = i
                return
        if K[self.i] in _ASSIGN:
            if not self.target and not star:
                self.fail("the left side cannot be assigned to")
            self.i += 1
            self.splat()
            if multiple:
                while self.eat(","):
                    self.splat()
            if self.at("rescue") and not multiple:
                self.i += 1
                self.expression()
            self.target = False

    def splat(self):
        self.eat("*")
        self.expression()

    def more_targets(self):
        while self.eat(","):
            if self.at("="):
                break
            self.eat("*")
            if self.eat("("):
                self.nested_targets()
                continue
            self.unary()
            if not self.target:
                self.fail("the left side cannot be assigned to")
        if not self.at("="):
            self.fail("expected =")

    def nested_targets(self):
        while not self.at(")"):
            self.eat("*")
            if self.eat("("):
                self.nested_targets()
            else:
                self.name()
            if not self.eat(","):
                break
        self.need(")")

    def ternary(self):
        K = self.K
        self.binary()
        if self.at("?"):
            self.i += 1
            self.skip()
            if self.at("label"):  # x ? a : b with a name tight against the colon
                self.i += 1
            else:
                self.expression()
                self.skip()
                if not self.eat(":"):
                    if self.at("sym"):
                        self.i += 1
                        self.target = False
                        return
                    self.fail(f"expected :, found {K[self.i]}")
            self.skip()
            self.expression()
            self.target = False

    def binary(self, least=0):
        K = self.K
        if K[self.i] in ("..", "..."):
            self.i += 1
            self.binary(3)
            return
        self.unary()
        while True:
            k = K[self.i]
            if k.startswith("arg"):
                k = k[3:]
            p = self.BIN.get(k)
            if p is None or p[0] < least or k == "|" and self.no_bar:
                return
            self.i += 1
            if p[0] == 2 and K[self.i] in (")", "]", "nl", "then", ",", "eof"):
                self.target = False
                continue
            while self.at("nl"):
                self.i += 1
            self.binary(p[0] if p[1] else p[0] + 1)
            self.target = False

    no_bar = False

    def unary(self):
        K = self.K
        k = K[self.i]
        if k.startswith("arg"):
            k = k[3:]
        if k in ("!", "-", "+", "~", "&", "*", "**") and k not in ("&", "*", "**"):
            self.i += 1
            self.unary()
            self.target = False
        elif k == "defined?":
            self.i += 1
            self.unary()
            self.target = False
        else:
            self.primary()
            self.postfix()

    def postfix(self):
        K = self.K
        while True:
            k = K[self.i]
            if k == "." or k == "&.":
                self.i += 1
                if self.at("("):
                    self.paren_args()
                    self.target = False
                    continue
                n = K[self.i]
                if n not in ("id", "const", "label") and n not in _WORDS and n not in _BIN and n not in ("!", "[", "`"):
                    self.fail(f"expected a method name, found {n}")
                if n == "label":
                    # ``a ? b.c: d`` and the like: the colon belongs to the conditional
                    self.i += 1
                    return
                self.i += 1
                self.target = True
                self.call_rest()
            elif k == "::":
                self.i += 1
                if K[self.i] not in ("id", "const"):
                    self.fail(f"expected a name, found {K[self.i]}")
                const = self.at("const")
                self.i += 1
                self.target = True
                if not const or self.at("("):
                    self.call_rest()
            elif k == "[" and not self._spaced_bracket():
                self.i += 1
                self.arguments("]")
                self.need("]")
                self.target = True
            elif k == "{" and self.callable and not self.no_brace:
                self.brace_block()
                self.target = False
            elif k == "do" and not self.no_do and self.callable:
                self.do_block()
                self.target = False
            else:
                return

    no_brace = False
    callable = False

    def _spaced_bracket(self):
        return False

    def call_rest(self):
        """Arguments and block behind a method's name."""
        K = self.K
        self.callable = True
        if self.K[self.i] == "(":
            self.paren_args()
            self.target = False
        elif self.command_ahead():
            self.command_args()
            self.target = False
        if self.at("{") and not self.no_brace:
            self.brace_block()
            self.target = False
        elif self.at("do") and not self.no_do:
            self.do_block()
            self.target = False
        self.callable = False

    def command_ahead(self) -> bool:
        K, i = self.K, self.i
        k = K[i]
        if self.NL[i]:
            return False
        if k in _ARG:
            return not (k == "label" and self.in_ternary)
        return k.startswith("arg") and k != "arg{"

    in_ternary = False

    def command_args(self):
        while True:
            self.argument()
            if not self.eat(","):
                return
            self.skip()

    def paren_args(self):
        was = self.no_do, self.no_bar, self.no_brace, self.no_in
        self.no_do = self.no_bar = self.no_brace = self.no_in = False
        self.need("(")
        self.arguments(")")
        self.need(")")
        self.no_do, self.no_bar, self.no_brace, self.no_in = was

    def arguments(self, end):
        was = self.no_do, self.no_bar, self.no_brace
        self.no_do = self.no_bar = self.no_brace = False
        self.skip()
        while not self.at(end):
            self.argument()
            self.skip()
            if not self.eat(","):
                break
            self.skip()
        self.no_do, self.no_bar, self.no_brace = was

    def argument(self):
        K = self.K
        if self.eat("*") or self.eat("**") or self.eat("&"):
            if K[self.i] in (")", ",", "]"):
                return
            return self.expression()
        if self.at("..."):
            self.i += 1
            return
        if self.eat("label"):
            if K[self.i] in (",", ")", "]", "}", "nl"):
                return
            return self.negated_value()
        self.negated_value()
        if self.eat("=>"):
            self.skip()
            self.expression()

    def negated_value(self):
        if self.eat("not"):
            return self.negated_value()
        self.expression()

    def brace_block(self):
        self.need("{")
        was = self.no_do, self.no_bar, self.no_brace, self.no_in
        self.no_do = self.no_bar = self.no_brace = self.no_in = False
        self.block_params()
        self.body(frozenset(["}"]))
        self.no_do, self.no_bar, self.no_brace, self.no_in = was
        self.need("}")

    def do_block(self):
        self.need("do")
        was = self.no_do, self.no_bar, self.no_brace, self.no_in
        self.no_do = self.no_bar = self.no_brace = self.no_in = False
        self.block_params()
        self.rescue_body()
        self.no_do, self.no_bar, self.no_brace, self.no_in = was
        self.need("end")

    def block_params(self):
        if self.at("nl") and self.K[self.i + 1] == "|":
            self.i += 1
        if self.eat("||"):
            return
        if self.eat("|"):
            was, self.no_bar = self.no_bar, True
            self.parameters(frozenset(["|"]))
            if self.eat(";"):
                while not self.at("|"):
                    self.name()
                    self.eat(",")
            self.no_bar = was
            self.need("|")

    def parameters(self, ends):
        K = self.K
        while K[self.i] not in ends and not self.at(";"):
            self.skip()
            if self.eat("*") or self.eat("**"):
                if K[self.i] in ("id",):
                    self.i += 1
                else:
                    self.eat("nil")
            elif self.eat("&"):
                if self.at("id"):
                    self.i += 1
            elif self.eat("..."):
                pass
            elif self.eat("("):
                self.parameters(frozenset([")"]))
                self.need(")")
            elif self.eat("label"):
                if K[self.i] not in ends and K[self.i] not in (",", "nl", ";"):
                    self.ternary()
            else:
                self.name()
                if self.eat("="):
                    self.ternary()
            self.skip() if ")" in ends else None
            if not self.eat(","):
                break
            self.skip()

    def rescue_body(self):
        ends = frozenset(["end", "rescue", "else", "ensure"])
        self.body(ends)
        while self.at("rescue"):
            self.i += 1
            while self.K[self.i] not in ("nl", "then", "=>", ";", "eof"):
                self.eat("*")
                self.ternary()
                if not self.eat(","):
                    break
            if self.eat("=>"):
                self.unary()
            self.eat("then")
            self.body(ends)
        if self.eat("else"):
            self.body(ends)
        if self.eat("ensure"):
            self.body(_END)

    def condition(self):
        was, self.no_do = self.no_do, True
        self.statement_value()
        self.no_do = was

    def statement_value(self):
        self.phrase()

    def primary(self):
        K = self.K
        k = K[self.i]
        self.target = self.callable = False
        if k.startswith("arg"):
            k = k[3:]
        if k == "id":
            self.i += 1
            self.target = True
            self.call_rest()
        elif k == "const":
            self.i += 1
            self.target = True
            if self.K[self.i] == "(":
                self.call_rest()
            elif K[self.i] == "str" and not self.NL[self.i]:
                self.command_args()
                self.target = False
            elif self.at("do") and not self.no_do:
                pass
        elif k == "var":
            self.i += 1
            self.target = True
        elif k == "str":
            self.i += 1
            while self.at("str"):
                self.i += 1
        elif k in ("num", "sym", "regex", "nil", "true", "false", "self", "redo", "retry", "__method__", "__FILE__", "__LINE__"):
            self.i += 1
        elif k == "(":
            self.i += 1
            was = self.no_do, self.no_bar, self.no_brace, self.no_in
            self.no_do = self.no_bar = self.no_brace = self.no_in = False
            self.items(self.line, "s", frozenset([")"]))
            self.no_do, self.no_bar, self.no_brace, self.no_in = was
            self.need(")")
            self.target = False
        elif k == "[":
            self.i += 1
            self.arguments("]")
            self.need("]")
            self.target = False
        elif k == "{":
            self.hash()
        elif k == "->":
            self.i += 1
            if self.eat("("):
                self.parameters(frozenset([")", ";"]))
                self.need(")")
            elif self.at("id") or self.at("*") or self.at("&"):
                self.parameters(frozenset(["{", "do"]))
            if self.at("{"):
                self.brace_block()
            elif self.at("do"):
                self.do_block()
            else:
                self.fail(f"expected a block, found {K[self.i]}")
            self.target = False
        elif k == "::":
            self.i += 1
            self.need("const")
            self.target = True
        elif k == "..":
            self.i += 1
            self.binary(3)
        else:
            f = _KEYWORDS.get(k)
            if f is None:
                self.fail(f"expected an expression, found {k}")
            getattr(self, f)()
            self.target = False

    def hash(self):
        self.need("{")
        was = self.no_do, self.no_bar, self.no_brace
        self.no_do = self.no_bar = self.no_brace = False
        self.skip()
        while not self.at("}"):
            if self.eat("**"):
                self.expression()
            elif self.eat("label"):
                self.skip()
                if not self.at(",") and not self.at("}"):
                    self.expression()
            else:
                self.expression()
                self.skip()
                if not self.eat("=>"):
                    self.fail(f"expected =>, found {self.K[self.i]}")
                self.skip()
                self.expression()
            self.skip()
            if not self.eat(","):
                break
            self.skip()
        self.no_do, self.no_bar, self.no_brace = was
        self.need("}")
        self.target = False

    # -- keywords
    def scope(self, rule, ends=None):
        was = self.no_do, self.no_bar, self.no_brace, self.no_in
        self.no_do = self.no_bar = self.no_brace = self.no_in = False
        if ends is None:
            rule()
        else:
            rule(ends)
        self.no_do, self.no_bar, self.no_brace, self.no_in = was

    def k_if(self):
        self.i += 1
        self.condition()
        self.then()
        self.scope(self.body, frozenset(["end", "else", "elsif"]))
        while self.eat("elsif"):
            self.condition()
            self.then()
            self.scope(self.body, frozenset(["end", "else", "elsif"]))
        if self.eat("else"):
            self.scope(self.body)
        self.need("end")

    def then(self):
        if self.K[self.i] in ("nl", ";"):
            self.i += 1
            self.eat("then")
        elif not self.eat("then"):
            self.fail(f"expected then or a line break, found {self.K[self.i]}")

    def k_while(self):
        self.i += 1
        self.condition()
        if not self.eat("do") and self.K[self.i] not in ("nl", ";"):
            self.fail(f"expected do or a line break, found {self.K[self.i]}")
        self.scope(self.body)
        self.need("end")

    def k_for(self):
        self.i += 1
        while True:
            self.eat("*")
            self.name()
            if not self.eat(","):
                break
        self.need("in")
        self.condition()
        self.eat("do")
        self.scope(self.body)
        self.need("end")

    def k_case(self):
        self.i += 1
        if self.K[self.i] not in ("nl", ";"):
            was, self.no_in = self.no_in, True
            self.condition()
            self.no_in = was
        self.skip()
        if not (self.at("when") or self.at("in")):
            self.fail(f"expected when, found {self.K[self.i]}")
        ends = frozenset(["end", "else", "when", "in"])
        while self.at("when") or self.at("in"):
            if self.eat("when"):
                while True:
                    self.eat("*")
                    self.ternary()
                    if not self.eat(","):
                        break
                    self.skip()
            else:
                self.i += 1
                self.pattern()
                if self.K[self.i] in ("if", "unless"):
                    self.i += 1
                    self.phrase()
            self.then()
            self.scope(self.body, ends)
        if self.eat("else"):
            self.scope(self.body)
        self.need("end")

    def pattern(self):
        """A pattern of ``case ... in``."""
        while True:
            self.pattern_one()
            if not self.eat(","):
                return

    def pattern_one(self):
        K = self.K
        if self.eat("*") or self.eat("**"):
            if self.at("id") or self.at("nil"):
                self.i += 1
            return
        if self.eat("label"):
            if K[self.i] not in (",", "nl", "then", "}", ")", "if", "unless"):
                self.pattern_one()
            return
        self.pattern_primary()
        while self.eat("|"):
            self.pattern_primary()
        if self.eat("=>"):
            self.name()

    def pattern_primary(self):
        K = self.K
        k = K[self.i]
        if k in ("[", "(", "{") or k in ("arg[",):
            end = {"[": "]", "(": ")", "{": "}"}[k[-1]]
            self.i += 1
            self.skip()
            while not self.at(end):
                self.pattern_one()
                self.skip()
                if not self.eat(","):
                    break
                self.skip()
            self.need(end)
        elif self.eat("^"):
            self.primary()
        elif k == "const":
            self.i += 1
            while self.eat("::"):
                self.need("const")
            if self.K[self.i] in ("(", "["):
                self.pattern_primary()
            elif self.K[self.i] in ("..", "..."):
                self.i += 1
                self.binary(9)
        else:
            was, self.no_bar = self.no_bar, True
            self.binary(2)
            self.no_bar = was

    def k_begin(self):
        self.i += 1
        self.scope(self.rescue_body)
        self.need("end")

    def k_def(self):
        K = self.K
        self.i += 1
        k = K[self.i]
        if k == "label":
            self.fail("a label is no method name")
        if K[self.i + 1] == "." and k in ("self", "id", "const"):
            self.i += 2
            k = K[self.i]
        if not (k in ("id", "const") or k in _WORDS or k in _BIN or k in ("!", "[", "~", "arg[", "arg-", "arg+", "arg!", "arg*", "`") or k.startswith("arg")):
            self.fail(f"expected a method name, found {k}")
        self.i += 1
        if k.endswith("["):
            self.need("]")
            self.eat("=")
        elif self.at("=") and self.t.starts[self.i] == self.t.starts[self.i - 1] + 1 and K[self.i + 1] == "(":
            self.i += 1
        elif k in ("id", "const") and self.at("=") and K[self.i + 1] == "(":
            self.i += 1
        if self.eat("("):
            self.parameters(frozenset([")"]))
            self.skip()
            self.need(")")
        elif K[self.i] not in ("nl", ";", "="):
            self.parameters(frozenset(["nl", ";"]))
        if self.eat("="):
            self.skip()
            return self.scope(self.statement)
        if K[self.i] not in ("nl", ";") and K[self.i] != "end":
            pass
        self.scope(self.rescue_body)
        self.need("end")

    def k_class(self):
        self.i += 1
        if self.eat("<<"):
            self.expression()
        else:
            self.eat("::")
            self.need("const")
            while self.eat("::"):
                self.need("const")
            if self.eat("<"):
                self.expression()
        if self.K[self.i] not in ("nl", ";", "end"):
            self.fail(f"expected a line break, found {self.K[self.i]}")
        self.scope(self.rescue_body)
        self.need("end")

    def k_module(self):
        self.i += 1
        self.eat("::")
        self.need("const")
        while self.eat("::"):
            self.need("const")
        self.scope(self.body)
        self.need("end")

    def k_jump(self):
        self.i += 1
        k = self.K[self.i]
        if k not in ("nl", ";", "eof", "end", "}", ")", "then", ":") and k not in _MODIFIERS and k not in ("and", "or", "&&", "||") and not k == "when" and k not in ("else", "elsif"):
            self.splat()
            while self.eat(","):
                self.splat()

    def k_yield(self):
        self.i += 1
        self.callable = True
        if self.K[self.i] == "(":
            self.paren_args()
        elif self.command_ahead() or self.at("[") and False:
            self.command_args()
        if self.at("{") and not self.no_brace:
            self.brace_block()
        elif self.at("do") and not self.no_do:
            self.do_block()

    def k_alias(self):
        self.i += 2
        self.i += 1

    def k_undef(self):
        self.i += 2

    def k_block(self):
        self.i += 1
        self.brace_block()

    def k_not(self):
        self.i += 1
        self.expression()


_KEYWORDS = {
    "if": "k_if", "unless": "k_if", "while": "k_while", "until": "k_while", "for": "k_for", "case": "k_case", "begin": "k_begin",
    "def": "k_def", "class": "k_class", "module": "k_module", "return": "k_jump", "break": "k_jump", "next": "k_jump",
    "yield": "k_yield", "super": "k_yield", "alias": "k_alias", "undef": "k_undef", "BEGIN": "k_block", "END": "k_block", "not": "k_not",
}


def parse_rb(text: str, memo: dict):
    return Rb(lex_rb(text), memo).run()
