"""go."""

from __future__ import annotations

from graphloom.llm.syntax.base import Parser
from graphloom.llm.syntax.clex import lex_go

_BIN = {
    "||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4,
    "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5,
}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="])
_BLOCK = frozenset(["}"])
_CASE = frozenset(["}", "case", "default"])
_EOF = frozenset(["eof"])
_TYPE_START = frozenset(["id", "*", "[", "(", "func", "map", "chan", "struct", "interface", "<-"])


class Go(Parser):
    BIN = {k: (p, False) for k, p in _BIN.items()}
    CONT = Parser.CONT | frozenset([";"])
    START = frozenset("func var const type import package if for switch return go defer select".split())

    def __init__(self, toks, memo):
        super().__init__(toks, memo)
        self.composite = True  # whether a brace behind a name is a literal

    def program(self):
        if self.at("eof"):
            return
        try:
            self.need("package")
            self.name()
            self.semi()
        except Exception as e:
            self.errors.append((e.at, e.cause))
            self.recover(self.i, _EOF)
        self.declared = False
        self.items(self.top, "t", _EOF)

    def semi(self):
        if not self.eat(";") and self.K[self.i] not in (")", "}", "eof"):
            self.fail(f"expected a line break or ;, found {self.K[self.i]}")

    def top(self):
        k = self.K[self.i]
        if k == "import":
            self.i += 1
            self.group(self.import_spec)
        elif k == "func":
            self.function()
        elif k in ("var", "const", "type"):
            self.declaration()
        else:
            self.fail(f"expected a declaration, found {k}")
        self.semi()

    def group(self, rule):
        if self.eat("("):
            while not self.at(")"):
                rule()
                self.semi()
            self.need(")")
        else:
            rule()

    def import_spec(self):
        if self.K[self.i] in ("id", "."):
            self.i += 1
        self.need("str")

    def declaration(self):
        k = self.K[self.i]
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[k])

    def names(self):
        self.name()
        while self.eat(","):
            self.name()

    def var_spec(self):
        self.names()
        if self.eat("="):
            return self.expressions()
        self.type()
        if self.eat("="):
            self.expressions()

    def const_spec(self):
        self.names()
        if self.K[self.i] in _TYPE_START:
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self):
        self.name()
        if self.at("[") and self.K[self.i + 1] == "id" and self.K[self.i + 2] != "]":
            if not (self.attempt(self.type_params) and not self.at("]")):
                pass
        self.eat("=")
        self.type()

    def type_params(self):
        self.need("[")
        while not self.at("]"):
            self.names()
            self.constraint()
            if not self.eat(","):
                break
        self.need("]")

    def constraint(self):
        while True:
            self.eat("~") or None
            self.type()
            if not self.eat("|"):
                return

    def function(self):
        self.need("func")
        if self.at("("):
            self.params()
        self.name()
        if self.at("["):
            self.type_params()
        self.signature()
        if self.at("{"):
            self.block()

    def signature(self):
        self.params()
        if self.at("("):
            self.params()
        elif self.K[self.i] in _TYPE_START:
            self.type()

    def params(self):
        self.need("(")
        while not self.at(")"):
            self.param()
            if not self.eat(","):
                break
        self.need(")")

    def param(self):
        if self.eat("..."):
            return self.type()
        if self.at("id") and self.K[self.i + 1] not in (",", ")", "."):
            if self.K[self.i + 1] == "[" and self.attempt(self.type) and self.K[self.i] in (",", ")"):
                return
            self.name() if self.at("id") else None
            self.eat("...")
            return self.type()
        self.type()

    def type(self):
        k = self.K[self.i]
        if k == "id":
            self.i += 1
            if self.eat("."):
                self.name()
            if self.at("[") and self.K[self.i + 1] != "]":
                self.attempt(self.type_args)
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.eat("..."):
                if not self.at("]"):
                    self.inner(self.binary)
            self.need("]")
            self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.i += 1
            self.need("{")
            while not self.at("}"):
                self.field()
                self.semi()
            self.need("}")
        elif k == "interface":
            self.i += 1
            self.need("{")
            while not self.at("}"):
                if self.at("id") and self.K[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            self.need("}")
        else:
            self.fail(f"expected a type, found {k}")

    def type_args(self):
        self.need("[")
        self.type()
        while self.eat(","):
            if self.at("]"):
                break
            self.type()
        self.need("]")

    def field(self):
        K = self.K
        if self.at("*") or self.at("id") and K[self.i + 1] in (";", "}", ".", "str"):
            self.type()
        else:
            self.names()
            self.type()
        self.eat("str")

    # -- statements
    def block(self):
        self.need("{")
        was, self.composite = self.composite, True
        self.items(self.statement, "s", _BLOCK)
        self.composite = was
        self.need("}")

    def statement(self):
        K = self.K
        k = K[self.i]
        if k == ";":
            self.i += 1
            return
        if k in ("var", "const", "type"):
            self.declaration()
        elif k == "return":
            self.i += 1
            if K[self.i] not in (";", "}"):
                self.expressions()
        elif k in ("if",):
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.i += 1
            self.cases(True)
        elif k in ("go", "defer"):
            self.i += 1
            self.binary()
        elif k in ("break", "continue", "goto"):
            self.i += 1
            self.eat("id")
        elif k == "fallthrough":
            self.i += 1
        elif k == "{":
            self.block()
        elif k == "id" and K[self.i + 1] == ":":
            self.i += 2
            if not self.at("}"):
                return self.statement()
            return
        else:
            self.simple()
        self.semi()

    def expressions(self):
        self.binary()
        while self.eat(","):
            self.binary()

    def simple(self, ranged: bool = False) -> bool:
        """An expression statement, assignment, send, step or, in a for clause, a range; true for a range."""
        if ranged and self.eat("range"):
            self.binary()
            return True
        self.expressions()
        k = self.K[self.i]
        if k == ":=" or k in _ASSIGN:
            self.i += 1
            if ranged and self.eat("range"):
                self.binary()
                return True
            self.expressions()
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.binary()
        return False

    def header(self, rule):
        was, self.composite = self.composite, False
        rule()
        self.composite = was

    def inner(self, rule):
        was, self.composite = self.composite, True
        rule()
        self.composite = was

    def if_(self):
        self.need("if")
        self.header(self.if_header)
        self.block()
        if self.eat("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def if_header(self):
        if not self.at(";"):
            self.simple()
        if self.eat(";"):
            self.simple()

    def for_(self):
        self.need("for")
        self.header(self.for_header)
        self.block()

    def for_header(self):
        if self.at("{"):
            return
        if not self.at(";") and self.simple(True):
            return
        if self.at("{"):
            return
        self.need(";")
        if not self.at(";"):
            self.simple()
        self.need(";")
        if not self.at("{"):
            self.simple()

    def switch(self):
        self.need("switch")
        self.header(self.switch_header)
        self.cases(False)

    def switch_header(self):
        if self.at("{"):
            return
        if not self.at(";"):
            self.simple()
        if self.eat(";") and not self.at("{"):
            self.simple()

    def cases(self, select: bool):
        self.need("{")
        while not self.at("}"):
            if self.eat("case"):
                if select:
                    self.inner(self.simple)
                else:
                    self.inner(self.case_list)
            else:
                self.need("default")
            self.need(":")
            was, self.composite = self.composite, True
            self.items(self.statement, "s", _CASE)
            self.composite = was
        self.need("}")

    def case_list(self):
        while True:
            if not (self.attempt(self.binary) and self.K[self.i] in (",", ":")):
                self.type()
            if not self.eat(","):
                return

    # -- expressions
    def unary(self):
        k = self.K[self.i]
        if k in ("+", "-", "!", "^", "*", "&", "<-"):
            if k == "<-" and self.K[self.i + 1] == "chan":
                return self.primary()
            self.i += 1
            return self.unary()
        self.primary()

    def primary(self):
        K = self.K
        k = K[self.i]
        literal = False
        if k == "id":
            self.i += 1
            literal = True
        elif k in ("num", "str", "chr"):
            self.i += 1
        elif k == "(":
            self.i += 1
            self.inner(self.expr_or_type)
            self.need(")")
        elif k == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
        elif k in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type()
            if self.at("{"):
                self.literal()
        else:
            self.fail(f"expected an expression, found {k}")
        while True:
            k = K[self.i]
            if k == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif k == "[":
                self.i += 1
                self.inner(self.index)
                self.need("]")
            elif k == "(":
                self.i += 1
                self.inner(self.args)
                self.need(")")
                literal = False
            elif k == "{" and literal and self.composite:
                self.literal()
                literal = False
            else:
                return

    def expr_or_type(self):
        i = self.i
        if not (self.attempt(self.binary) and self.at(")")):
            self.i = i
            self.type()

    def index(self):
        if not self.at(":"):
            self.type_or_expr()
            while self.eat(","):
                if self.at("]"):
                    return
                self.type_or_expr()
        while self.eat(":"):
            if self.K[self.i] not in (":", "]"):
                self.binary()

    def type_or_expr(self):
        if self.K[self.i] in ("[", "map", "chan", "struct", "interface", "func", "*"):
            i = self.i
            if self.attempt(self.binary) and self.K[self.i] in (",", "]", ":", ")", "..."):
                return
            self.i = i
            return self.type()
        self.binary()

    def args(self):
        while not self.at(")"):
            self.type_or_expr()
            self.eat("...")
            if not self.eat(","):
                return

    def literal(self):
        self.need("{")
        self.inner(self.elements)
        self.need("}")

    def elements(self):
        while not self.at("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                return

    def element(self):
        if self.at("{"):
            self.literal()
        else:
            self.binary()


def parse_go(text: str, memo: dict):
    return Go(lex_go(text), memo).run()
