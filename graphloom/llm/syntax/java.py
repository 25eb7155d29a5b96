"""java."""

from __future__ import annotations

from graphloom.llm.syntax.base import Parser
from graphloom.llm.syntax.clex import lex_java

_BIN = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7,
    "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="])
_PRIM = frozenset("boolean byte char short int long float double".split())
_MODS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
_SOFT = frozenset("var record sealed permits yield when non module".split())
_BLOCK = frozenset(["}"])
_CASE = frozenset(["}", "case", "default"])
_EOF = frozenset(["eof"])


class Java(Parser):
    ID = frozenset(["id"]) | _SOFT
    BIN = {k: (p, False) for k, p in _BIN.items()}
    START = frozenset("public private protected static class interface enum import if for while try return throw switch".split())

    def __init__(self, toks, memo):
        super().__init__(toks, memo)
        self.target = False

    def program(self):
        i = self.i
        self.annotations()
        if self.eat("package"):
            try:
                self.qualified()
                self.need(";")
            except Exception as e:
                self.errors.append((e.at, e.cause))
                self.recover(self.i, _EOF)
        else:
            self.i = i
        self.items(self.top, "t", _EOF)

    def top(self):
        if self.eat(";"):
            return
        if self.eat("import"):
            self.eat("static") or (self.at("module") and self.K[self.i + 1] in self.ID and self.eat("module"))
            self.name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.name()
            return self.need(";")
        self.modifiers()
        if not self.type_declaration():
            self.fail(f"expected a class, interface, enum or record, found {self.K[self.i]}")

    def qualified(self):
        self.name()
        while self.eat("."):
            self.name()

    def annotations(self):
        while self.at("@") and self.K[self.i + 1] != "interface":
            self.annotation()

    def annotation(self):
        self.need("@")
        self.qualified()
        if self.eat("("):
            while not self.at(")"):
                if self.K[self.i] in self.ID and self.K[self.i + 1] == "=":
                    self.i += 2
                self.element_value()
                if not self.eat(","):
                    break
            self.need(")")

    def element_value(self):
        if self.at("@"):
            self.annotation()
        elif self.eat("{"):
            while not self.at("}"):
                self.element_value()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.ternary()

    def modifiers(self):
        K = self.K
        while True:
            k = K[self.i]
            if k == "@" and K[self.i + 1] != "interface":
                self.annotation()
            elif k == "non" and K[self.i + 1] == "-":
                self.i += 3
            elif k in _MODS and not (k == "sealed" and K[self.i + 1] in ("=", ".", "(")) and not (k == "default" and K[self.i + 1] in (":", "->")):
                if k == "synchronized" and K[self.i + 1] == "(":
                    return
                self.i += 1
            else:
                return

    def type_declaration(self) -> bool:
        K = self.K
        k = K[self.i]
        if k == "class":
            self.i += 1
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type()
            self.type_list("implements")
            self.type_list("permits")
            self.class_body()
        elif k == "interface":
            self.i += 1
            self.name()
            self.type_params()
            self.type_list("extends")
            self.type_list("permits")
            self.class_body()
        elif k == "@" and K[self.i + 1] == "interface":
            self.i += 2
            self.name()
            self.class_body()
        elif k == "enum":
            self.i += 1
            self.name()
            self.type_list("implements")
            self.enum_body()
        elif k == "record" and K[self.i + 1] in self.ID and K[self.i + 2] in ("(", "<"):
            self.i += 2
            self.type_params()
            self.params()
            self.type_list("implements")
            self.class_body()
        else:
            return False
        return True

    def type_list(self, word):
        if self.eat(word):
            self.type()
            while self.eat(","):
                self.type()

    def type_params(self):
        if not self.at("<"):
            return
        self.need("<")
        while True:
            self.annotations()
            self.name()
            if self.eat("extends"):
                self.type()
                while self.eat("&"):
                    self.type()
            if not self.eat(","):
                break
        self.need(">")

    def enum_body(self):
        self.need("{")
        while self.K[self.i] in self.ID or self.at("@"):
            self.annotations()
            self.name()
            if self.at("("):
                self.args()
            if self.at("{"):
                self.class_body()
            if not self.eat(","):
                break
        if self.eat(";"):
            self.items(self.member, "m", _BLOCK)
        self.need("}")

    def class_body(self):
        self.need("{")
        self.items(self.member, "m", _BLOCK)
        self.need("}")

    def member(self):
        K = self.K
        if self.eat(";"):
            return
        if self.at("{"):
            return self.block()
        if self.at("static") and K[self.i + 1] == "{":
            self.i += 1
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        self.type_params()
        if K[self.i] in self.ID and K[self.i + 1] == "(":
            self.i += 1
            self.params()
            self.throws()
            return self.block()
        if K[self.i] in self.ID and K[self.i + 1] == "{":
            self.i += 1
            return self.block()
        if not self.eat("void"):
            self.type()
        self.name()
        if self.at("("):
            self.params()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.element_value()
            if self.at("{"):
                return self.block()
            return self.need(";")
        self.declarators()
        self.need(";")

    def throws(self):
        self.type_list("throws")

    def dims(self):
        while True:
            self.annotations()
            if self.at("[") and self.K[self.i + 1] == "]":
                self.i += 2
            else:
                return

    def params(self):
        self.need("(")
        while not self.at(")"):
            self.modifiers()
            self.type()
            self.annotations()
            self.eat("...")
            if self.eat("this"):
                pass
            else:
                self.name()
                if self.eat("."):
                    self.need("this")
            self.dims()
            if not self.eat(","):
                break
        self.need(")")

    def type(self):
        self.annotations()
        k = self.K[self.i]
        if k in _PRIM:
            self.i += 1
        elif k in self.ID:
            self.i += 1
            self.type_args()
            while self.at(".") and (self.K[self.i + 1] in self.ID or self.K[self.i + 1] == "@"):
                self.i += 1
                self.annotations()
                self.name()
                self.type_args()
        else:
            self.fail(f"expected a type, found {k}")
        self.dims()

    def type_args(self):
        if not self.eat("<"):
            return
        if self.eat(">"):
            return
        while True:
            self.annotations()
            if self.eat("?"):
                if self.eat("extends") or self.eat("super"):
                    self.type()
            else:
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def declarators(self):
        """Behind the first name."""
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self):
        if self.at("{"):
            self.array()
        else:
            self.expression()

    def array(self):
        self.need("{")
        while not self.at("}"):
            self.initializer()
            if not self.eat(","):
                break
        self.need("}")

    # -- statements
    def block(self):
        self.need("{")
        self.items(self.statement, "s", _BLOCK)
        self.need("}")

    def paren(self):
        self.need("(")
        self.expression()
        self.need(")")

    def local(self):
        """A local variable declaration, up to the semicolon."""
        self.modifiers()
        self.type()
        self.name()
        if self.K[self.i] not in ("=", ";", ",", ":", "[", ")"):
            self.fail(f"expected = or ;, found {self.K[self.i]}")
        self.dims()

    def statement(self):
        K = self.K
        k = K[self.i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.eat("else"):
                self.statement()
        elif k == "while":
            self.i += 1
            self.paren()
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.paren()
            self.need(";")
        elif k == "for":
            self.for_()
        elif k == "try":
            self.try_()
        elif k == "switch":
            self.switch()
            if self.at("."):
                self.fail("a switch is no value here")
        elif k == "return":
            self.i += 1
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif k == "throw" or k == "yield" and K[self.i + 1] not in ("=", ".", "(", "[", "++", "--", "+=", "-="):
            self.i += 1
            self.expression()
            self.need(";")
        elif k in ("break", "continue"):
            self.i += 1
            if K[self.i] in self.ID:
                self.i += 1
            self.need(";")
        elif k == "synchronized" and K[self.i + 1] == "(":
            self.i += 1
            self.paren()
            self.block()
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
        elif k in self.ID and K[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif k in ("class", "interface", "enum", "abstract", "static", "strictfp") or k == "record" and K[self.i + 1] in self.ID and K[self.i + 2] in ("(", "<"):
            self.modifiers()
            if not self.type_declaration():
                self.fail(f"expected a class, found {K[self.i]}")
        else:
            i = self.i
            if k == "final" or k == "@":
                self.modifiers()
                if self.type_declaration():
                    return
                self.i = i
                self.local()
                self.declarators()
            elif (k in self.ID or k in _PRIM) and K[i + 1] not in ("(", "=", ".") and self.attempt(self.local) or k in self.ID and K[i + 1] == "." and self.attempt(self.local):
                self.declarators()
            else:
                self.expression()
                if not self.effect:
                    self.i = max(self.i, i)
                    self.fail("an expression that is no statement")
            self.need(";")

    effect = True

    def for_(self):
        self.need("for")
        self.need("(")
        if self.attempt(self.local):
            if self.eat(":"):
                self.expression()
                self.need(")")
                return self.statement()
            self.declarators()
        elif not self.at(";"):
            self.expression()
            while self.eat(","):
                self.expression()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
            while self.eat(","):
                self.expression()
        self.need(")")
        self.statement()

    def try_(self):
        self.need("try")
        resources = self.eat("(")
        if resources:
            while not self.at(")"):
                if self.attempt(self.local):
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if not self.eat(";"):
                    break
            self.need(")")
        self.block()
        any_ = resources
        while self.eat("catch"):
            any_ = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            any_ = True
            self.block()
        if not any_:
            self.fail("expected catch or finally")

    def switch(self):
        self.need("switch")
        self.paren()
        self.need("{")
        while not self.at("}"):
            if self.eat("case"):
                while True:
                    self.label()
                    if not self.eat(","):
                        break
                if self.eat("when"):
                    self.binary()
            else:
                self.need("default")
            if self.eat("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                self.items(self.statement, "s", _CASE)
        self.need("}")

    def label(self):
        if self.eat("default"):
            return
        i = self.i
        if self.attempt(self.pattern) and self.K[self.i] in ("->", ":", ",", "when"):
            return
        self.i = i
        self.ternary()

    def pattern(self):
        self.modifiers()
        self.type()
        if self.eat("("):
            while not self.at(")"):
                self.pattern()
                if not self.eat(","):
                    break
            self.need(")")
            if self.K[self.i] in self.ID and not self.at("when"):
                self.i += 1
        elif not self.eat("_"):
            self.name()

    # -- expressions
    def expression(self):
        self.effect = False
        if self.lambda_():
            self.target = self.effect = False
            return
        self.ternary()
        k = self.K[self.i]
        if k in _ASSIGN:
            if not self.target:
                self.fail("the left side cannot be assigned to")
            self.i += 1
            self.expression()
            self.target, self.effect = False, True

    def lambda_(self) -> bool:
        K, i = self.K, self.i
        k = K[i]
        if (k in self.ID or k == "_") and K[i + 1] == "->":
            self.i += 2
        elif k == "(":
            m = self.match(i)
            if m < 0 or K[m + 1] != "->":
                return False
            if not self.attempt(self.params):
                self.need("(")
                while not self.at(")"):
                    if not self.eat("_"):
                        self.name()
                    if not self.eat(","):
                        break
                self.need(")")
            self.need("->")
        else:
            return False
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return True

    def ternary(self):
        if self.lambda_():
            return
        self.binary()
        if self.eat("?"):
            self.expression()
            self.need(":")
            if not self.lambda_():
                self.ternary()
            self.target = self.effect = False

    def binary(self, least=0):
        K = self.K
        self.unary()
        while True:
            k = K[self.i]
            p = self.BIN.get(k)
            if p is None:
                return
            p = p[0]
            i = self.i
            if k == ">" and K[i + 1] in (">", ">=") and self.t.starts[i + 1] == self.t.starts[i] + 1:
                j = i + 1
                while K[j] == ">" and K[j + 1] in (">", ">=") and self.t.starts[j + 1] == self.t.starts[j] + 1:
                    j += 1
                if K[j] == ">=":
                    self.i = j + 1
                    self.expression()
                    self.target, self.effect = False, True
                    return
                if 8 < least:
                    return
                self.i = j + 1
                self.binary(9)
            elif p < least:
                return
            elif k == "instanceof":
                self.i += 1
                self.modifiers()
                j = self.i
                if not (self.attempt(self.pattern) and self.K[self.i] not in ("(",)):
                    self.i = j
                    self.type()
            else:
                self.i += 1
                self.binary(p + 1)
            self.target = self.effect = False

    def unary(self):
        K = self.K
        k = K[self.i]
        if k in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            self.target = self.effect = False
        elif k in ("++", "--"):
            self.i += 1
            self.unary()
            if not self.target:
                self.fail("the operand cannot be assigned to")
            self.target, self.effect = False, True
        elif k == "(" and self.cast():
            self.target = self.effect = False
        else:
            self.postfix()
            while K[self.i] in ("++", "--"):
                if not self.target:
                    self.fail("the operand cannot be assigned to")
                self.i += 1
                self.target, self.effect = False, True

    def cast(self) -> bool:
        i = self.i
        if self.attempt(self.cast_type):
            prim = self.K[i + 1] in _PRIM
            k = self.K[self.i]
            if prim and self.K[i + 2] == ")" or k in self.ID or k in ("(", "!", "~", "str", "num", "chr", "this", "super", "new", "true", "false", "null", "switch") or k in _PRIM:
                if not self.lambda_():
                    self.unary()
                return True
        self.i = i
        return False

    def cast_type(self):
        self.need("(")
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")")

    def postfix(self):
        K = self.K
        self.primary()
        while True:
            k = K[self.i]
            if k == ".":
                self.i += 1
                if self.at("<"):
                    self.type_args()
                if self.at("new"):
                    self.new()
                elif self.eat("this") or self.eat("class") or self.eat("super"):
                    self.target = False
                    continue
                else:
                    self.name()
                    self.target = True
                    self.effect = False
                if self.at("("):
                    self.args()
                    self.target, self.effect = False, True
            elif k == "[":
                self.i += 1
                if self.eat("]"):
                    self.dims()
                    if self.eat("."):
                        self.need("class")
                        continue
                    if self.at("::"):
                        continue
                    self.fail("expected an index")
                self.expression()
                self.need("]")
                self.target, self.effect = True, False
            elif k == "::":
                self.i += 1
                self.type_args()
                if not self.eat("new"):
                    self.name()
                self.target = self.effect = False
            else:
                return

    def args(self):
        self.need("(")
        while not self.at(")"):
            self.expression()
            if not self.eat(","):
                break
        self.need(")")

    def generic_ref(self):
        """``List<String>::new`` and ``int[]::new``."""
        self.type()
        if not self.at("::") and not (self.at(".") and self.K[self.i + 1] == "class"):
            self.fail("expected ::")

    def primary(self):
        K = self.K
        k = K[self.i]
        self.target, self.effect = False, False
        if k in self.ID:
            if K[self.i + 1] == "<" and self.attempt(self.generic_ref):
                return
            self.i += 1
            if self.at("("):
                self.args()
                self.effect = True
            elif self.at("->"):
                self.i -= 1
                self.lambda_()
            else:
                self.target = True
        elif k in ("num", "str", "chr", "true", "false", "null"):
            self.i += 1
        elif k == "(":
            self.i += 1
            self.expression()
            self.need(")")
            self.effect = False
        elif k == "this" or k == "super":
            self.i += 1
            if self.at("("):
                self.args()
                self.effect = True
        elif k == "new":
            self.new()
        elif k == "switch":
            self.switch()
        elif k in _PRIM or k == "void":
            self.i += 1
            self.dims()
            if self.at("::"):
                return
            self.need(".")
            self.need("class")
        else:
            self.fail(f"expected an expression, found {k}")

    def new(self):
        self.need("new")
        self.annotations()
        k = self.K[self.i]
        if k in _PRIM:
            self.i += 1
        else:
            self.name()
            self.type_args()
            while self.eat("."):
                self.name()
                self.type_args()
        if self.at("["):
            sized = False
            while self.at("["):
                self.i += 1
                if not self.at("]"):
                    self.expression()
                    sized = True
                self.need("]")
            if self.at("{") and not sized:
                self.array()
            elif not sized:
                self.fail("an array without a size")
            self.effect = False
            return
        self.args()
        if self.at("{"):
            self.class_body()
        self.target, self.effect = False, True


def parse_java(text: str, memo: dict):
    return Java(lex_java(text), memo).run()
