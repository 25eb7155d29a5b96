"""rust."""

from __future__ import annotations

from graphloom.llm.syntax.base import CLOSE, OPEN, Parser
from graphloom.llm.syntax.clex import lex_rust

_BIN = {
    "..": 1, "..=": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7,
    "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="])
_SOFT = frozenset(["union", "macro_rules", "default", "auto", "raw"])
_BLOCK = frozenset(["}"])
_EOF = frozenset(["eof"])
_ITEM = frozenset("use fn struct enum impl trait mod extern pub static type macro_rules const unsafe async union auto default".split())
_BLOCKLIKE = frozenset(["{", "if", "match", "loop", "while", "for", "unsafe"])
_NO_OPERAND = frozenset([")", "]", "}", ",", ";", "=>", "eof"])


class Rust(Parser):
    ID = frozenset(["id"]) | _SOFT
    PATH = ID | frozenset(["self", "Self", "super", "crate"])
    BIN = {k: (p, False) for k, p in _BIN.items()}
    START = frozenset("pub fn use struct enum impl trait mod let return if for while loop match const static type".split())

    def __init__(self, toks, memo):
        super().__init__(toks, memo)
        self.struct = True  # whether a brace behind a path is a literal

    def program(self):
        self.items(self.item, "t", _EOF)

    def attributes(self):
        while self.at("#"):
            self.i += 1
            self.eat("!")
            if not self.at("["):
                self.fail("expected [ behind #")
            self.tree()

    def tree(self):
        """One balanced token tree."""
        K = self.K
        k = K[self.i]
        if k in CLOSE or k in ("eof", "bad"):
            self.fail(f"unexpected {k}")
        self.i += 1
        if k in OPEN:
            end = OPEN[k]
            while K[self.i] != end:
                self.tree()
            self.i += 1

    def visibility(self):
        if self.eat("pub") and self.at("(") and self.K[self.i + 1] in ("crate", "super", "self", "in"):
            self.tree()

    def item(self):
        if not self.item_opt():
            if self.macro_item():
                return
            self.fail(f"expected an item, found {self.K[self.i]}")

    def macro_item(self) -> bool:
        K, i = self.K, self.i
        if K[i] not in self.PATH and K[i] != "::":
            return False
        self.eat("::")
        while K[self.i] in self.PATH:
            self.i += 1
            if not self.eat("::"):
                break
        if not self.eat("!"):
            self.i = i
            return False
        brace = self.at("{")
        if K[self.i] not in OPEN:
            self.fail("expected ( or { behind a macro")
        self.tree()
        if not brace:
            self.need(";")
        return True

    def item_opt(self) -> bool:
        K, i = self.K, self.i
        self.attributes()
        if self.at("eof") or self.at("}"):
            return self.i > i
        self.visibility()
        k = K[self.i]
        if k == "default" and K[self.i + 1] in ("fn", "const", "type", "impl", "unsafe", "async"):
            self.i += 1
            k = K[self.i]
        if k == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif k == "struct" or k == "union" and K[self.i + 1] in self.ID:
            self.i += 1
            self.name()
            self.generics()
            if self.at("("):
                self.tuple_fields()
                self.where()
                self.need(";")
            else:
                self.where()
                if not self.eat(";"):
                    self.fields()
        elif k == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            while not self.at("}"):
                self.attributes()
                self.visibility()
                self.name()
                if self.at("("):
                    self.tuple_fields()
                elif self.at("{"):
                    self.fields()
                if self.eat("="):
                    self.binary()
                if not self.eat(","):
                    break
            self.need("}")
        elif k == "mod":
            self.i += 1
            self.name()
            if not self.eat(";"):
                self.need("{")
                self.items(self.item, "t", _BLOCK)
                self.need("}")
        elif k == "static" or k == "const" and K[self.i + 1] not in ("fn", "unsafe", "async", "extern", "{"):
            if k == "static" and K[self.i + 1] in ("|", "||", "move"):
                self.i = i
                return False
            self.i += 1
            self.eat("mut")
            self.eat("_") or self.name()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.free(self.expression)
            self.need(";")
        elif k == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            self.need(";")
        elif k == "macro_rules" and K[self.i + 1] == "!":
            self.i += 2
            self.name()
            brace = self.at("{")
            self.tree()
            if not brace:
                self.need(";")
        elif k == "extern" and K[self.i + 1] == "crate":
            self.i += 2
            self.eat("self") or self.name()
            if self.eat("as"):
                self.eat("_") or self.name()
            self.need(";")
        elif self.function_ahead():
            self.function()
        elif k == "extern" or k == "unsafe" and K[self.i + 1] == "extern":
            self.eat("unsafe")
            self.need("extern")
            self.eat("str")
            self.need("{")
            self.items(self.item, "t", _BLOCK)
            self.need("}")
        elif k == "trait" or k in ("unsafe", "auto") and K[self.i + 1] in ("trait", "auto"):
            while self.eat("unsafe") or self.eat("auto"):
                pass
            self.need("trait")
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            self.need("{")
            self.items(self.item, "t", _BLOCK)
            self.need("}")
        elif k == "impl" or k == "unsafe" and K[self.i + 1] == "impl":
            self.eat("unsafe")
            self.need("impl")
            if self.at("<") and K[self.i + 1] in ("life", "const", ">", "#") + tuple(self.ID):
                self.generics()
            self.eat("const")
            self.eat("!")
            self.type()
            if self.eat("for"):
                self.type()
            self.where()
            self.need("{")
            self.items(self.item, "t", _BLOCK)
            self.need("}")
        else:
            self.i = i
            return False
        return True

    def function_ahead(self) -> bool:
        j = self.i
        while self.K[j] in ("const", "async", "unsafe", "extern", "str") and j - self.i < 6:
            j += 1
        return self.K[j] == "fn"

    def function(self):
        while not self.eat("fn"):
            self.i += 1
        self.name()
        self.generics()
        self.need("(")
        while not self.at(")"):
            self.attributes()
            if self.eat("..."):
                break
            i = self.i
            if self.eat("&") and (self.eat("life") or True) and (self.eat("mut") or True) and self.eat("self"):
                pass
            else:
                self.i = i
                self.eat("mut")
                if self.eat("self"):
                    if self.eat(":"):
                        self.type()
                else:
                    self.i = i
                    self.pattern()
                    self.need(":")
                    self.eat("...") or self.type()
            if not self.eat(","):
                break
        self.need(")")
        if self.eat("->"):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()

    def use_tree(self):
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                while not self.at("}"):
                    self.use_tree()
                    if not self.eat(","):
                        break
                self.need("}")
                return
            if self.K[self.i] not in self.PATH:
                self.fail(f"expected a path, found {self.K[self.i]}")
            self.i += 1
            if not self.eat("::"):
                break
        if self.eat("as"):
            self.eat("_") or self.name()

    def tuple_fields(self):
        self.need("(")
        while not self.at(")"):
            self.attributes()
            self.visibility()
            self.type()
            if not self.eat(","):
                break
        self.need(")")

    def fields(self):
        self.need("{")
        while not self.at("}"):
            self.attributes()
            self.visibility()
            self.name()
            self.need(":")
            self.type()
            if not self.eat(","):
                break
        self.need("}")

    def generics(self):
        if not self.eat("<"):
            return
        while not self.at(">"):
            self.attributes()
            if self.eat("life"):
                if self.eat(":"):
                    self.bounds()
            elif self.eat("const"):
                self.name()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.generic_value()
            else:
                self.name()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not self.eat(","):
                break
        self.angle()

    def angle(self):
        """A closing > that the lexer may have joined to what follows."""
        K = self.K
        k = K[self.i]
        if k == ">":
            self.i += 1
        elif k in (">>", ">=", ">>="):
            K[self.i] = k[1:]
        else:
            self.fail(f"expected >, found {k}")

    def where(self):
        if not self.eat("where"):
            return
        while self.K[self.i] not in ("{", ";", "=", "eof"):
            if not self.eat("life"):
                self.for_lifetimes()
                self.type()
            self.need(":")
            self.bounds()
            if not self.eat(","):
                break

    def for_lifetimes(self):
        if self.at("for") and self.K[self.i + 1] == "<":
            self.i += 1
            self.generics()

    def bounds(self):
        while True:
            if self.K[self.i] in ("{", ",", ";", "=", ">", "where", ")"):
                return
            if not self.eat("life"):
                p = self.eat("(")
                while self.eat("?") or self.eat("~") or self.eat("const") or self.eat("async"):
                    pass
                self.for_lifetimes()
                if self.at("use"):
                    self.i += 1
                    self.generics()
                else:
                    self.type_path()
                if p:
                    self.need(")")
            if not self.eat("+"):
                return

    def type_path(self):
        if self.eat("<"):
            self.type()
            if self.eat("as"):
                self.type_path()
            self.angle()
            self.need("::")
        self.eat("::")
        while True:
            if self.K[self.i] not in self.PATH:
                self.fail(f"expected a type, found {self.K[self.i]}")
            self.i += 1
            if self.at("::") and self.K[self.i + 1] in ("<", "("):
                self.i += 1
            if self.at("<"):
                self.generic_args()
            elif self.at("("):
                self.need("(")
                while not self.at(")"):
                    self.type()
                    if not self.eat(","):
                        break
                self.need(")")
                if self.eat("->"):
                    self.type_no_bounds()
            if not self.eat("::"):
                return

    def generic_value(self):
        if self.at("{"):
            self.block()
        else:
            self.eat("-")
            self.i += 1

    def generic_args(self):
        if self.at("<<"):
            self.K[self.i] = "<"
            self.i -= 1
        self.need("<")
        while self.K[self.i] not in (">", ">>", ">=", ">>="):
            k = self.K[self.i]
            if k == "life":
                self.i += 1
            elif k in ("num", "str", "chr", "true", "false", "-", "{"):
                self.generic_value()
            else:
                self.type()
                if self.eat("="):
                    if self.K[self.i] in ("num", "str", "chr", "true", "false", "-", "{"):
                        self.generic_value()
                    else:
                        self.type()
                elif self.eat(":"):
                    self.bounds()
            if not self.eat(","):
                break
        self.angle()

    def type_no_bounds(self):
        self.type()

    def type(self):
        K = self.K
        k = K[self.i]
        if k in self.PATH or k == "::" or k == "<" or k == "<<":
            if k == "<<":
                K[self.i] = "<"
                self.i += 1
                self.type()
                if self.eat("as"):
                    self.type_path()
                self.angle()
                self.need("::")
                self.type_path()
                if self.eat("as"):
                    self.type_path()
                self.angle()
                self.need("::")
            if K[self.i] in self.PATH and K[self.i + 1] == "!":
                self.i += 2
                return self.tree()
            self.type_path()
            if k in self.ID and self.at("!"):
                self.i += 1
                self.tree()
        elif k in ("&", "&&"):
            self.i += 1
            self.eat("life")
            self.eat("mut")
            self.type()
        elif k == "*":
            self.i += 1
            if not (self.eat("const") or self.eat("mut")):
                self.fail("expected const or mut behind *")
            self.type()
        elif k == "(":
            self.i += 1
            while not self.at(")"):
                self.type()
                if self.eat("+"):
                    self.bounds()
                if not self.eat(","):
                    break
            self.need(")")
        elif k == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                self.free(self.expression)
            self.need("]")
        elif k in ("!", "_"):
            self.i += 1
        elif k in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif k in ("fn", "unsafe", "extern", "for"):
            self.for_lifetimes()
            if not self.at("fn") and K[self.i] not in ("unsafe", "extern"):
                return self.type()
            self.eat("unsafe")
            if self.eat("extern"):
                self.eat("str")
            self.need("fn")
            self.need("(")
            while not self.at(")"):
                self.attributes()
                if self.eat("..."):
                    break
                if (K[self.i] in self.ID or self.at("_")) and K[self.i + 1] == ":":
                    self.i += 2
                self.type()
                if not self.eat(","):
                    break
            self.need(")")
            if self.eat("->"):
                self.type()
        elif k == "life":
            self.bounds()
        else:
            self.fail(f"expected a type, found {k}")

    # -- patterns
    def pattern(self):
        self.eat("|")
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()

    def pattern_one(self):
        K = self.K
        k = K[self.i]
        if k in ("_", ".."):
            self.i += 1
            if k == ".." and K[self.i] in ("num", "chr", "-", "str"):
                self.literal_pattern()
        elif k == "..=":
            self.i += 1
            self.literal_pattern()
        elif k in ("&", "&&"):
            self.i += 1
            self.eat("mut")
            self.pattern_one()
        elif k in ("num", "str", "chr", "-", "true", "false"):
            self.literal_pattern()
            self.range_pattern()
        elif k == "(" or k == "[":
            end = OPEN[k]
            self.i += 1
            while not self.at(end):
                self.attributes()
                self.pattern()
                if not self.eat(","):
                    break
            self.need(end)
        elif k in ("ref", "mut", "box"):
            self.i += 1
            self.eat("mut")
            self.name()
            if self.eat("@"):
                self.pattern_one()
        elif k == "const":
            self.i += 1
            self.block()
        elif k in self.PATH or k in ("::", "<"):
            if K[self.i + 1] == "@":
                self.name()
                self.i += 1
                return self.pattern_one()
            if K[self.i + 1] == "!":
                self.i += 2
                return self.tree()
            self.path()
            if self.eat("("):
                while not self.at(")"):
                    self.attributes()
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(")")
            elif self.at("{"):
                self.i += 1
                while not self.at("}"):
                    self.attributes()
                    if self.eat(".."):
                        break
                    if K[self.i + 1] == ":":
                        self.i += 2
                        self.pattern()
                    else:
                        self.eat("ref")
                        self.eat("mut")
                        self.name()
                    if not self.eat(","):
                        break
                self.need("}")
            else:
                self.range_pattern()
        else:
            self.fail(f"expected a pattern, found {k}")

    def literal_pattern(self):
        self.eat("-")
        if self.K[self.i] in ("num", "str", "chr", "true", "false"):
            self.i += 1
        else:
            self.path()

    def range_pattern(self):
        if self.K[self.i] in ("..=", "...", ".."):
            self.i += 1
            if self.K[self.i] in ("num", "chr", "str", "-") or self.K[self.i] in self.PATH:
                self.literal_pattern()

    # -- blocks and statements
    def block(self):
        self.need("{")
        was, self.struct = self.struct, True
        self.items(self.statement, "s", _BLOCK)
        self.struct = was
        self.need("}")

    def free(self, rule):
        was, self.struct = self.struct, True
        rule()
        self.struct = was

    def header(self, rule):
        was, self.struct = self.struct, False
        rule()
        self.struct = was

    def statement(self):
        K = self.K
        if self.eat(";"):
            return
        i = self.i
        self.attributes()
        k = K[self.i]
        if k == "let":
            self.i += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expression()
                if self.eat("else"):
                    self.block()
            return self.need(";")
        if k in _ITEM:
            self.i = i
            if not (k in ("unsafe", "async", "const") and K[self.i + 1] in ("{", "move", "|", "||")) and self.item_opt():
                return
            self.attributes()
        i = self.i
        if k in self.PATH and K[i + 1] == "!" and K[i + 2] == "{":
            self.i += 2
            self.tree()
            if self.at(".") or self.at("?"):
                self.postfix_tail()
                self.rest()
            return
        blocklike = k in _BLOCKLIKE or k == "life" and K[i + 1] == ":" or k in ("async", "const") and K[i + 1] in ("{", "move")
        if blocklike:
            self.primary()
            if K[self.i] in (".", "?"):
                self.postfix_tail()
                self.rest()
            elif self.K[self.i] in ("as", "=") or k == "{" and False:
                self.rest()
            else:
                self.eat(";")
                return
        else:
            self.expression()
        if not self.eat(";") and not self.at("}"):
            self.fail(f"expected ;, found {K[self.i]}")

    def rest(self):
        """Operators behind an operand that was read already."""
        K = self.K
        while True:
            k = K[self.i]
            if k == "as":
                self.i += 1
                self.type()
            elif k in _ASSIGN:
                self.i += 1
                self.expression()
                return
            elif k in self.BIN:
                self.i += 1
                self.binary(self.BIN[k][0] + 1)
            else:
                return

    # -- expressions
    def expression(self):
        K = self.K
        self.attributes()
        self.binary()
        if K[self.i] in _ASSIGN:
            self.i += 1
            self.expression()

    def binary(self, least=0):
        K = self.K
        k = K[self.i]
        if k in ("..", "..="):
            self.i += 1
            if not self.no_operand():
                self.binary(2)
            return
        self.unary()
        while True:
            k = K[self.i]
            if k == "as":
                self.i += 1
                self.type()
                continue
            p = self.BIN.get(k)
            if p is None or p[0] < least:
                return
            self.i += 1
            if p[0] == 1:
                if not self.no_operand():
                    self.binary(2)
            else:
                self.binary(p[0] + 1)

    def no_operand(self) -> bool:
        k = self.K[self.i]
        return k in _NO_OPERAND or k == "{" and not self.struct

    def unary(self):
        K = self.K
        k = K[self.i]
        if k in ("-", "!", "*"):
            self.i += 1
            self.unary()
        elif k in ("&", "&&"):
            self.i += 1
            if self.at("raw") and K[self.i + 1] in ("const", "mut"):
                self.i += 2
            else:
                self.eat("mut")
            self.unary()
        else:
            self.primary()
            self.postfix_tail()

    def postfix_tail(self):
        K = self.K
        while True:
            k = K[self.i]
            if k == "?":
                self.i += 1
            elif k == ".":
                self.i += 1
                if self.eat("await") or self.eat("num"):
                    continue
                self.name()
                if self.at("::"):
                    self.i += 1
                    self.generic_args()
            elif k == "(":
                self.args()
            elif k == "[":
                self.i += 1
                self.free(self.expression)
                self.need("]")
            else:
                return

    def args(self):
        self.need("(")
        while not self.at(")"):
            self.free(self.expression)
            if not self.eat(","):
                break
        self.need(")")

    def path(self):
        if self.eat("<"):
            self.type()
            if self.eat("as"):
                self.type_path()
            self.angle()
            self.need("::")
        self.eat("::")
        while True:
            if self.K[self.i] not in self.PATH:
                self.fail(f"expected a path, found {self.K[self.i]}")
            self.i += 1
            if not self.at("::"):
                return
            self.i += 1
            if self.K[self.i] in ("<", "<<"):
                self.generic_args()
                if not self.eat("::"):
                    return

    def primary(self):
        K = self.K
        k = K[self.i]
        if k in ("num", "str", "chr", "true", "false"):
            self.i += 1
        elif k in self.PATH or k in ("::", "<"):
            self.path()
            if self.at("!") and K[self.i + 1] in OPEN and k in self.PATH | {"::"}:
                self.i += 1
                self.tree()
            elif self.at("{") and self.struct:
                self.struct_literal()
        elif k == "(":
            self.i += 1
            while not self.at(")"):
                self.free(self.expression)
                if not self.eat(","):
                    break
            self.need(")")
        elif k == "[":
            self.i += 1
            while not self.at("]"):
                self.free(self.expression)
                if self.eat(";"):
                    self.free(self.expression)
                    break
                if not self.eat(","):
                    break
            self.need("]")
        elif k == "{":
            self.block()
        elif k == "if":
            self.if_()
        elif k == "match":
            self.i += 1
            self.header(self.expression)
            self.need("{")
            was, self.struct = self.struct, True
            self.items(self.arm, "a", _BLOCK)
            self.struct = was
            self.need("}")
        elif k == "life":
            self.i += 1
            self.need(":")
            if K[self.i] not in ("loop", "while", "for", "{"):
                self.fail("expected a loop behind a label")
            self.primary()
        elif k == "loop":
            self.i += 1
            self.block()
        elif k == "while":
            self.i += 1
            self.header(self.condition)
            self.block()
        elif k == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.header(self.expression)
            self.block()
        elif k == "unsafe":
            self.i += 1
            self.block()
        elif k in ("async", "const") and K[self.i + 1] in ("{", "move", "|", "||"):
            self.i += 1
            if K[self.i] == "move" and K[self.i + 1] == "{":
                self.i += 1
            if self.at("{"):
                self.block()
            else:
                self.primary()
        elif k in ("|", "||", "move", "static"):
            self.eat("static")
            self.eat("move")
            if not self.eat("||"):
                self.need("|")
                while not self.at("|"):
                    self.attributes()
                    self.pattern_one()
                    if self.eat(":"):
                        self.type()
                    if not self.eat(","):
                        break
                self.need("|")
            if self.eat("->"):
                self.type()
                self.block()
            else:
                self.expression()
        elif k in ("return", "break", "continue"):
            self.i += 1
            if k != "return":
                self.eat("life")
            if k != "continue" and not self.no_operand():
                self.expression()
        elif k == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            self.binary(4)
        elif k == "_":
            self.i += 1
        else:
            self.fail(f"expected an expression, found {k}")

    def condition(self):
        self.expression()

    def if_(self):
        self.need("if")
        self.header(self.condition)
        self.block()
        if self.eat("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def arm(self):
        self.attributes()
        self.pattern()
        if self.eat("if"):
            self.expression()
        self.need("=>")
        if self.at("{"):
            self.block()
            if self.eat(","):
                return
            if self.K[self.i] in (".", "?"):
                self.postfix_tail()
                self.rest()
                if not self.at("}"):
                    self.need(",")
            return
        blocklike = self.K[self.i] in _BLOCKLIKE
        self.expression()
        if not self.eat(",") and not self.at("}") and not blocklike:
            self.fail(f"expected , or }}, found {self.K[self.i]}")

    def struct_literal(self):
        self.need("{")
        while not self.at("}"):
            self.attributes()
            if self.eat(".."):
                if not self.at("}"):
                    self.free(self.expression)
                break
            if self.at("num"):
                self.i += 1
            else:
                self.name()
            if self.eat(":"):
                self.free(self.expression)
            if not self.eat(","):
                break
        self.need("}")


def parse_rust(text: str, memo: dict):
    return Rust(lex_rust(text), memo).run()
