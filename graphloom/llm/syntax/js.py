"""ts and js, both as modules."""

from __future__ import annotations

from graphloom.llm.syntax.base import Fail, Parser
from graphloom.llm.syntax.clex import JS_WORDS, lex_js

_RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for
    function if import in instanceof new null return super switch this throw true try typeof var void while with""".split()
)
_BIN = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8,
    ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="])
_CLOSE_BLOCK = frozenset(["}"])
_CASE_END = frozenset(["}", "case", "default"])
_EOF = frozenset(["eof"])
_MODS = frozenset(["public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "async", "accessor"])


class Js(Parser):
    TS = False
    BREAKS = True
    ID = frozenset(["id"]) | (JS_WORDS - _RESERVED)
    BIN = {k: (p, k == "**") for k, p in _BIN.items()}
    CONT = Parser.CONT | frozenset(_BIN) | _ASSIGN | frozenset(["?.", "(", "[", "tpl", "tplhead", ":", ",", "=>", "as"]) - frozenset(["in"])
    START = frozenset("import export function class const let var if for while do switch try return throw interface type".split())
    lex = staticmethod(lex_js)

    def __init__(self, toks, memo):
        super().__init__(toks, memo)
        self.no_in = False
        self.target = False  # the expression just read may be assigned to

    def stop(self, k):
        return k == "in" and self.no_in

    def program(self):
        self.items(self.statement, "s", _EOF)

    def semi(self):
        k = self.K[self.i]
        if k == ";":
            self.i += 1
        elif k != "}" and k != "eof" and not self.NL[self.i]:
            self.fail(f"expected ; or a line break, found {k}")

    def block(self):
        self.need("{")
        self.items(self.statement, "s", _CLOSE_BLOCK)
        self.need("}")

    # -- statements
    def statement(self):
        K, i = self.K, self.i
        k = K[i]
        rule = getattr(self, "s_" + k, None) if k in _RULES else None
        if rule is not None and rule() is not False:
            return
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
            return
        if k == "@":
            self.decorators()
            if not (self.at("class") or self.at("export") or self.at("abstract")):
                self.fail("expected a class behind a decorator")
            return self.statement()
        if k in self.ID and K[i + 1] == ":":
            self.i += 2
            return self.statement()
        self.expression()
        self.semi()

    def decorators(self):
        while self.eat("@"):
            self.postfix()

    def s_function(self):
        self.function()

    def s_async(self):
        if self.K[self.i + 1] == "function" and not self.NL[self.i + 1]:
            self.i += 1
            return self.function()
        return False

    def s_class(self):
        self.klass(True)

    def s_if(self):
        self.i += 1
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def s_while(self):
        self.i += 1
        self.paren()
        self.statement()

    def s_with(self):
        self.fail("with in a module")

    def s_do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.eat(";")

    def s_for(self):
        self.i += 1
        self.eat("await")
        self.need("(")
        self.no_in = True
        if self.at("var") or self.at("const") or self.at("let") and self.K[self.i + 1] not in ("in", "of", "=", ";", "."):
            self.i += 1
            self.declarators(True)
        elif not self.at(";"):
            self.expression()
        self.no_in = False
        if self.eat("of"):
            self.assignment()
        elif self.eat("in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.statement()

    def s_switch(self):
        self.i += 1
        self.paren()
        self.need("{")
        while not self.at("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            self.items(self.statement, "s", _CASE_END)
        self.need("}")

    def s_try(self):
        self.i += 1
        self.block()
        if self.eat("catch"):
            if self.eat("("):
                self.pattern()
                if self.TS and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
            if self.eat("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def s_throw(self):
        self.i += 1
        if self.NL[self.i]:
            self.fail("line break behind throw")
        self.expression()
        self.semi()

    def s_return(self):
        self.i += 1
        if self.K[self.i] not in ("}", ";", "eof") and not self.NL[self.i]:
            self.expression()
        self.semi()

    def s_break(self):
        self.i += 1
        if self.K[self.i] in self.ID and not self.NL[self.i]:
            self.i += 1
        self.semi()

    s_continue = s_break

    def s_debugger(self):
        self.i += 1
        self.semi()

    def s_var(self):
        self.i += 1
        self.declarators(False)
        self.semi()

    def s_const(self):
        if self.TS and self.K[self.i + 1] == "enum":
            self.i += 1
            return self.s_enum()
        self.i += 1
        self.declarators(False, True)
        self.semi()

    def s_let(self):
        k = self.K[self.i + 1]
        if k in self.ID or k in ("[", "{"):
            self.i += 1
            self.declarators(False)
            return self.semi()
        return False

    def declarators(self, loop: bool, const: bool = False):
        while True:
            destructured = self.K[self.i] in ("[", "{")
            self.pattern()
            if self.TS:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            elif (const or destructured) and not loop and not self.ambient:
                self.fail("a declaration without a value")
            if not self.eat(","):
                return

    ambient = False

    def s_import(self):
        nxt = self.K[self.i + 1]
        if nxt in ("(", "."):
            return False
        self.i += 1
        if self.depth > 1 and not self.ambient:
            self.i -= 1
            self.fail("import inside a block")
        if self.at("str"):
            self.i += 1
            self.attributes()
            return self.semi()
        nxt = self.K[self.i + 1]
        if self.TS and self.at("type") and (nxt in ("{", "*") or nxt in self.ID and not (nxt == "from" and self.K[self.i + 2] == "str")):
            self.i += 1
        if self.K[self.i] in self.ID:
            self.i += 1
            if self.TS and self.eat("="):
                self.expression()
                return self.semi()
            if self.eat(","):
                self.clause()
        else:
            self.clause()
        self.need("from")
        self.need("str")
        self.attributes()
        self.semi()

    def attributes(self):
        if self.at("with") or self.K[self.i] == "id" and not self.NL[self.i] and self.K[self.i + 1] == "{":
            self.i += 1
            self.object()

    def clause(self):
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()

    def specifiers(self):
        self.need("{")
        while not self.at("}"):
            if self.TS and self.at("type") and self.K[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            self.module_name()
            if self.eat("as"):
                self.module_name()
            if not self.eat(","):
                break
        self.need("}")

    def module_name(self):
        k = self.K[self.i]
        if k != "str" and k not in self.ID and k not in _RESERVED:
            self.fail(f"expected a name, found {k}")
        self.i += 1

    def s_export(self):
        self.i += 1
        if self.depth > 1 and not self.ambient and not self.inside:
            self.i -= 1
            self.fail("export inside a block")
        k = self.K[self.i]
        if self.eat("default"):
            k = self.K[self.i]
            if k == "function" or k == "async" and self.K[self.i + 1] == "function":
                self.eat("async")
                return self.function(optional=True)
            if k in ("class", "@") or k == "abstract" and self.K[self.i + 1] == "class":
                self.decorators()
                self.eat("abstract")
                return self.klass(False)
            if self.TS and k == "interface":
                return self.s_interface()
            self.assignment()
            return self.semi()
        if self.TS and k == "=":
            self.i += 1
            self.expression()
            return self.semi()
        if self.TS and k == "type" and self.K[self.i + 1] in ("{", "*"):
            self.i += 1
            k = self.K[self.i]
        if k == "*":
            self.i += 1
            if self.eat("as"):
                self.module_name()
            self.need("from")
            self.need("str")
            self.attributes()
            return self.semi()
        if k == "{":
            self.specifiers()
            if self.eat("from"):
                self.need("str")
                self.attributes()
            return self.semi()
        if k in ("function", "class", "const", "var", "let", "async", "@") or self.TS and k in (
            "interface", "type", "enum", "namespace", "module", "declare", "abstract", "import", "global",
        ):
            return self.statement()
        self.fail(f"cannot export {k}")

    inside = False

    # -- functions and classes
    def function(self, optional: bool = False):
        self.need("function")
        self.eat("*")
        if self.K[self.i] in self.ID:
            self.i += 1
        elif not optional:
            self.fail(f"expected a name, found {self.K[self.i]}")
        self.signature()
        self.body()

    def body(self):
        if self.TS and not self.at("{"):
            return self.semi()
        self.block()

    def signature(self):
        if self.TS and self.at("<"):
            self.type_params()
        self.params()
        if self.TS and self.eat(":"):
            self.return_type()

    def params(self):
        self.need("(")
        while not self.at(")"):
            if self.at("@"):
                self.decorators()
            while self.TS and self.K[self.i] in _MODS and self.K[self.i + 1] in self.ID | frozenset(["{", "["]):
                self.i += 1
            if self.eat("..."):
                self.pattern()
                if self.TS and self.eat(":"):
                    self.type()
                self.eat(",") if self.TS else None
                break
            if self.TS and self.at("this"):
                self.i += 1
            else:
                self.pattern()
            if self.TS:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.free(self.assignment)
            if not self.eat(","):
                break
        self.need(")")

    def free(self, rule):
        """Runs a rule where ``in`` is an operator again."""
        was, self.no_in = self.no_in, False
        rule()
        self.no_in = was

    def pattern(self):
        k = self.K[self.i]
        if k == "{":
            self.i += 1
            while not self.at("}"):
                if self.eat("..."):
                    self.name()
                    break
                if self.K[self.i] == "[":
                    self.i += 1
                    self.free(self.assignment)
                    self.need("]")
                    self.need(":")
                    self.pattern()
                else:
                    plain = self.K[self.i] in self.ID
                    self.property_name()
                    if self.eat(":"):
                        self.pattern()
                    elif not plain:
                        self.fail("expected :")
                if self.eat("="):
                    self.free(self.assignment)
                if not self.eat(","):
                    break
            self.need("}")
        elif k == "[":
            self.i += 1
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.pattern()
                if self.eat("="):
                    self.free(self.assignment)
                if not self.at("]"):
                    self.need(",")
            self.need("]")
        else:
            self.name()

    def property_name(self):
        k = self.K[self.i]
        if k == "[":
            self.i += 1
            self.free(self.assignment)
            self.need("]")
        elif k in self.ID or k in _RESERVED or k in ("str", "num"):
            self.i += 1
        elif k == "#" and self.K[self.i + 1] in self.ID | _RESERVED:
            self.i += 2
        else:
            self.fail(f"expected a property name, found {k}")

    def klass(self, named: bool):
        self.need("class")
        if self.K[self.i] in self.ID and not (self.at("implements") and self.TS):
            self.i += 1
        elif named:
            self.fail(f"expected a class name, found {self.K[self.i]}")
        if self.TS and self.at("<"):
            self.type_params()
        if self.eat("extends"):
            self.postfix()
            if self.TS and self.at("<"):
                self.type_args()
        if self.TS and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.items(self.member, "m", _CLOSE_BLOCK)
        self.need("}")

    def member(self):
        K = self.K
        if self.eat(";"):
            return
        self.decorators()
        if self.at("static") and K[self.i + 1] == "{":
            self.i += 1
            return self.block()
        ends = ("(", "=", ";", "}", ":", "?", "!", "<")
        while K[self.i] in (_MODS if self.TS else ("static", "async", "accessor")) and K[self.i + 1] not in ends and not (
            K[self.i] != "static" and self.NL[self.i + 1]
        ):
            self.i += 1
        star = self.eat("*")
        if not star and K[self.i] in ("get", "set") and K[self.i + 1] not in ends and not self.NL[self.i + 1]:
            self.i += 1
        if self.TS and self.at("[") and K[self.i + 1] in self.ID and K[self.i + 2] in (":", "in"):
            self.index_signature()
            return self.semi()
        self.property_name()
        if self.TS and (self.at("?") or self.at("!")):
            self.i += 1
        if self.at("(") or self.TS and self.at("<"):
            self.signature()
            return self.body()
        if self.TS and self.eat(":"):
            self.type()
        if self.eat("="):
            self.assignment()
        self.semi()

    # -- expressions
    def paren(self):
        self.need("(")
        self.free(self.expression)
        self.need(")")

    def expression(self):
        self.assignment()
        while self.eat(","):
            self.assignment()
            self.target = False

    def assignment(self):
        K, i = self.K, self.i
        k = K[i]
        if k == "yield":
            self.i += 1
            if not self.NL[self.i] and K[self.i] not in (")", "]", "}", ",", ";", ":", "eof", "tplmid", "tpltail"):
                self.eat("*")
                self.assignment()
            self.target = False
            return
        if self.arrow():
            self.target = False
            return
        self.binary()
        k = K[self.i]
        if k == "?":
            self.i += 1
            self.free(self.assignment)
            self.need(":")
            self.assignment()
            self.target = False
        elif k in _ASSIGN or k == ">" and self.shift_assign():
            if not self.target:
                self.fail("the left side cannot be assigned to")
            self.i += 1
            self.assignment()
            self.target = False

    def shift_assign(self) -> bool:
        return False

    def operand(self, op, least):
        self.binary(least)
        self.target = False

    def binary(self, least=0):
        K = self.K
        if K[self.i] == "#" and K[self.i + 1] in self.ID and K[self.i + 2] == "in":
            self.i += 2
        else:
            self.unary()
        while True:
            k = K[self.i]
            if self.TS and k in ("as", "satisfies") and not self.NL[self.i]:
                if 8 < least:
                    return
                self.i += 1
                self.eat("const") or self.type()
                continue
            p = self.BIN.get(k)
            if p is None or p[0] < least or k == "in" and self.no_in:
                return
            self.i += 1
            if k == ">":  # the lexer keeps > apart so that types can close
                while K[self.i] in (">", ">=") and self.t.starts[self.i] == self.t.starts[self.i - 1] + 1:
                    self.i += 1
                if K[self.i - 1] == ">=" and K[self.i - 2] == ">":
                    if not self.target:
                        self.fail("the left side cannot be assigned to")
                    return self.assignment()
            self.binary(p[0] if p[1] else p[0] + 1)
            self.target = False

    def arrow(self) -> bool:
        K, i = self.K, self.i
        k = K[i]
        if k in self.ID:
            if K[i + 1] == "=>" and not self.NL[i + 1]:
                self.i += 1
                self.arrow_body()
                return True
            if k == "async" and not self.NL[i + 1]:
                if K[i + 1] in self.ID and K[i + 2] == "=>":
                    self.i += 2
                    self.arrow_body()
                    return True
                if K[i + 1] in ("(", "<"):
                    self.i += 1
                    if self.arrow_paren():
                        return True
                    self.i = i
            return False
        return k in ("(", "<") and self.arrow_paren()

    def arrow_paren(self) -> bool:
        i = self.i
        if self.at("<") and not self.TS:
            return False
        if self.at("("):
            m = self.match(i)
            if m < 0 or self.K[m + 1] != "=>" and not (self.TS and self.K[m + 1] == ":"):
                return False
            if self.K[m + 1] == "=>":
                self.params()
                self.arrow_body()
                return True
        if self.attempt(self.signature) and self.at("=>"):
            self.arrow_body()
            return True
        self.i = i
        return False

    def arrow_body(self):
        self.need("=>")
        if self.at("{"):
            self.free(self.block)
        else:
            self.assignment()

    _PRE = frozenset(["!", "~", "+", "-", "typeof", "void", "delete"])

    def unary(self):
        K = self.K
        k = K[self.i]
        if k in self._PRE:
            self.i += 1
            self.unary()
            if K[self.i] == "**":
                self.fail("unary operand of **")
            self.target = False
        elif k == "await" and K[self.i + 1] not in (")", ";", ",", "]", "}", "=", ".", "=>", ":", "eof"):
            self.i += 1
            self.unary()
            self.target = False
        elif k in ("++", "--"):
            self.i += 1
            self.unary()
            if not self.target:
                self.fail("the operand cannot be assigned to")
            self.target = False
        elif k == "<" and self.TS:
            self.i += 1
            self.type()
            self.need(">")
            self.unary()
        else:
            self.postfix()
            if K[self.i] in ("++", "--") and not self.NL[self.i]:
                if not self.target:
                    self.fail("the operand cannot be assigned to")
                self.i += 1
                self.target = False

    def postfix(self):
        K = self.K
        self.primary()
        while True:
            k = K[self.i]
            if k == ".":
                self.i += 1
                self.eat("#")
                if K[self.i] not in self.ID and K[self.i] not in _RESERVED:
                    self.fail(f"expected a property name, found {K[self.i]}")
                self.i += 1
                self.target = True
            elif k == "(":
                self.args()
                self.target = False
            elif k == "[":
                self.i += 1
                self.free(self.expression)
                self.need("]")
                self.target = True
            elif k == "?.":
                self.i += 1
                if self.at("("):
                    self.args()
                elif self.eat("["):
                    self.free(self.expression)
                    self.need("]")
                else:
                    self.eat("#")
                    if K[self.i] not in self.ID and K[self.i] not in _RESERVED:
                        self.fail(f"expected a property name, found {K[self.i]}")
                    self.i += 1
                self.target = False
            elif k == "tpl" or k == "tplhead":
                self.template()
                self.target = False
            elif self.TS and k == "!" and not self.NL[self.i] and K[self.i + 1] != "=":
                self.i += 1
            elif self.TS and k == "<" and self.generic_call():
                self.target = False
            else:
                return

    def generic_call(self) -> bool:
        i = self.i
        if self.attempt(self.type_args) and self.K[self.i] in ("(", "tpl", "tplhead", ")", "]", ":", ";", ",", "}", "eof"):
            return True
        self.i = i
        return False

    def args(self):
        self.need("(")
        while not self.at(")"):
            self.eat("...")
            self.free(self.assignment)
            if not self.eat(","):
                break
        self.need(")")

    def template(self):
        if self.eat("tpl"):
            return
        self.need("tplhead")
        while True:
            self.free(self.expression)
            if self.eat("tpltail"):
                return
            self.need("tplmid")

    def primary(self):
        K = self.K
        k = K[self.i]
        self.target = False
        if k in self.ID:
            if k == "async" and K[self.i + 1] == "function" and not self.NL[self.i + 1]:
                self.i += 1
                return self.function(True)
            self.i += 1
            self.target = True
        elif k in ("num", "str", "regex", "this", "null", "true", "false"):
            self.i += 1
        elif k == "(":
            self.i += 1
            self.free(self.expression)
            t = self.target
            self.need(")")
            self.target = t
        elif k == "[":
            self.i += 1
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.free(self.assignment)
                if not self.at("]"):
                    self.need(",")
            self.need("]")
            self.target = True
        elif k == "{":
            self.object()
            self.target = True
        elif k in ("tpl", "tplhead"):
            self.template()
        elif k == "function":
            self.function(True)
        elif k == "class" or k == "@":
            self.decorators()
            self.klass(False)
        elif k == "new":
            self.i += 1
            if self.eat("."):
                return self.name()
            self.new_target()
        elif k == "super":
            self.i += 1
            if K[self.i] not in ("(", ".", "["):
                self.fail("super alone")
        elif k == "import":
            self.i += 1
            if self.eat("."):
                self.name()
            else:
                self.args()
        else:
            self.fail(f"expected an expression, found {k}")

    def new_target(self):
        K = self.K
        if self.at("new"):
            self.primary()
        else:
            self.primary()
            while K[self.i] in (".", "["):
                if self.eat("."):
                    self.eat("#")
                    self.property_name()
                else:
                    self.i += 1
                    self.free(self.expression)
                    self.need("]")
        if self.TS and self.at("<"):
            self.attempt(self.type_args)
        if self.at("("):
            self.args()

    def object(self):
        K = self.K
        self.need("{")
        while not self.at("}"):
            if self.eat("..."):
                self.free(self.assignment)
            else:
                nxt = (",", "}", ":", "(", "=", "<")
                k = K[self.i]
                if k == "async" and K[self.i + 1] not in nxt:
                    self.i += 1
                if self.eat("*"):
                    pass
                elif K[self.i] in ("get", "set") and K[self.i + 1] not in nxt:
                    self.i += 1
                plain = K[self.i] in self.ID
                self.property_name()
                if self.at("(") or self.TS and self.at("<"):
                    self.signature()
                    self.free(self.block)
                elif self.eat(":"):
                    self.free(self.assignment)
                elif plain and self.eat("="):
                    self.free(self.assignment)
                elif not plain:
                    self.fail(f"expected :, found {K[self.i]}")
            if not self.eat(","):
                break
        self.need("}")


class Ts(Js):
    TS = True

    def s_interface(self):
        if self.K[self.i] != "interface" or self.K[self.i + 1] not in self.ID or self.NL[self.i + 1]:
            return False
        self.i += 2
        if self.at("<"):
            self.type_params()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.object_type()

    def s_type(self):
        if self.K[self.i + 1] not in self.ID or self.NL[self.i + 1]:
            return False
        self.i += 2
        if self.at("<"):
            self.type_params()
        self.need("=")
        self.type()
        self.semi()

    def s_enum(self):
        self.i += 1
        self.name()
        self.need("{")
        while not self.at("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                break
        self.need("}")

    def s_namespace(self):
        k = self.K[self.i + 1]
        if k not in self.ID and k != "str" or self.NL[self.i + 1]:
            return False
        self.i += 2
        while self.eat("."):
            self.name()
        if not self.at("{"):
            return self.semi()
        was, self.inside = self.inside, True
        self.block()
        self.inside = was

    s_module = s_namespace

    def s_global(self):
        if self.K[self.i + 1] != "{":
            return False
        self.i += 1
        self.block()

    def s_declare(self):
        if self.NL[self.i + 1] or self.K[self.i + 1] not in _DECLARED:
            return False
        self.i += 1
        was, self.ambient, self.inside = (self.ambient, self.inside), True, True
        try:
            self.statement()
        finally:
            self.ambient, self.inside = was

    def s_abstract(self):
        if self.K[self.i + 1] != "class":
            return False
        self.i += 1
        self.klass(True)

    # -- types
    def type_params(self):
        self.need("<")
        while not self.at(">"):
            while self.K[self.i] in ("const", "in", "out") and self.K[self.i + 1] in self.ID:
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
        self.close_angle()

    def close_angle(self):
        k = self.K[self.i]
        if k == ">=":  # as in ``let x: A<B>= c``
            self.K[self.i] = "="
            return
        self.need(">")

    def type_args(self):
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def return_type(self):
        K = self.K
        if self.at("asserts") and K[self.i + 1] in self.ID | frozenset(["this"]) and not self.NL[self.i + 1]:
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if (K[self.i] in self.ID or self.at("this")) and K[self.i + 1] == "is" and not self.NL[self.i + 1]:
            self.i += 2
        self.type()

    def type(self):
        K = self.K
        k = K[self.i]
        if k == "<":
            self.type_params()
            self.params()
            self.need("=>")
            return self.return_type()
        if k == "new" or k == "abstract" and K[self.i + 1] == "new":
            self.eat("abstract")
            self.i += 1
            if self.at("<"):
                self.type_params()
            self.params()
            self.need("=>")
            return self.return_type()
        if k == "(":
            m = self.match(self.i)
            if m > 0 and K[m + 1] == "=>":
                self.params()
                self.need("=>")
                return self.return_type()
        self.union()
        if self.at("extends") and not self.NL[self.i] and not self.no_cond:
            self.i += 1
            was, self.no_cond = self.no_cond, True
            self.union()
            self.no_cond = was
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    no_cond = False

    def union(self):
        self.eat("|") or self.eat("&")
        self.type_unary()
        while self.at("|") or self.at("&"):
            self.i += 1
            self.type_unary()

    def type_unary(self):
        K = self.K
        k = K[self.i]
        if k in ("keyof", "readonly", "unique") and (K[self.i + 1] in self.ID or K[self.i + 1] in ("typeof", "(", "{", "[", "this", "import", "str")):
            self.i += 1
            return self.type_unary()
        if k == "infer":
            self.i += 1
            self.name()
            if self.at("extends"):
                i = self.i
                self.i += 1
                if not self.attempt(self.union) or self.at("?"):
                    self.i = i
            return
        self.type_primary()
        while not self.NL[self.i] and self.at("["):
            self.i += 1
            if not self.at("]"):
                self.type()
            self.need("]")

    def type_primary(self):
        K = self.K
        k = K[self.i]
        if k in ("str", "num", "true", "false", "null", "void", "this", "tpl"):
            self.i += 1
        elif k == "tplhead":
            self.i += 1
            while True:
                self.type()
                if self.eat("tpltail"):
                    return
                self.need("tplmid")
        elif k == "-" and K[self.i + 1] == "num":
            self.i += 2
        elif k == "typeof":
            self.i += 1
            if self.at("import"):
                return self.type_primary()
            if not self.eat("this"):
                self.name()
            while self.eat("."):
                self.eat("#")
                self.property_name()
            if self.at("<") and not self.NL[self.i]:
                self.type_args()
        elif k == "import":
            self.i += 1
            self.args()
            while self.eat("."):
                self.name()
            if self.at("<"):
                self.type_args()
        elif k == "(":
            self.i += 1
            was, self.no_cond = self.no_cond, False
            self.type()
            self.no_cond = was
            self.need(")")
        elif k == "[":
            self.i += 1
            while not self.at("]"):
                self.eat("...")
                if K[self.i] in self.ID and K[self.i + 1] in (":", "?") and (K[self.i + 1] == ":" or K[self.i + 2] == ":"):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
        elif k == "{":
            self.object_type()
        elif k in self.ID:
            self.i += 1
            while self.eat("."):
                self.property_name()
            if self.at("<") and not self.NL[self.i]:
                self.type_args()
        else:
            self.fail(f"expected a type, found {k}")

    def index_signature(self):
        self.need("[")
        self.name()
        if self.eat("in"):
            self.type()
            if self.eat("as"):
                self.type()
        else:
            self.need(":")
            self.type()
        self.need("]")
        if self.K[self.i] in ("+", "-"):
            self.i += 1
        self.eat("?")
        if self.eat(":"):
            self.type()

    def object_type(self):
        was, self.no_cond = self.no_cond, False
        self.need("{")
        while not self.at("}"):
            self.type_member()
            if not (self.eat(",") or self.eat(";")) and not self.at("}") and not self.NL[self.i]:
                self.fail(f"expected ; or }}, found {self.K[self.i]}")
        self.need("}")
        self.no_cond = was

    def type_member(self):
        K = self.K
        if self.at("(") or self.at("<"):
            return self.signature()
        if self.at("new") and K[self.i + 1] in ("(", "<"):
            self.i += 1
            return self.signature()
        ends = ("(", ";", "}", ":", "?", "<", ",", "!")
        if K[self.i] in ("+", "-"):
            self.i += 1
        while K[self.i] in ("readonly", "get", "set") and K[self.i + 1] not in ends:
            self.i += 1
        if self.at("[") and K[self.i + 1] in self.ID and K[self.i + 2] in (":", "in"):
            return self.index_signature()
        self.property_name()
        self.eat("?")
        if self.at("(") or self.at("<"):
            return self.signature()
        if self.eat(":"):
            self.type()


_DECLARED = frozenset("const let var function class interface type enum namespace module global abstract async".split())
_RULES = frozenset(
    """function async class if while with do for switch try throw return break continue debugger var const let import
    export interface type enum namespace module global declare abstract""".split()
)


def parse_js(text: str, memo: dict):
    return Js(lex_js(text), memo).run()


def parse_ts(text: str, memo: dict):
    return Ts(lex_js(text), memo).run()


__all__ = ["Fail", "parse_js", "parse_ts"]
