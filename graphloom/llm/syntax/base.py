"""Recursive-descent statements, precedence-climbing expressions and panic-mode recovery.

A lexer turns a text into token kinds (a keyword or mark is its own kind), the kinds carry their
position, their matching bracket and whether a line break comes before them. A language's parser
descends over the kinds alone. On an error the statement is given up, the error is stored and
parsing goes on at the next statement, so that all errors of a file are reported.

Statements repeat a lot between files, so a run of lines whose kinds were accepted once as whole
statements in the same place of the grammar is accepted again without a descent. Where line breaks
decide and are no kinds, the run's line breaks belong to its key. The memory is bounded.
"""

from __future__ import annotations

import sys

MEMO_MAX = 200_000
MEMO_LEN = 400
FRAMES = 60  # calls that a token can nest


class Fail(Exception):
    def __init__(self, at: int, cause: str):
        super().__init__(cause)
        self.at, self.cause = at, cause


class Tokens:
    """Kinds, start offsets, line breaks before tokens, first tokens of lines with their indent."""

    __slots__ = ("kinds", "starts", "nl", "lines", "bad", "size")

    def __init__(self):
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.nl: list[bool] = []
        self.lines: list[tuple[int, int]] = []
        self.bad: dict[int, str] = {}
        self.size = 0

    def add(self, kind: str, start: int, nl: bool) -> None:
        self.kinds.append(kind)
        self.starts.append(start)
        self.nl.append(nl)


OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = frozenset(")]}")


class Parser:
    """What the seven languages share. ``memo`` is one dictionary per process and language."""

    ID: frozenset[str] = frozenset(["id"])
    BIN: dict[str, tuple[int, bool]] = {}
    # kinds that go on with a statement when they start a line of the same indent
    BREAKS = False  # whether the grammar looks at line breaks that are no kinds
    CONT: frozenset[str] = frozenset([")", "]", "}", "else", "catch", "finally", "case", "default", ".", "?"])

    def __init__(self, toks: Tokens, memo: dict):
        self.t = toks
        self.K = toks.kinds
        self.NL = toks.nl
        self.i = 0
        self.errors: list[tuple[int, str]] = []
        self.memo = memo
        self.line_of: dict[int, int] = {tok: n for n, (tok, _) in enumerate(toks.lines)}
        self._match: dict[int, int] | None = None
        self.depth = 0

    # -- small helpers
    def fail(self, cause: str):
        k = self.K[self.i]
        if k == "bad":
            cause = self.t.bad.get(self.i, "unknown character")
        elif k == "eof":
            cause = "unexpected end: " + cause
        raise Fail(self.i, cause)

    def at(self, kind: str) -> bool:
        return self.K[self.i] == kind

    def eat(self, kind: str) -> bool:
        if self.K[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.K[self.i] != kind:
            self.fail(f"expected {kind}, found {self.K[self.i]}")
        self.i += 1

    def name(self) -> None:
        if self.K[self.i] not in self.ID:
            self.fail(f"expected a name, found {self.K[self.i]}")
        self.i += 1

    def match(self, i: int) -> int:
        """The index of the bracket that closes the one at ``i``, or -1."""
        if self._match is None:
            self._match, stack = {}, []
            for j, k in enumerate(self.K):
                if k in OPEN:
                    stack.append(j)
                elif k in CLOSE and stack:
                    if OPEN[self.K[stack[-1]]] == k:
                        self._match[stack.pop()] = j
        return self._match.get(i, -1)

    def attempt(self, rule) -> bool:
        """Runs a rule; goes back to where it was when the rule fails."""
        i = self.i
        try:
            rule()  # called without unpacking, as only such calls nest on the heap
            return True
        except Fail:
            self.i = i
            return False

    # -- precedence climbing
    def binary(self, least: int = 0) -> None:
        self.unary()
        while True:
            k = self.K[self.i]
            p = self.BIN.get(k)
            if p is None or p[0] < least or self.stop(k):
                return
            self.i += 1
            self.operand(k, p[0] if p[1] else p[0] + 1)

    def stop(self, k: str) -> bool:
        return False

    def operand(self, op: str, least: int) -> None:
        self.binary(least)

    def unary(self) -> None:
        raise NotImplementedError

    # -- statements with recovery and memory
    def items(self, rule, what: str, end: frozenset[str]) -> None:
        """Statements until a kind in ``end``; errors are stored and the next statement is tried."""
        self.depth += 1  # a language may ask whether it is at the top
        try:
            self._items(rule, what, end)
        finally:
            self.depth -= 1

    def _items(self, rule, what: str, end: frozenset[str]) -> None:
        K, memo = self.K, self.memo
        while K[self.i] not in end:
            i = self.i
            if K[i] == "eof":
                return
            j = self.chunk_end(i)
            key = (what, *K[i:j]) if 0 < j - i <= MEMO_LEN else None
            if key is not None and self.BREAKS:
                # the chunk starts a line, as does what follows it
                key = (*key, *(n for n in range(1, j - i) if self.NL[i + n]))
            if key is not None and key in memo:
                self.i = j
                continue
            before = len(self.errors)
            try:
                while True:
                    s = self.i
                    rule()
                    if self.i == s:
                        self.fail(f"unexpected {K[s]}")
                    if key is None or self.i >= j or K[self.i] in end:
                        break
                if key is not None and self.i == j and len(self.errors) == before:
                    if len(memo) >= MEMO_MAX:
                        memo.clear()
                    memo[key] = True
            except Fail as e:
                self.errors.append((e.at, e.cause))
                self.recover(max(i, e.at), end)
                if self.i == i:
                    self.i += 1

    def chunk_end(self, i: int) -> int:
        """The token behind this line and the deeper or continuing lines below it, or -1 when ``i`` starts no line."""
        n = self.line_of.get(i)
        if n is None:
            return -1
        lines, K, cont = self.t.lines, self.K, self.CONT
        indent = lines[n][1]
        for m in range(n + 1, len(lines)):
            tok, ind = lines[m]
            if ind < indent or ind == indent and K[tok] not in cont:
                return tok
        return len(K) - 1

    SYNC: frozenset[str] = frozenset([";"])
    START: frozenset[str] = frozenset()

    def recover(self, i: int, end: frozenset[str]) -> None:
        """Panic mode: forward to behind a synchronising kind or to a line that starts a statement."""
        K = self.K
        while True:
            k = K[i]
            if k == "eof" or k in end and i > self.i:
                break
            if k in self.SYNC:
                i += 1
                break
            if i > self.i and k in self.START and i in self.line_of:
                break
            i += 1
        self.i = i

    def program(self) -> None:
        raise NotImplementedError

    def run(self) -> list[tuple[int, str]]:
        """All errors as (offset, cause), in the order of the text."""
        # each token opens at most a fixed number of rules, so the depth a file can need follows from its length; the
        # interpreter keeps the frames of these calls on the heap
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 20_000 + FRAMES * len(self.K)))
        try:
            self.program()
        except Fail as e:
            self.errors.append((e.at, e.cause))
        finally:
            sys.setrecursionlimit(limit)
        starts = self.t.starts
        return sorted({(starts[min(i, len(starts) - 1)], c) for i, c in self.errors})


def c_lines(toks: Tokens, text: str) -> None:
    """Fills ``lines``: the first token of each line with its indent, a tab counting as one."""
    lines, kinds, nl = toks.lines, toks.kinds, toks.nl
    rfind = text.rfind
    for i, s in enumerate(toks.starts):
        if nl[i] and kinds[i] != "eof":
            lines.append((i, s - rfind("\n", 0, s) - 1))
