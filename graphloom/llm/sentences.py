"""Sentences of one text. Pure functions; the corpus side is in ``p9_sentences``.

A text is cut into blocks (paragraphs, headings, list items; lines in chats). In a block every mark
that can end a sentence is judged: by what stands around it, by what the rest of the document shows
unambiguously about the word before it (is it an abbreviation?) and the word behind it (does it start
sentences, is it a name?), and by the corpus where the document is silent.
"""

from __future__ import annotations

import re
from collections import defaultdict

# Abbreviations that stand before something and so never end a sentence.
TITLES = frozenset("dr mr mrs ms prof st fr hr sra dra dña srta mme mlle mgr fa rev gen sgt capt col lt gov hon pres".split())
NEVER = frozenset(
    """e.g i.e cf vs viz approx est fig figs eq sec ch vol vols pp ed eds dept ave no nos nr art ref op jan feb apr jun
    jul aug sept sep oct nov dec mon tue tues wed thu thur thurs fri sat sun
    z.b d.h u.a vgl bzw ca ggf evtl inkl exkl max min abschn kap bd abb tab hrsg str sog bsp geb gest std tel zzgl
    ud uds pág págs pag núm num ej ee av avda cap p.ej
    chap c.-à-d p.ex éd env boul
    см рис стр напр тыс млн млрд им ул проф гл пер табл ср
    डॉ श्री पं د م أ ص""".split()
)
# Abbreviations that may also stand at the end of a sentence.
MAYBE = frozenset("etc inc ltd co corp jr sr al a.m p.m u.s u.k u.n e.u usw ff suiv uu др пр sq bros et.al approx.sq".split())
# Abbreviations of one letter that may end a sentence when a capital follows.
MAYBE_LETTER = frozenset("m д п г h".split())
# After these a German ordinal such as "3." follows.
ORDINAL_BEFORE = frozenset("am im der die das dem den des vom zum beim ab bis seit jeder jedem".split())

_OPEN = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›"}
_CLOSERS = frozenset("”»」』’)）]】》›\"“")
_BRACKETS = frozenset("(（[【")
_WIDE = frozenset("。！？｡．")
_TERM = re.compile(r"[.!?…。！？｡।॥؟۔‼⁇⁈⁉]+")
_BLOCK_HEAD = re.compile(r"[^\S\n]*#{1,6}[^\S\n]+")
_BULLET = re.compile(r"[^\S\n]*[-*+•‣][^\S\n]+")
_NUMBER = re.compile(r"[^\S\n]*\d{1,3}[.)][^\S\n]+")
_WORD = re.compile(r"[^\W_][\w'’\-]*", re.UNICODE)
_ASCII = re.compile(r"[A-Za-z0-9][A-Za-z0-9_'’\-]*")
_CODELIKE = re.compile(r"[^\s,;:!?()\[\]\"“”«»]*[A-Za-z][^\s,;:!?()\[\]\"“”«»]*")
_NOSPACE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))
# scripts that end a sentence with a danda, so that a full stop only abbreviates
_BRAHMIC = re.compile(r"[\u0900-\u0dff]")


def blocks(text: str, chat: bool) -> list[tuple[int, int]]:
    """Offsets of paragraphs, headings and list items without their marks; of lines in a chat."""
    out: list[tuple[int, int]] = []
    start = -1
    kind = ""
    pos, n = 0, len(text)
    text_n = text
    while pos < n:
        e = text_n.find("\n", pos)
        end = n if e < 0 else e
        line = text_n[pos:end]
        if not line or line.isspace():
            if start >= 0:
                out.append((start, pos))
            start, kind = -1, ""
        elif chat:
            out.append((pos, end))
        elif m := _BLOCK_HEAD.match(text_n, pos, end):
            if start >= 0:
                out.append((start, pos))
            out.append((m.end(), end))
            start, kind = -1, "head"
        elif (m := _BULLET.match(text_n, pos, end)) or kind != "text" and (m := _NUMBER.match(text_n, pos, end)):
            if start >= 0:
                out.append((start, pos))
            start, kind = m.end(), "item"
        elif start < 0:
            start, kind = pos, "text"
        pos = end + 1
    if start >= 0:
        out.append((start, n))
    return out


def _script(c: str) -> str:
    """'l' and 'u' for cased letters, 'd' digit, 'w' scripts without spaces, 'c' other letters, '' else."""
    if c.isdigit():
        return "d"
    if c.isalpha():
        if c.islower():
            return "l"
        if c.isupper() or c.istitle():
            return "u"
        o = ord(c)
        if 0x2E80 <= o <= 0x9FFF or 0x3040 <= o <= 0x30FF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
            return "w"
        return "c"
    return ""


def _pairs(text: str, a: int, b: int) -> dict[int, int]:
    """Openers in [a, b) with their closers; openers that never close are left out."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    i = a
    while i < b:
        c = text[i]
        if c == '"':
            prev = text[i - 1] if i > a else " "
            j = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1)
            if j >= 0:
                out[stack[j][1]] = i
                del stack[j:]
            elif not prev.isalnum() or _script(prev) in "wc":
                stack.append(('"', i))
        elif stack and c == stack[-1][0] and not (c == "’" and i + 1 < b and text[i + 1].isalpha() and text[i - 1].isalpha()):
            out[stack.pop()[1]] = i
        elif c in _OPEN and not (c == "“" and stack and stack[-1][0] == "“"):
            stack.append((_OPEN[c], i))
        elif c in ")）]】»”」』" and any(s[0] == c for s in stack):
            while stack[-1][0] != c:
                stack.pop()
            out[stack.pop()[1]] = i
        i += 1
    return out


def next_word(text: str, i: int, b: int) -> str:
    """The run of non-space characters at ``i``, without marks at its end."""
    j = i
    while j < b and not text[j].isspace() and text[j] not in "。！？，、；：":
        j += 1
    return text[i:j].rstrip(".,;:!?)”»\"’")


def start_key(text: str, i: int, b: int) -> str:
    """What is known about sentence starts is kept by the first word, or two characters of scripts without spaces."""
    if i >= b:
        return ""
    if _script(text[i]) == "w":
        return text[i : i + 2]
    m = (_ASCII if text[i].isascii() else _WORD).match(text, i, b)
    return m.group() if m else ""


def plain_lower(w: str) -> bool:
    """A lower-case word of ordinary writing rather than a name from code."""
    return bool(w) and w.isalpha() and w.islower() or bool(re.fullmatch(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", w)) and w.islower()


def token_before(text: str, a: int, i: int) -> tuple[str, int]:
    """The run of non-space characters before ``i`` without leading marks, and where it starts."""
    j = i
    while j > a and not text[j - 1].isspace() and text[j - 1] not in "([{«“\"„‘（「,;:/=":
        j -= 1
    return text[j:i], j


def evidence(text: str, chat: bool) -> dict[str, list[int]]:
    """What the text shows unambiguously, by a letter and a word: ('A', word) -> [as abbreviation, as a sentence's last word],
    ('S', key) -> [at the start of a block or behind a wide mark, inside],
    ('P', word) -> [with a capital within a sentence, in lower case], ('T', word with a capital) -> [its full stop before a capital word that is
    never in lower case, before one that is]. What stands before a name is no evidence that it
    ends a sentence."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    if chat:
        return out
    named, small = _names(text)
    for w, n in named.items():
        out["P" + w][0] += n
        out["P" + w][1] += small.get(w.lower(), 0)
    for a, b in blocks(text, chat):
        i = a
        while i < b and (text[i].isspace() or text[i] in _OPEN or text[i] in "\"¿¡"):
            i += 1
        k = start_key(text, i, b)
        if k:
            out["S" + k][0] += 1
        held = _pairs(text, a, b) if any(c in text[a:b] for c in _WIDE) else {}
        for m in _TERM.finditer(text, a, b):
            s, e = m.span()
            if text[s] in _WIDE:
                k = start_key(text, e, b)
                if k and not any(o < s < c for o, c in held.items()):
                    out["S" + k][0] += 1
                continue
            if m.group() in ("…", "……", "...") and e < b:
                j = e
                while j < b and text[j].isspace():
                    j += 1
                if k := start_key(text, j, b):
                    out["S" + k]  # no evidence, but a word the corpus is to be asked about
                continue
            if text[s] != "." or e - s != 1 or e >= b:
                continue
            t, at = token_before(text, a, s)
            if not t or not t.replace(".", "").replace("-", "").isalpha() or len(t) < 2:
                if t and text[e].isspace():
                    j = e
                    while j < b and text[j].isspace():
                        j += 1
                    w = next_word(text, j, b)
                    if plain_lower(w):
                        out["S" + w]  # as above
                continue
            key = "A" + t.lower()
            if text[e] in ",;:":
                out[key][0] += 1
                continue
            if not text[e].isspace():
                continue
            j = e
            while j < b and text[j].isspace():
                j += 1
            if j >= b:
                out[key][1] += 1
                continue
            w = next_word(text, j, b)
            if plain_lower(w):
                out[key][0] += 1
                out["S" + w][1] += 1
            elif _script(text[j]) == "d":
                out[key][0] += 1
            else:
                p = _script(text[j]) == "u" and _WORD.match(text, j, b)
                if p:
                    # a word that is never in lower case here may be a name behind a title
                    if t[0].isupper() and _word_before(text, a, at).islower():
                        out["T" + t][p.group().lower() in small] += 1
                    if p.group() not in named:
                        out["P" + p.group()][1] = small.get(p.group().lower(), 0)
                    elif named[p.group()] > small.get(p.group().lower(), 0):
                        continue
                out[key][1] += 1
    return out


def _names(text: str) -> tuple[dict[str, int], dict[str, int]]:
    """Words with a capital behind a plain lower-case word, and the words in lower case, with their counts."""
    named: dict[str, int] = {}
    small: dict[str, int] = {}
    before = False
    for t in text.split():
        w = t.rstrip(".,;:!?)”»\"’")
        if before and w[:1].isupper() and not w.isupper() and (m := _WORD.match(w)):
            named[m.group()] = named.get(m.group(), 0) + 1
        low = w.islower()
        if low:
            small[w] = small.get(w, 0) + 1
        before = low and t.isalpha()
    return named, small


def looks_like_chat(text: str) -> bool:
    """Several short lines without a blank one between them, none of which ends or holds a sentence mark."""
    t = text.strip()
    if "\n" not in t or _THAI.search(t) or re.search(r"\n\s*\n|^\s*(?:#|[-*+•]|\d+[.)])\s", t, re.M):
        return False
    return not re.search(r"[.!?。！？।؟][\"”’»」』)]?(?:\s|$)|[。！？।]", t)


_THAI = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")


class Judge:
    """Decides on marks with the document's own evidence first and the corpus's behind it."""

    def __init__(self, own: dict[str, tuple[int, int]], corpus: frozenset[str], small: frozenset[str] = frozenset()):
        self.own, self.corpus, self.small = own, corpus, small

    def abbreviation(self, word: str) -> bool | None:
        """Whether the word is an abbreviation by what follows it: in the document, where it shows enough, else in the corpus; None where both are silent."""
        yes, no = self.own.get("A" + word, (0, 0))
        if yes + no >= 3 and (yes > 2 * no or no > 2 * yes):
            return yes > no
        if "A" + word in self.corpus:
            return True
        return False if "N" + word in self.corpus else None

    def title(self, word: str) -> bool:
        """Whether names follow the word's full stop, in the corpus."""
        return "T" + word in self.corpus

    def final(self, word: str) -> bool:
        """Words that were seen to end sentences, and runs that are no plain word."""
        yes, no = self.own.get("A" + word, (0, 0))
        return not word.isalpha() or no > 2 * yes or "N" + word in self.corpus

    def name(self, word: str) -> bool:
        """Words that have their capital within sentences too."""
        yes, small = self.own.get("P" + word, (0, 0))
        if yes or small:
            return yes > small
        return "P" + word in self.corpus

    def common(self, word: str) -> bool:
        """Whether a capital word is an ordinary one: in lower case elsewhere in the document, or known to start sentences."""
        return word.lower() in self.small or self.starts(word)

    def starts(self, key: str) -> bool:
        yes, inside = self.own.get("S" + key, (0, 0))
        if yes > inside:
            return True
        return "S" + key in self.corpus


def sentences(text: str, chat: bool, corpus: frozenset[str] = frozenset(), own: dict | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points, in order, without white space around them. ``own`` is the text's evidence, if it is at hand."""
    out: list[tuple[int, int]] = []
    if own is None:
        own = evidence(text, chat)
    small = frozenset() if chat or not any(w[0] == "T" for w in corpus) else frozenset(w.rstrip(".,;:!?)”»\"’") for w in text.split() if w[:1].islower())
    judge = Judge({} if chat else own, corpus, small)
    for a, b in blocks(text, chat):
        cuts = [] if chat else _cuts(text, a, b, judge)
        for s, e in zip([a, *cuts], [*cuts, b]):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def _cuts(text: str, a: int, b: int, judge: Judge) -> list[int]:
    while b > a and text[b - 1].isspace():
        b -= 1
    while a < b and text[a].isspace():
        a += 1
    pairs = _pairs(text, a, b)
    closes = {v: k for k, v in pairs.items()}
    spans = sorted(pairs.items())
    cuts: list[int] = []
    start, i, depth_end = a, a, -1
    marks = sorted([(m.start(), m.end()) for m in _TERM.finditer(text, a, b)] + _spaces(text, a, b))
    outer: list[tuple[int, int]] = []  # pairs that lie in no other
    for o, c in spans:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    oi = 0
    for s, e in marks:
        if s < start:
            continue
        while oi < len(outer) and outer[oi][1] < s:
            oi += 1
        inside = outer[oi] if oi < len(outer) and outer[oi][0] < s < outer[oi][1] else None
        if text[s].isspace():  # a space that parts two sentences of a script without marks
            if inside is None:
                cuts.append(s)
                start = s + 1
            continue
        if inside is not None:
            o, c = inside
            # only a mark directly before the closer can end what holds the quotation
            if text[e:c].strip() and not all(x in _CLOSERS for x in text[e:c].strip()):
                continue
            end = c + 1
            while end < b and text[end] in _CLOSERS and end in closes and closes[end] >= start:
                end += 1
            if _ends_behind_pair(text, start, o, c, end, b, judge):
                cuts.append(end)
                start = end
            continue
        end = e
        while end < b and (end in closes or text[end] in "”’»」』）" and end not in pairs):
            end += 1
        if _ends(text, a, start, s, e, end, b, judge):
            cuts.append(end)
            start = end
    return [c for c in cuts if c < b]


def _spaces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """White space between two letters of a script that parts sentences by spaces (Thai, Lao, Burmese, Khmer)."""
    out = []
    for m in re.finditer(r"(?<=[฀-໿က-႟ក-៿])\s+(?=[฀-໿က-႟ក-៿])", text[a:b]):
        out.append((a + m.start(), a + m.end()))
    return out


def _ends_behind_pair(text: str, start: int, o: int, c: int, end: int, b: int, judge: Judge) -> bool:
    """Whether a sentence ends at ``end``, behind a pair whose content ends with a mark."""
    first = not text[start:o].strip()
    if text[o] in _BRACKETS:
        return first
    if end >= b:
        return True
    before = text[start:o].rstrip()
    colon = before[-1:] in (":", "：")
    spaced = text[end].isspace()
    j = end
    while j < b and text[j].isspace():
        j += 1
    if j >= b:
        return True
    ch = text[j]
    if ch in ",;:，、；：—–-‐―":
        return False
    k = _script(ch)
    if not spaced:
        if k in ("w", "c"):
            return colon
        return colon and (k in ("u", "d", "l") or ch in _OPEN)
    if k == "l":
        w = next_word(text, j, b)
        return not plain_lower(w) or judge.starts(start_key(text, j, b))
    if k == "c" or k == "w":
        return colon or not first and k == "w"
    return True


def _ends(text: str, a: int, start: int, s: int, e: int, end: int, b: int, judge: Judge) -> bool:
    """Whether the marks [s, e), outside of any pair, end a sentence."""
    if end >= b:
        return True
    run = text[s:e]
    nxt = text[end]
    if any(c in _WIDE for c in run):
        return True
    if nxt in ",;:，；：、":
        return False
    spaced = nxt.isspace()
    j = end
    while j < b and text[j].isspace():
        j += 1
    ch = text[j]
    k = _script(ch)
    if run.strip("…") == "" or run.strip(".") == "" and len(run) > 1:
        if not text[start:s].strip():
            return False
        if k in ("w", "c", "l"):
            w = next_word(text, j, b)
            if k == "l" and not plain_lower(w) and spaced:
                return True
            return judge.starts(start_key(text, j, b))
        if not spaced:
            return k == "u" and judge.starts(start_key(text, j, b)) or ch in _OPEN
        return ch not in ",;:"
    if any(c in "।॥؟۔" for c in run):
        return spaced or k != ""
    if not spaced:
        return False
    if run != ".":
        return ch not in "—–"
    # a single full stop
    t, at = token_before(text, a, s)
    if not t:
        return False
    low = t.lower()
    w = next_word(text, j, b)
    if len(t) > 1 and not t.isdigit():
        # evidence first: the lists below are asked where it is silent or leaves the choice open
        known = judge.abbreviation(low)
        if known and (k == "d" and low not in MAYBE or k == "l" and plain_lower(w) and not judge.starts(start_key(text, j, b))):
            return False
        # a word that opens the sentence may also be all of it ("No.")
        if k == "u" and at != _skip_open(text, start) and (m := _WORD.match(text, j, b)):
            if judge.title(t) and not judge.common(m.group()):
                return False
            if known and low not in MAYBE and judge.name(m.group()):
                return False
    lower = k == "l" and plain_lower(w) and not text.startswith(".", j + len(w))
    starter = judge.starts(start_key(text, j, b))
    if t.isdigit():
        if len(t) <= 2 and _word_before(text, a, at).lower() in ORDINAL_BEFORE and k in ("u", "l"):
            return False
        return not lower or starter
    if len(t) == 1 and t.isalpha():
        if _script(t) == "c" and t not in NEVER:
            return True
        before = _word_before(text, a, at)
        if t.isupper() and re.fullmatch(r"[\d.,]*\d", before):
            return not lower or starter
        if k == "u" and low in MAYBE_LETTER and not t.isupper() and before.endswith("."):
            return not (len(w) > 1 and w.isupper())
        if k == "u" and low == "г":
            return True
        return False
    if low in TITLES and t[0].isupper():
        return False
    if _BRAHMIC.match(t[-1]):
        return False
    if low in NEVER:
        if low in ("no", "nos") and t[0].isupper() and at == _skip_open(text, start):
            return True
        if low in ("no", "max", "min", "est", "art", "cap", "sun", "sat", "mon", "dec", "mar", "tab", "gen", "ch", "op", "d", "col") and k == "u" and t.islower():
            return True
        return False
    if low in MAYBE:
        if lower and not starter or k == "d" and low not in ("etc", "usw", "inc", "ltd", "corp", "a.m", "p.m"):
            return False
        if k == "u" and len(w) > 1 and w.isupper() and w.isalpha():
            return False
        if low in ("jr", "sr") and at == _skip_open(text, start):
            return False
        if low == "sr" and k == "u":
            return False
        if low == "al":
            return False
        return True
    if "." in t and t.replace(".", "").isalpha() and all(len(x) == 1 for x in t.split(".")):
        return k == "u" and not lower
    return not lower or starter or judge.final(low)


def _skip_open(text: str, i: int) -> int:
    while i < len(text) and (text[i].isspace() or text[i] in _OPEN or text[i] in "\"¿¡"):
        i += 1
    return i


def _word_before(text: str, a: int, i: int) -> str:
    j = i
    while j > a and text[j - 1].isspace():
        j -= 1
    k = j
    while k > a and not text[k - 1].isspace():
        k -= 1
    return text[k:j]
