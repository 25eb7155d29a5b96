"""Credential candidates in one text. Pure functions; the corpus side is in ``p6_secrets``."""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick


class Hit(NamedTuple):
    start: int  # where the credential begins
    end: int
    value: str  # as it stands, pieces joined
    kind: str
    structured: bool  # its form alone tells


# Words in the names of things that hold credentials.
_WORD = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|secret_?key|signing_?key|private_?key|auth_?key|encryption_?key|key_?value|credential|grant|bearer|auth(?:orization)?)"
_NAME = rf"[A-Za-z_$][\w$]*"
_LIT = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
_SENSITIVE = re.compile(rf"(?i){_WORD}|hook_?url_?key")
# parts of names that turn a credential's name into something else
_ABOUT = re.compile(r"(?i)rule|policy|hint|label|length|len$|(?<!ad)min|max|count|name$|url$|uri$|field|regex|pattern|hash|digest|sha|checksum|public|verify|type$|kind$|expir|ttl|format|prompt|placeholder|header_?name|path$|file$|id$|ids$|error|message|msg$|help|title|sample|example|fake|mock|dummy")

# Forms of well-known providers' credentials.
_PROVIDER = re.compile(
    r"""(?<![A-Za-z0-9])(?:
      (?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])
    | gh[pousr]_[A-Za-z0-9]{30,} | github_pat_\w{30,} | glpat-[\w\-]{20,}
    | xox[abeprs]-[0-9A-Za-z\-]{10,} | npm_[A-Za-z0-9]{30,} | [spr]k_live_[A-Za-z0-9]{16,}
    | AIza[\w\-]{35} | SG\.[\w\-]{16,}\.[\w\-]{16,} | dop_v1_[0-9a-f]{40,} | pypi-[\w\-]{40,} | hf_[A-Za-z0-9]{30,} | ya29\.[\w\-]{20,}
    | eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{10,}
    )""",
    re.X,
)
# a body runs to the next row of dashes, of whatever length; one that no end mark closes as far as its letters go
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:((?:[^-]|-(?!----))*+)-----END [A-Z0-9 ]*-----|([A-Za-z0-9+/=\s\\\"'`,;.]*+))")
# what may stand between the equals sign and the literal; a line break only behind an opening mark; possessive, so linear
_BEFORE = r"(?:[\w$.!?(,|&\[: \t]++|(?<=[=(,|&\[])\r?\n\s*+)*+"
_ASSIGN = re.compile(
    rf"""(?i)(?<![\w$.\-])(?P<name>{_NAME})(?:\s*\??:\s*&?(?:'static\s+)?[\w<>\[\]|. ]{{1,40}}?)?\s*(?::=|(?<![=!<>])=(?!=|>))\s*(?P<rhs>{_BEFORE}{_LIT}[^\n]*)"""
)
_ASSIGN_HEAD = re.compile(rf"(?i){_WORD}[\w$]*|env\w*|getenv|orElse|fetch")
_COMPARE = re.compile(rf"""(?i)(?:===?|!==?|\.equals\(|\.eql\?\s*\(?|,|\.compare\(|\.eq\()\s*(?P<lit>{_LIT})""")
_NAMED = re.compile(rf"(?i){_WORD}")
_COMPARE_REV = re.compile(rf"""(?i)(?P<lit>{_LIT})\s*(?:===?|!==?|\.equals\()\s*[\w.$]*(?:{_WORD})""")
_PAIR = re.compile(rf"""(?i)(?P<q>\\?["'])(?P<name>[\w\-]*(?:pass(?:word|wd)?|pwd|secret|token|api_?key)[\w\-]*)(?P=q)\s*(?::|=>)\s*(?P<q2>\\?["'])(?P<v>(?:(?!(?P=q2))[^\n\\])+)(?P=q2)""")
_FIELD = re.compile(r"""(?i)(?<![\w])(?:password|pwd|accountkey|sharedaccesskey|secret)=(?P<v>[^;"'\s`&]+)(?=[;"'`])""")
_URL = re.compile(r"""(?i)\b[a-z][a-z0-9+.\-]*://(?P<user>[^\s:/@"'`]*):(?P<v>[^\s/@"'`]+)@(?P<host>[^\s/"'`:?]+)""")
_QUERY = re.compile(rf"""(?i)[?&](?:[\w\-]*token|sig|signature|api_?key|apikey|key|secret|client_secret|password|passwd|auth)=(?P<v>[^\s&"'`#)>]+)""")
_HEADER = re.compile(r"""(?i)(?:authorization["']?\s*[:=]\s*["']?\s*|\b)(?P<scheme>Basic|Bearer|Token)\s+(?P<v>[A-Za-z0-9+/=_\-.~]{8,})""")
_CURL = re.compile(r"""(?i)\s(?:-u|--user)[ =]?["']?(?P<user>[\w.\-]+):(?P<v>[^"'\n]+)""")
_ENVLINE = re.compile(r"""\b(?P<name>[A-Za-z][A-Za-z0-9_]*+)=(?=[^\s"'`;])""")
_ENVNAME = re.compile(rf"(?i)[A-Z][A-Z0-9_]*(?:{_WORD}|_KEY)")
_ENVVALUE = re.compile(r"""[^\n"'`]*""")
_MAYBE_SENSITIVE = re.compile(rf"(?i){_WORD}|_key\b|_pw\b")
_SPOKEN = re.compile(rf"""(?ix)(?:
      \b(?:login|credentials?|account)\s+(?:is|are|was)\s+[\w.\-]+\s*/
    | \b(?:works?|use[ds]?|log(?:s|ged)?\s?in|sign(?:s|ed)?\s?in|call(?:s|ed)?)\s+(?:it\s+)?with\s+(?:the\s+)?(?:\w+\s+)?(?:key|token|password|pw|pass|secret)
    | \b(?:old|new|temp(?:orary)?|current|prod|staging|root|admin)\s+(?:token|key|password|pw|secret)\b[^:\n]{{0,40}}:
    | \blogin:\s*(?:token|key|password|passwd|pw|pass|secret)
    | \b(?:password|passwd|pw|token|secret|api\s?key)\s+(?:is|was)\b:?
    )[ \t]*(?P<v>[^\s"'`][^\n"'`]*)""")
_STRINGS = re.compile(_LIT)
_B64 = re.compile(r"^[A-Za-z0-9+/_\-]{8,}={0,2}$")
_UNWRAP = re.compile(r"(?i)atob|b64|base64|decode|unwrap|frombase")
_LOOKUP = re.compile(r"(?i)env\b|environ|getenv|env\w*\(|orelse|\.get\(|fetch\(|process\.env|config|\?\?|\|\|")

# What stands in for a credential in templates, documents and tests.
_PLACEHOLDER = re.compile(
    r"""(?ix)\$\{ | \{\{ | %\(|(?-i:%s)(?![A-Za-z0-9]) | ^<.*>$ | <[\w\- ]+> | ^\$[A-Z_]+ | ^%[A-Z_]+%$ | ^\#\{ | change[\s_\-]?(?:me|it|this) | example | placeholder | your[\s_\-] | ^your | redact | ^\[.*\]$
    | x{4,} | \*{3,} | \.{3,} | ^(?:todo|tbd|fixme|none|null|nil|undefined|true|false|n/?a)\b | vault | keychain | secrets?[_\-\s]?manager | ^ref: | ^env: | ^arn: | ^file: | ^/[\w/.\-]+$
    | dummy | ^fake | ^mock | ^sample | ^test(?:ing)?[_\-]? | ^foo | ^bar$ | insert[\s_\-] | replace[\s_\-] | ^set[\s_\-] | set-me | ^secret:? | ^password:?\b | ^passwd$ | ^pass$ | ^token:?\b | ^key$ | ^user(?:name)?$ | ^admin$ | ^string$ | ^bearer$
    | ^(?:at\sleast|must|should|enter|please|invalid|missing|wrong|the|a|an|no|not|is|too)\b"""
)
_NO_HOST = re.compile(r"(?i)example|placeholder|^your|[<{$%*]|^host(?:name)?$")
_FUNCTION_WORDS = frozenset("the a an is are was must not be at least of to in for and or with see this that from on by it as do no page word lives".split())


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values()) if n else 0.0


def placeholder(v: str) -> bool:
    return bool(_PLACEHOLDER.search(v)) or len(set(v)) <= 3


def plausible(v: str) -> bool:
    """Whether a value in a credential's place could be one: long enough, no stand-in, no prose, no name to look up."""
    if len(v) < 8 or placeholder(v):
        return False
    words = v.split()
    if len(words) > 1:
        # passphrases are several plain words; two words or function words are text
        return 4 <= len(words) <= 8 and all(re.fullmatch(r"[A-Za-z0-9'\-]+", w) for w in words) and not any(w.lower() in _FUNCTION_WORDS for w in words)
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[\-_.][a-z]+)+|[a-z]+(?:[A-Z][a-z]+)+", v) and not re.search(r"\d", v):
        return len(re.split(r"[\-_.]", v)) >= 4
    if re.fullmatch(r"[a-z]+|[A-Z]+|[A-Z][a-z]+", v):
        return len(v) >= 16
    if re.fullmatch(r"[\d.,:\-/ ]+", v) or re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", v):
        return False
    return not re.match(r"(?i)https?://", v)


def _body(lit: str) -> str:
    return lit[1:-1]


def _decoded(v: str) -> str | None:
    if not _B64.match(v):
        return None
    try:
        raw = base64.b64decode(v.replace("-", "+").replace("_", "/") + "=" * (-len(v) % 4))
        t = raw.decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return t if t.isprintable() else None


_CUT = re.compile(r"\s+(?:on|at|for|from|until|till)\s+\S+\.?.*$|\s*(?:\*/|-->).*$|\s*[)\]}]?\s*$")


def _spoken_value(v: str) -> str:
    """The value of a comment's credential: one word, or a passphrase up to where the sentence goes on."""
    v = re.sub(r"\s+(?:on|at|for|from|until|till|in)\s+[\w.\-]+\.?.*$", "", v)
    v = re.sub(r"\s*(?:\*/|-->).*$", "", v).rstrip().rstrip(",;")
    words = v.split()
    if len(words) > 1 and not (len(words) >= 4 and all(w.isalpha() and w.islower() for w in words)):
        v = words[0]
    return v.rstrip(".,;") if len(v) > 1 else v


def _name_before(text: str, i: int) -> str:
    """The name, or the name of the call without arguments, that ends before ``i``."""
    while i > 0 and text[i - 1].isspace():
        i -= 1
    if text.endswith("()", 0, i):
        i -= 2
    j = i
    while j > 0 and (text[j - 1].isalnum() or text[j - 1] in "_$"):
        j -= 1
    return text[j:i]


def candidates(text: str) -> list[Hit]:
    """All places that look like a credential, each once; stand-ins are left out."""
    hits: dict[int, Hit] = {}

    def add(start: int, end: int, value: str, kind: str, structured: bool) -> None:
        old = hits.get(start)
        if old is None or structured and not old.structured or len(value) > len(old.value):
            hits[start] = Hit(start, end, value, kind, structured)

    for m in _PEM.finditer(text):
        body = re.sub(r"[^A-Za-z0-9+/=]", "", (m.group(1) or m.group(2) or "").replace("\\n", ""))
        if len(body) >= 40 and not placeholder(body[:60]):
            add(m.start(), m.end(), body, "private key", True)
    pems = [(h.start, h.end) for h in hits.values()]
    low = text.lower()
    for m in _PROVIDER.finditer(text):
        v = m.group()
        if not placeholder(v) and entropy(v) > 2.8:
            add(m.start(), m.end(), v, "provider", True)
    if any(w in low for w in ("pass", "pwd", "secret", "token", "key", "grant", "cred", "auth", "bearer", "login", "env")):
        for m in _ASSIGN.finditer(text):
            name, rhs = m.group("name"), m.group("rhs")
            named = _SENSITIVE.search(name) and not _ABOUT.search(re.sub(r"(?i)_?(?:b64|base64|parts?|raw|value)\d*$|\d+$", "", name))
            if not named and sum(map(rhs.count, "\"'`")) < 4 and not _MAYBE_SENSITIVE.search(rhs):
                continue
            lits = list(_STRINGS.finditer(rhs))
            if not lits:
                continue
            at = m.start("rhs")
            lookup = _LOOKUP.search(rhs[: lits[0].start()]) or len(lits) > 1 and _LOOKUP.search(rhs[: lits[-1].start()])
            if lookup and not re.search(r"\+|concat", _STRINGS.sub("", rhs)):
                env = rhs[: lits[-1].start()]
                if not (named or _SENSITIVE.search(env) or re.search(r"(?i)_key\b|_pw\b", env)):
                    continue
                last = lits[-1]
                if "(" in env and not re.search(r"\?\?|\|\|", env) and len(lits) < 2:
                    continue
                v = _body(last.group())
                if plausible(v):
                    add(at + last.start() + 1, at + last.end() - 1, v, "default", False)
                continue
            # pieces that follow each other with + or commas of a joining call are one literal
            joined, end = _body(lits[0].group()), lits[0].end()
            n = 1
            for x in lits[1:]:
                between = rhs[end : x.start()].strip()
                if between == "+" or between == "" or between == "," and re.match(r"(?i)\s*(?:concat!?|join|\[)", rhs):
                    joined += _body(x.group())
                    end = x.end()
                    n += 1
                else:
                    break
            v = joined
            if n > 1:
                whole = _PROVIDER.fullmatch(v)
                if (named or whole) and (whole or plausible(v)) and not placeholder(v):
                    add(at + lits[0].start() + 1, at + end - 1, v, "joined", bool(whole))
                continue
            if not named:
                continue
            if _UNWRAP.search(rhs[: lits[0].start()]) or re.search(r"(?i)b64|base64|wrapped|encoded", name):
                d = _decoded(v)
                if d is not None and len(d) >= 6 and not placeholder(d):
                    add(at + lits[0].start() + 1, at + end - 1, v, "encoded", False)
                    continue
            if plausible(v) and "://" not in v and not re.match(r"(?i)basic |bearer ", v):
                add(at + lits[0].start() + 1, at + end - 1, v, "assigned", False)
        for m in [m for m in _COMPARE.finditer(text) if _NAMED.search(_name_before(text, m.start()))] + list(_COMPARE_REV.finditer(text)):
            v = _body(m.group("lit"))
            if plausible(v):
                add(m.start("lit") + 1, m.end("lit") - 1, v, "compared", False)
        for m in _PAIR.finditer(text):
            if plausible(m.group("v")) and not _ABOUT.search(m.group("name")):
                add(m.start("v"), m.end("v"), m.group("v"), "pair", False)
        for m in _FIELD.finditer(text) if any(w in low for w in ("password=", "pwd=", "key=", "secret=")) else ():
            if plausible(m.group("v")):
                add(m.start("v"), m.end("v"), m.group("v"), "field", False)
        for m in _SPOKEN.finditer(text):
            v = _spoken_value(m.group("v"))
            if plausible(v):
                add(m.start("v"), m.start("v") + len(v), v, "comment", False)
        for m in _ENVLINE.finditer(text):
            if not _ENVNAME.match(m.group("name")):
                continue
            v = _spoken_value(_ENVVALUE.match(text, m.end()).group())
            if plausible(v) and not _ABOUT.search(m.group("name").replace("KEY", "")):
                add(m.end(), m.end() + len(v), v, "comment", False)
    if "://" in text:
        for m in _URL.finditer(text):
            v = m.group("v")
            if plausible(v) and not _NO_HOST.search(m.group("host")):
                add(m.start("v"), m.end("v"), v, "address", False)
        for m in _QUERY.finditer(text):
            v = m.group("v")
            if plausible(v) and re.search(r"\d", v) or plausible(v) and len(v) >= 20:
                add(m.start("v"), m.end("v"), v, "address", False)
    if "basic " in low or "bearer " in low or "token " in low:
        for m in _HEADER.finditer(text):
            v, scheme = m.group("v"), m.group("scheme").lower()
            if scheme == "basic":
                d = _decoded(v)
                if d and ":" in d and len(d.partition(":")[2]) >= 4 and not placeholder(d.partition(":")[2]):
                    add(m.start("v"), m.end("v"), v, "header", False)
            elif "uthorization" in m.group() and plausible(v):
                add(m.start("v"), m.end("v"), v, "header", False)
    if "curl" in low:
        for m in _CURL.finditer(text):
            v = _spoken_value(m.group("v"))
            if plausible(v):
                add(m.start("v"), m.start("v") + len(v), v, "comment", False)
    out: list[Hit] = []
    for h in sorted(hits.values()):
        if any(a < h.start < b for a, b in pems):
            continue
        # one inside another is the same credential
        if out and h.start < out[-1].end:
            if h.structured and not out[-1].structured and out[-1].kind not in ("joined",):
                out[-1] = h
            continue
        out.append(h)
    return out


def blank(text: str, spans: list[tuple[int, int]], mark: str = "[REDACTED]") -> str:
    """The text with the spans replaced; line breaks inside a span stay, so that line numbers hold."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark, "\n" * text.count("\n", a, b)]
        at = b
    return "".join([*out, text[at:]])


_RUN = re.compile(r"[A-Za-z0-9]{4,}")


def anchor(value: str) -> str | None:
    """The longest run of letters and digits, by which the texts that may hold the value are looked up."""
    return max(_RUN.findall(value), key=len, default=None)


def scanner(values: set[str]) -> Callable[[str], list[tuple[int, int]]]:
    """A function that tells where a text holds any of the values, none as a part of a longer word: one automaton, one pass a text."""
    trie = ahocorasick.Automaton()
    for v in values:
        if v:
            trie.add_word(v, len(v))
    if not len(trie):
        return lambda text: []
    trie.make_automaton()

    def scan(text: str) -> list[tuple[int, int]]:
        out = set()
        for last, n in trie.iter(text):
            at, end = last - n + 1, last + 1
            if not _WORDLIKE.match(text[max(0, at - 1) : at]) and not _WORDLIKE.match(text[end : end + 1]):
                out.add((at, end))
        return sorted(out)

    return scan


_WORDLIKE = re.compile(r"[A-Za-z0-9]")
