"""Features of one source file that tell whether somebody wrote it by hand for its repository."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

# Directories that hold other people's code, or a tool's.
FOREIGN_DIRS = frozenset(
    """node_modules bower_components jspm_packages pods carthage third_party third-party thirdparty 3rdparty 3rd_party
    vendor vendored _vendor external externals extern site-packages dist-packages deps godeps submodules contrib_vendor""".split()
)
TOOL_DIRS = frozenset("gen src-gen gen-src generated __generated__ _generated autogen auto_generated codegen-out generated-sources generated-src".split())
BUILD_DIRS = frozenset("dist build out target public assets static min bundle bundles".split())

# What tools and copied files say of themselves, in several languages.
TOOL_NOTICE = re.compile(
    r"""code\s+generated\s+by|\bauto-?\s?generated\b|@generated\b|<auto-generated|\bmachine[\s-](?:written|generated|made)\b
    |\bgenerated\s+(?:by|from|with|using|automatically|file|code)\b|\b(?-i:DO\s+NOT\s+(?:EDIT|MODIFY|CHANGE))\b|\bdo\s+not\s+(?:edit|modify|change)(?:\s+this\b|\s+manually|\s+by\s+hand|\s*[.;:!]|\s*$)|\b(?:was|is)\s+(?:produced|emitted|generated|created)\s+(?:automatically\s+)?by\b
    |\bemitted\s+from\b|local\s+changes\s+will\s+be\s+(?:lost|overwritten)|source\s+of\s+truth\s+is
    |automatisch\s+(?:erzeugt|generiert|erstellt)|nicht\s+(?:von\s+hand|manuell)\s+(?:bearbeiten|ändern)
    |fichier\s+(?:produit|généré)|généré\s+(?:par|automatiquement)|ne\s+pas\s+(?:modifier|éditer)
    |generado\s+(?:por|automáticamente)|no\s+(?:editar|modificar)|gerado\s+(?:por|automaticamente)|não\s+editar
    |сгенерирован|создан\s+автоматически|не\s+редактир|自動生成|自动生成|編集しないで|请勿(?:编辑|修改)|자동\s*생성|수정하지\s*마""",
    re.I | re.X,
)
# the part of it that is a notice wherever a comment line says it
STRONG_NOTICE = re.compile(
    r"""^\W{0,4}(?:code\s+generated\s+by\s+\S|(?:end\s+of\s+file,\s*)?(?:@generated\b|<auto-generated|autogenerated\s+file|this\s+file\s+(?:was|is)\s+(?:produced|generated|emitted)\s+by|machine\s+written,
    |do\s+not\s+(?:edit|modify)\s*:|automatisch\s+(?:erzeugt|generiert)\s+von|fichier\s+(?:produit|généré)\s+par|このファイルは.{0,40}自動生成))""",
    re.I | re.X,
)
STRONG_COPY = re.compile(r"^\W{0,4}?(?:!\s+\S+\s+v\d[\w.]*\s*\||this\s+file\s+is\s+part\s+of\s+\w+\.|upstream\s*:\s*https?://|copied\s+verbatim\b|licensed\s+to\s+.{1,60}contributors;?\s+redistributed)", re.I)
_COMMENT_LINE = re.compile(r"^[ \t]*(?://+!?|#+|/?\*+)[ \t]*(\S[^\n]*)", re.M)

HAND_NOTICE = re.compile(
    r"""not\s+generated|edit\s+freely|maintained\s+by\s+hand|kept\s+up\s+by\s+hand|hand[\s-](?:written|maintained|edited)|our\s+own\s+code|originally\s+(?:scaffolded|generated)
    |scaffolded\s+by|(?:writes?|prints?|adds?|emits?|inserts?|checks?|looks?\s+for|strips?|detects?|parses?|generates?)\s+(?:the|a|an|any|our)\b|safe\s+to\s+edit|no\s+longer\s+generated""",
    re.I | re.X,
)
COPIED_NOTICE = re.compile(
    r"""\bupstream\s*:|\bcopied\s+(?:verbatim|from|unchanged)|\bredistributed\s+(?:unchanged|with)|\bvendored\s+(?:from|copy|at)|\bthis\s+file\s+is\s+part\s+of\s+\S
    |\blicensed\s+to\s+.{1,60}\bcontributors\b|^\s*!\s+\S+\s+v?\d[\w.\-]*\s*\||\bimported\s+from\s+https?:|\bsynced?\s+(?:with|from)\s+(?:upstream|https?:)|\bborrowed\s+from\b|\bsource\s*:\s*https?://""",
    re.I | re.X | re.M,
)
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright)[\s(c)©]*(?:\d{4}(?:\s*[-–,]\s*\d{4})*,?)?\s*(?:by\s+)?(?:the\s+)?([A-Z][\w&.\-]*(?:\s+(?:[A-Z][\w&.\-]*|and|of|the))*)", re.I)
OWN_NOTICE = re.compile(r"\binternal\b|\bproprietary\b|\bconfidential\b|all\s+rights\s+reserved", re.I)

_IDENT = re.compile(r"[^\W\d][\w$]*")
_COMMENT = {
    "py": re.compile(r"#[^\n]*"), "rb": re.compile(r"#[^\n]*|^=begin[\s\S]*?^=end", re.M),
    "": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/"),
}
_STRING = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|`[^`]*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_RAW = re.compile(r'r(#+)"[\s\S]*?"\1')
_HEREDOC = re.compile(r"<<[~-]?([\"']?)([A-Za-z_]\w*)\1[^\n]*\n[\s\S]*?\n[ \t]*\2\b")
# possessive throughout, so a line of any length is matched whole in one pass
_DATA_LINE = re.compile(r"""^[\s,\[\](){}]*+(?:(?:[-+]?(?:0[xX][0-9a-fA-F]++|\d[\d_.]*+(?:[eE][-+]?\d++)?+)[uUlLfF]{0,3}+\d{0,2}+|b?r?"(?:[^"\\]++|\\.)*+"|b?'(?:[^'\\]++|\\.)*+')\s*+(?::|=>)?+[\s,+\[\](){}]*+)++[;\s]*$""")
_LEAD = re.compile(r"[ \t\r\n﻿]*")
_NORM_WORD = re.compile(r"[^\W\d]\w*")
_NORM_NUM = re.compile(r"\d+")


def _clean_comment(c: str) -> str:
    return re.sub(r"(?m)^[ \t]*(?:///?!?|#+|/?\*+!?/?|=begin|=end)?[ \t]?|\*/[ \t]*$", "", c)


def said(note: str) -> tuple[bool, bool]:
    """(a tool says it wrote the file, the file says it is a copy); a line that denies it says nothing."""
    tool = copied = False
    for line in note.split("\n"):
        if HAND_NOTICE.search(line):
            continue
        tool = tool or bool(TOOL_NOTICE.search(line))
        if not OWN_NOTICE.search(line):
            m = COPYRIGHT.search(line)
            copied = copied or bool(COPIED_NOTICE.search(line)) or bool(m and _GROUPS.search(m.group(1)))
    return tool, copied


def said_anywhere(text: str) -> tuple[bool, bool]:
    """As ``said``, of comment lines behind the first code, where only a full notice counts."""
    tool = copied = False
    low = text.lower()
    if not any(w in low for w in ("generated", "produced", "written", "modify:", "edit:", "erzeugt", "produit", "生成", "upstream", "verbatim", "redistributed", "part of", "(c)")):
        return False, False
    for m in _COMMENT_LINE.finditer(text):
        line = m.group(1)
        if HAND_NOTICE.search(line):
            continue
        tool = tool or bool(STRONG_NOTICE.match(line))
        copied = copied or bool(STRONG_COPY.match(line))
    return tool, copied


_GROUPS = re.compile(r"\b(?:authors|contributors|developers|project|foundation|community)\b", re.I)


def notices(text: str, lang: str) -> str:
    """The comments before the first code and the last comment behind all code, without comment marks."""
    rx = _COMMENT.get(lang, _COMMENT[""])
    pos, parts = 0, []
    text = text.lstrip("﻿")
    if text.startswith("#!"):
        e = text.find("\n")
        pos = len(text) if e < 0 else e + 1
    while True:
        pos = _LEAD.match(text, pos).end()
        m = rx.match(text, pos)
        if not m and lang == "py" and pos < len(text):
            d = re.compile(r'[rRuU]?("""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\')').match(text, pos)
            if d:
                parts.append(d.group(1)[3:-3])
                pos = d.end()
                continue
        if not m:
            break
        parts.append(_clean_comment(m.group()))
        pos = m.end()
    tail = text.rstrip()
    last = tail[tail.rfind("\n") + 1 :].strip()
    if rx.match(last) or last.endswith("*/"):
        parts.append(_clean_comment(last))
    return "\n".join(parts)


def identifiers(text: str, lang: str) -> dict[str, int]:
    """Names outside comments and strings, with their counts."""
    rx = _COMMENT.get(lang, _COMMENT[""])
    if lang == "rust" and '#"' in text:
        text = _RAW.sub('""', text)
    elif lang == "rb" and "<<" in text:
        text = _HEREDOC.sub('""', text)
    # strings first: a comment mark inside one is no comment
    code = _STRING.sub('""', text)
    code = rx.sub(" ", code)
    out: dict[str, int] = {}
    for w in _IDENT.findall(code):
        out[w] = out.get(w, 0) + 1
    return out


def grams(name: str) -> list[str]:
    """Character trigrams over 29 classes: a-z, digit, upper-case start of a word, end."""
    s = []
    prev = ""
    for c in name:
        if c.isdigit():
            k = "0"
        elif c in "_$":
            k = "_"
        else:
            k = c.lower() if c.isascii() else "?"
            if c.isupper() and (prev.islower() or prev.isdigit()):
                s.append("_")
        s.append(k)
        prev = c
    t = "^^" + "".join(s) + "$"
    return [t[i : i + 3] for i in range(len(t) - 2)]


# Classes of the trigrams: a-z, then digit, underscore or start of a word, anything else, start, end.
_CLASS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0_?^$")}
N_GRAMS = len(_CLASS) ** 3


@lru_cache(200_000)
def gram_ids(name: str) -> bytes:
    """The trigrams of a name as numbers below N_GRAMS, two bytes each in the machine's order."""
    k = len(_CLASS)
    return array("H", [(_CLASS[g[0]] * k + _CLASS[g[1]]) * k + _CLASS[g[2]] for g in grams(name)]).tobytes()


NAME_WINDOW = 40
NAME_LEAST = 12


def name_diversity(names: list[str]) -> float:
    """Distinct trigrams among the trigrams of the names, as the mean over runs of NAME_WINDOW names in the order of the
    text, so that a long file is not less diverse for its length; 1 for fewer than NAME_LEAST names."""
    names = [w for w in names if len(w) > 2]
    if len(names) < NAME_LEAST:
        return 1.0
    shares = []
    for i in range(0, len(names), NAME_WINDOW):
        run = names[i : i + NAME_WINDOW]
        if i and len(run) < NAME_WINDOW:
            break
        ids = array("H", b"".join(map(_distinct_ids, run)))
        shares.append(len(set(ids)) / len(ids))
    return sum(shares) / len(shares)


@lru_cache(200_000)
def _distinct_ids(name: str) -> bytes:
    return array("H", sorted(set(array("H", gram_ids(name))))).tobytes()


def path_says(path: str) -> str:
    """'foreign', 'tool', 'min' or ''; directories are compared whole and in lower case."""
    parts = [p for p in re.split(r"[\\/]+", path) if p]
    dirs = [p.lower() for p in parts[:-1]]
    # a checkout's own root is not its content
    if len(dirs) > 3 and dirs[:2] == ["srv", "checkouts"]:
        dirs = dirs[3:]
    name = parts[-1].lower() if parts else ""
    if any(d in FOREIGN_DIRS for d in dirs):
        return "foreign"
    if any(d in TOOL_DIRS for d in dirs) or re.search(r"(?:\.pb|_pb2|_pb2_grpc|\.g|\.generated|\.designer|_generated|\.pb\.gw|_string)\.[a-z]+$", name):
        return "tool"
    if re.search(r"[^.]+[.\-_](?:min|bundle|packed|prod\.min|umd\.min|slim\.min)\.[a-z]+$", name) and re.search(r"\.min\.", name):
        return "min"
    return ""


@lru_cache(200_000)
def style(name: str) -> str:
    if "_" in name.strip("_") and name.islower():
        return "snake"
    if name[:1].islower() and any(c.isupper() for c in name):
        return "camel"
    return ""


def shape(text: str, lang: str) -> dict[str, float]:
    """Shares and diversity of the text itself."""
    lines = text.split("\n")
    n = max(1, len(text))
    data = sum(len(x) + 1 for x in lines if len(x) > 12 and _DATA_LINE.match(x))
    long = sum(len(x) for x in lines if len(x) > 500)
    longest_code = max((len(_STRING.sub("", x)) for x in lines if len(x) > 300), default=0)
    norm = [x for x in map(str.strip, _NORM_NUM.sub("0", _NORM_WORD.sub("a", text)).split("\n")) if len(x) >= 2]
    total = len(norm)
    return {
        "n_chars": float(n), "n_lines": float(total), "data_share": data / n, "long_share": long / n, "longest_code": float(longest_code),
        "diversity": len(set(norm)) / max(1, total), "bundle": float(bool(_BUNDLE.search(text))),
    }


_BUNDLE = re.compile(
    r"__webpack_require__|/\*{3}/ ?(?:\d+|\"[^\"]+\") ?: ?(?:function ?\(|\(\()|\bparcelRequire\b|System\.register\(\[|\(function ?\(\w+(?:, ?\w+)*\) ?\{\s*var (\w+) = \{\};\s*function \w+\((\w+)\) ?\{ ?if ?\(\1\[\2\]\)"
)


def model_of(counts: np.ndarray) -> np.ndarray:
    """Bits of every trigram (by number) given its first two characters, with add-half smoothing; UNSEEN for one not seen."""
    k = len(_CLASS)
    head = np.repeat(counts.reshape(-1, k).sum(axis=1), k)
    with np.errstate(divide="ignore"):
        bits = -np.log2((counts + 0.5) / (head + 0.5 * 29))
    return np.where(counts > 0, bits, UNSEEN)


UNSEEN = 12.0
