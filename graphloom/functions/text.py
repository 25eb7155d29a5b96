"""Text as columns: identifiers, tokens, markdown sections, secrets, references, licences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.numbers import let

# Words that carry no meaning in a question, and verbs that only support another match.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "i", "in", "is", "it", "its", "my", "of", "on", "or", "that", "the", "this", "to",
    "we", "what", "when", "where", "which", "who", "why", "with", "you",
)
WEAK = ("add", "create", "get", "make", "run", "set", "update", "use", "via", "work")


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits in their order, without stop words; null gives null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def identifier_parts(name: Column) -> Column:
    """Distinct lower-case parts of a camel, snake or kebab name."""
    parts = F.split(name, r"[^\p{L}\p{N}]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), F.lower))


def alike(a: Column, b: Column) -> Column:
    """Whether two words share a prefix of 5 letters or more and of 0.6 of the shorter one or more."""
    need = F.greatest(F.lit(5), F.ceil(0.6 * F.least(F.length(a), F.length(b))).cast("int"))
    return (F.length(a) >= need) & (F.length(b) >= need) & (F.left(a, need) == F.left(b, need))


def approx_tokens(text: Column) -> Column:
    """ceil(characters / 4)."""
    return F.ceil(F.length(text) / F.lit(4))


_HEAD = r"(?m)^(?=#{1,6}[^\S\n]+\S)"


def sections(md: Column) -> Column:
    """array<struct<heading, level, body>> of a markdown text at its ATX headings; what stands before the first is level 0.

    Sections without heading and body are left out. One row stays one row: a text is split where it lies.
    """
    parts = F.split(md, _HEAD)

    def one(x: Column) -> Column:
        head = F.regexp_extract(x, r"^#{1,6}[^\S\n]+([^\n]*\S)[^\S\n]*(?:\n|$)", 1)
        level = F.when(head != "", F.length(F.regexp_extract(x, r"^(#{1,6})[^\S\n]", 1))).otherwise(F.lit(0))
        body = F.when(head != "", F.regexp_replace(x, r"^[^\n]*\n?", "")).otherwise(x)
        return F.struct(F.trim(head).alias("heading"), level.alias("level"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))

    return F.filter(F.transform(parts, one), lambda s: (s["heading"] != "") | (s["body"] != ""))


def chunks(body: Column) -> Column:
    """The paragraphs of a text, parted by blank lines outside of fences; fenced blocks stay whole."""
    # a fence and all up to its end is one unit; so is a run of lines that are not blank and start no fence
    fence = r"[^\S\n]*```[\s\S]*?(?:\n[^\S\n]*```[^\n]*|\z)"
    return F.regexp_extract_all(body, F.lit(rf"(?m)^(?:(?:{fence}|(?![^\S\n]*$)(?![^\S\n]*```)[^\n]+)(?:\n|\z))+"), F.lit(0))


def strip_badges(body: Column) -> Column:
    """Without the lines that are only images in links or rows of images."""
    return F.trim(F.regexp_replace(body, r"(?m)^\s*(?:!\[[^\]]*\]\([^)]*\)\s*)+$\n?", ""))


# Headings that hold usage and those that hold everything else, and the weights of a section.
USAGE = r"(?i)\b(usage|example|examples|quick ?start|getting started|api|guide|how to|reference|tutorial|basic)\b"
PREAMBLE = r"(?i)\b(install|installation|license|licence|contributing|contributors?|sponsors?|table of contents|toc|changelog|funding|code of conduct|security|acknowledge)\b"
SECTION_WEIGHTS = {"usage": 4.0, "preamble": -6.0, "code": 3.0, "code_density": 0.5, "query": 5.0, "symbol": 2.0, "position": -0.1, "links": -3.0}


def section_score(heading: Column, body: Column, position: Column, terms: list[str], symbols: list[str] = ()) -> Column:
    """What a section is worth to a question: its heading, code, terms, symbols, place and share of links."""
    w = SECTION_WEIGHTS
    text = F.lower(F.concat_ws("\n", heading, body))
    code = F.floor(F.regexp_count(body, F.lit("```")) / 2)
    lines = F.greatest(F.size(F.filter(F.split(body, "\n"), lambda l: F.trim(l) != "")), F.lit(1))
    s = F.when(heading.rlike(USAGE), w["usage"]).otherwise(0.0) + F.when(heading.rlike(PREAMBLE), w["preamble"]).otherwise(0.0)
    s = s + F.when(code > 0, w["code"] + w["code_density"] * F.least(code, F.lit(5))).otherwise(0.0)
    for t in terms:
        s = s + F.when(text.contains(t.lower()), w["query"]).otherwise(0.0)
    for y in symbols:
        if len(y) > 2:
            s = s + F.when(text.contains(y.lower()), w["symbol"]).otherwise(0.0)
    s = s + position * F.lit(w["position"])
    return s + F.when(F.regexp_count(body, F.lit(r"\]\(|https?://")) / lines > 0.5, w["links"]).otherwise(0.0)


def doc_quality(content: Column, name: Column, terms: list[str], least: int = 60) -> Column:
    """struct(score, sufficient): code, length, the library's name, and the question's terms (more than half must be there)."""
    low = F.lower(content)
    code = content.contains("```") | content.rlike(r"(^|\n)( {4}|\t)\S")
    long = approx_tokens(content) >= least
    bare = F.lower(F.regexp_replace(name, r"^@[^/]+/", ""))
    hits = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    topic = (hits >= len(terms) // 2 + 1) if terms else F.lit(True)
    score = F.when(code, 2).otherwise(0) + F.when(long, 1).otherwise(0) + F.when((F.length(bare) > 1) & low.contains(bare), 1).otherwise(0)
    score = score + F.when(topic, F.least(hits, F.lit(2))).otherwise(0)
    return F.struct(score.alias("score"), (code & long & topic).alias("sufficient"))


# What a credential looks like, in the order the patterns are applied.
SECRETS = (
    r"\b(?:gh[opusr]_|github_pat_)[A-Za-z0-9_]{8,}\b", r"\bglpat-[A-Za-z0-9_-]{8,}\b", r"\bxox[baprs]-[A-Za-z0-9-]{8,}\b", r"(?i)\bsk-[A-Za-z0-9_-]{8,}\b",
    r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{8,}\b", r"\bnpm_[A-Za-z0-9]{16,}\b", r"\b(?:AKIA|ASIA)[0-9A-Z]{12,}\b", r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+\b",
    r"\b(?:Bearer|Basic)\s+[A-Za-z0-9+/._:=-]{8,}",
    r"(?i)\b(?:authorization|api[_-]?key|apikey|access[_-]?token|client[_-]?secret|password|passwd|secret)\s*[:=]\s*['\"]?[^'\"\s]{6,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", r"\b[A-Za-z0-9+/]{40,}={0,2}\b",
)
REDACTED = "[REDACTED]"


def redact(text: Column) -> Column:
    """Every credential-shaped run replaced by a mark."""
    for p in SECRETS:
        text = F.regexp_replace(text, p, REDACTED)
    return text


def strip_url_credentials(url: Column) -> Column:
    """A URL without user info and without the parameters that carry credentials."""
    u = F.regexp_replace(url, r"//[^@/]+@", "//")
    keys = r"(?i)(?:access[_-]?token|private[_-]?token|api[_-]?key|apikey|token|secret|password|passwd|auth|authorization|x-token|sig|signature|key)"
    u = F.regexp_replace(u, rf"(?<=[?&]){keys}=[^&]*(?:&|$)", "")
    return F.regexp_replace(u, r"[?&]$", "")


def normal_package(name: Column) -> Column:
    """A package name in the form registries compare: lower case, runs of - _ . as one hyphen."""
    return F.lower(F.regexp_replace(F.trim(name), r"[-_.]+", "-"))


def unscoped(name: Column) -> Column:
    return F.regexp_replace(name, r"^@[^/]+/", "")


def image_ref(ref: Column) -> Column:
    """struct(registry, image, tag, digest) of a container image reference."""
    digest = F.nullif(F.regexp_extract(ref, r"@(sha256:[0-9a-f]+)$", 1), F.lit(""))
    bare = F.regexp_replace(ref, r"@sha256:[0-9a-f]+$", "")
    tag = F.nullif(F.regexp_extract(bare, r":([\w][\w.-]*)$", 1), F.lit(""))
    path = F.regexp_replace(bare, r":[\w][\w.-]*$", "")
    registry = F.nullif(F.regexp_extract(path, r"^([\w-]+(?:\.[\w-]+)+(?::\d+)?|localhost(?::\d+)?)/", 1), F.lit(""))
    image = F.regexp_replace(path, r"^(?:[\w-]+(?:\.[\w-]+)+(?::\d+)?|localhost(?::\d+)?)/", "")
    return F.struct(registry.alias("registry"), image.alias("image"), tag.alias("tag"), digest.alias("digest"))


def git_url(url: Column) -> Column:
    """struct(host, owner, repo) of https, ssh and git@ addresses."""
    m = r"^(?:git\+)?(?:https?://|ssh://|git://)?(?:[^@/]+@)?([\w.-]+)[:/]+([^/]+(?:/[^/]+)*)/([^/]+?)(?:\.git)?/?$"
    return F.struct(*[F.nullif(F.regexp_extract(url, m, i), F.lit("")).alias(n) for i, n in ((1, "host"), (2, "owner"), (3, "repo"))])


# Risk classes of licences.
COPYLEFT = r"^(?:A?GPL|SSPL|OSL|EUPL)"
WEAK_COPYLEFT = r"^(?:LGPL|MPL|EPL|CDDL)"
PERMISSIVE = r"^(?:MIT|Apache|BSD|ISC|Unlicense|0BSD|Zlib|CC0)"


def licence_ids(expr: Column) -> Column:
    """The licence ids of an SPDX expression in order, without operators, exceptions and 'or later' marks."""
    e = F.regexp_replace(expr, r"(?i)\bWITH\s+[\w.-]+", " ")
    ids = F.regexp_extract_all(e, F.lit(r"[A-Za-z0-9][A-Za-z0-9.-]*\+?"), F.lit(0))
    ids = F.filter(ids, lambda x: ~F.upper(x).isin("AND", "OR", "WITH"))
    return F.array_distinct(F.transform(ids, lambda x: F.regexp_replace(x, r"(?:\+|-or-later|-only)$", "")))


def licence_risk(expr: Column) -> Column:
    """high, medium, low or unknown: an OR takes the mildest of its licences, an AND the strictest."""

    def risk(x: Column) -> Column:
        return F.when(x.rlike(COPYLEFT), 3).when(x.rlike(WEAK_COPYLEFT), 2).when(x.rlike(PERMISSIVE), 1).otherwise(4)

    ranks = F.transform(licence_ids(expr), risk)
    top = F.when(expr.rlike(r"(?i)\bOR\b"), F.array_min(ranks)).otherwise(F.array_max(ranks))
    return F.when(top == 3, "high").when(top == 2, "medium").when(top == 1, "low").otherwise("unknown")


# Figures of the CVSS 3 formula.
_AV, _AC, _UI = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, {"L": 0.77, "H": 0.44}, {"N": 0.85, "R": 0.62}
_PR, _PR_CHANGED, _CIA = {"N": 0.85, "L": 0.62, "H": 0.27}, {"N": 0.85, "L": 0.68, "H": 0.5}, {"H": 0.56, "L": 0.22, "N": 0.0}


def cvss3(vector: Column) -> Column:
    """The base score of a CVSS 3.0 or 3.1 vector, null where it is none."""
    v = F.upper(F.trim(vector))

    def part(k: str, table: dict[str, float]) -> Column:
        got = F.regexp_extract(v, rf"/{k}:([A-Z])(?:/|$)", 1)
        out = F.lit(None).cast("double")
        for a, b in table.items():
            out = F.when(got == a, F.lit(b)).otherwise(out)
        return out

    changed = v.rlike(r"/S:C(?:/|$)")
    pr = F.when(changed, part("PR", _PR_CHANGED)).otherwise(part("PR", _PR))
    iss = 1 - (1 - part("C", _CIA)) * (1 - part("I", _CIA)) * (1 - part("A", _CIA))
    reach = 8.22 * part("AV", _AV) * part("AC", _AC) * pr * part("UI", _UI)

    def impact(x: Column) -> Column:
        return F.when(x["changed"], 7.52 * (x["iss"] - 0.029) - 3.25 * F.pow(x["iss"] - 0.02, F.lit(15))).otherwise(6.42 * x["iss"])

    def score(y: Column) -> Column:
        raw = F.least(F.when(y["changed"], 1.08 * (y["impact"] + y["reach"])).otherwise(y["impact"] + y["reach"]), F.lit(10.0))
        up = let(F.floor(raw * 100000 + 0.5), lambda i: F.when(i % 10000 == 0, i / 100000).otherwise((F.floor(i / 10000) + 1) / 10))
        return F.when(y["impact"].isNotNull() & y["reach"].isNotNull() & y["v3"], F.when(y["impact"] <= 0, F.lit(0.0)).otherwise(up))

    base = F.struct(changed.alias("changed"), iss.alias("iss"), reach.alias("reach"), v.rlike(r"^CVSS:3\.[01]/").alias("v3"))
    return let(base, lambda x: let(F.struct(x["changed"].alias("changed"), impact(x).alias("impact"), x["reach"].alias("reach"), x["v3"].alias("v3")), score))


def severity(score: Column) -> Column:
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "moderate").when(score > 0, "low").otherwise("unknown")


def severity_rank(label: Column) -> Column:
    l = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(l == "critical", 4).when(l == "high", 3).when(l.isin("moderate", "medium"), 2).when(l == "low", 1).otherwise(0)


# What change notes call a breaking change.
SIGNALS = {"breaking": r"(?i)\bbreaking(?:[ -]changes?)?\b", "removed": r"(?i)\b(?:removed?|removes|dropped|drops?)\b", "renamed": r"(?i)\brenam(?:ed?|es|ing)\b", "deprecated": r"(?i)\bdeprecat(?:ed?|es|ion)\b", "migration": r"(?i)\bmigrat(?:e|ion|ing)\b"}


def signals(text: Column) -> Column:
    """The labels of breaking signals a text holds, in a fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SIGNALS.items()]))


def needles(question: Column) -> Column:
    """URLs and quoted phrases of a question, to be searched for as they stand."""
    urls = F.regexp_extract_all(question, F.lit(r"https?://[^\s\"'`<>)]+"), F.lit(0))
    quoted = F.transform(F.regexp_extract_all(question, F.lit(r"\"[^\"\n]{2,}\"|`[^`\n]{2,}`"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.array_distinct(F.concat(urls, quoted))


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
