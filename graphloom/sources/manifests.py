"""Readers of manifests, lockfiles and toolchain files: (rel, content) in, one row per entry out.

Every reader is a pattern or a JSON schema applied to the whole text where it lies; nothing leaves the JVM and nothing is
shuffled. A text of another form gives no row; null texts give none. Tools' own formats fix the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import base_name

# Lockfiles by name, and where in them the name and the resolved version stand.
LOCKFILES = {
    "yarn.lock": ("npm", r"(?m)^\"?(@?[^@\s\"]+)@[^\n]*:\r?\n\s+version:?\s+\"?([^\"\s]+)"),
    "pnpm-lock.yaml": ("npm", r"(?m)^ {2}'?/?(@?[^@'\s(:]+)@([^:('\s]+)[^:\n]*:\s*$"),
    "Cargo.lock": ("cargo", r"\[\[package\]\]\s*name = \"([^\"]+)\"\s*version = \"([^\"]+)\""),
    "poetry.lock": ("pypi", r"\[\[package\]\]\s*name = \"([^\"]+)\"\s*version = \"([^\"]+)\""),
    "Gemfile.lock": ("rubygems", r"(?m)^ {4}([\w.-]+) \(([^)]+)\)$"),
    "go.mod": ("go", r"(?m)^(?:require\s+|\t)([\w.-]+\.[\w./-]+)\s+(v\S+)"),
    "composer.lock": ("composer", r"\"name\":\s*\"([^\"/]+/[^\"]+)\",\s*\"version\":\s*\"([^\"]+)\""),
    "Pipfile.lock": ("pypi", r"\"([\w.-]+)\":\s*\{[^{}]*?\"version\":\s*\"==([^\"]+)\""),
    "pubspec.lock": ("pub", r"(?m)^ {2}(\w+):\n(?: {4,}[^\n]*\n)*? {4}version: \"([^\"]+)\""),
    "mix.lock": ("hex", r"\"(\w+)\":\s*\{:hex, :\w+, \"([^\"]+)\""),
    "packages.lock.json": ("nuget", r"\"([\w.]+)\":\s*\{\s*\"type\":\s*\"\w+\",(?:\s*\"requested\":\s*\"[^\"]*\",)?\s*\"resolved\":\s*\"([^\"]+)\""),
    "gradle.lockfile": ("maven", r"(?m)^([\w.-]+:[\w.-]+):([^=\s]+)="),
    "requirements.txt": ("pypi", r"(?m)^([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)"),
    "Package.resolved": ("swift", r"\"identity\"\s*:\s*\"([^\"]+)\"[^}]*?\"version\"\s*:\s*\"([^\"]+)\""),
}
# Manifests with declared ranges.
MANIFESTS = {
    "Cargo.toml": ("cargo", r"(?m)^([\w-]+)\s*=\s*(?:\"|\{[^}\n]*version\s*=\s*\")([^\"]+)\""),
    "Gemfile": ("rubygems", r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]"),
    "pubspec.yaml": ("pub", r"(?m)^ {2}(\w+):\s*([\^~<>=]*\d[^\s#]*)"),
    "mix.exs": ("hex", r"\{:(\w+),\s*\"([^\"]+)\""),
    "Package.swift": ("swift", r"url:\s*\"[^\"]*/([^/\"]+?)(?:\.git)?\"\s*,\s*(?:from|exact):\s*\"([^\"]+)\""),
    "composer.json": ("composer", r"\"([\w.-]+/[\w.-]+)\":\s*\"([^\"]+)\""),
    "build.gradle": ("maven", r"(?:implementation|api|compileOnly|testImplementation)[\s(]+['\"]([\w.-]+:[\w.-]+):([^'\"]+)['\"]"),
}
_XML = {"pom.xml": ("maven", r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*(?:<version>([^<]+)</version>)?")}
_CSPROJ = ("nuget", r"<PackageReference\s+Include=\"([^\"]+)\"\s+Version=\"([^\"]+)\"")


def _pairs(files: DataFrame, rows: Column, ecosystem: str, kind: str) -> DataFrame:
    return files.select("rel", F.lit(ecosystem).alias("ecosystem"), F.lit(kind).alias("kind"), F.explode(rows).alias("x")).select("rel", "ecosystem", "kind", "x.name", "x.version")


def _match(pattern: str) -> Column:
    names, versions = F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.regexp_extract_all("content", F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("n"), versions.alias("v")), lambda x: F.struct(x["n"].alias("name"), x["v"].alias("version")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lock_entries(files: DataFrame) -> DataFrame:
    """(rel, ecosystem, kind 'lock', name, version) of all lockfiles among the files, each pair once a file."""
    f = files.where("rel is not null and content is not null").withColumn("_b", base_name(F.col("rel")))
    parts = [_pairs(f.where(F.col("_b") == b), _match(p), e, "lock") for b, (e, p) in LOCKFILES.items()]
    j = F.from_json("content", "packages map<string, struct<version: string>>, dependencies map<string, struct<version: string>>")
    both = F.concat(F.coalesce(F.map_entries(j["packages"]), F.array()), F.coalesce(F.map_entries(j["dependencies"]), F.array()))
    rows = F.transform(F.filter(both, lambda x: (x["key"] != "") & x["value"]["version"].isNotNull()), lambda x: F.struct(F.regexp_replace(x["key"], "^.*node_modules/", "").alias("name"), x["value"]["version"].alias("version")))
    parts.append(_pairs(f.where(F.col("_b") == "package-lock.json"), rows, "npm", "lock"))
    return _union(parts).distinct()


def manifest_entries(files: DataFrame) -> DataFrame:
    """(rel, ecosystem, kind, name, version) of declared dependencies; kind is the section (``dev`` for npm's devDependencies)."""
    f = files.where("rel is not null and content is not null").withColumn("_b", base_name(F.col("rel")))
    parts = [_pairs(f.where(F.col("_b") == b), _match(p), e, "direct") for b, (e, p) in MANIFESTS.items()]
    parts.append(_pairs(f.where(F.col("_b").endswith(".csproj")), _match(_CSPROJ[1]), _CSPROJ[0], "direct"))
    e, p = _XML["pom.xml"]
    g = [F.regexp_extract_all("content", F.lit(p), F.lit(i)) for i in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(g[0].alias("a"), g[1].alias("b"), g[2].alias("v")), lambda x: F.struct(F.concat_ws(":", x["a"], x["b"]).alias("name"), F.nullif(x["v"], F.lit("")).alias("version")))
    parts.append(_pairs(f.where(F.col("_b") == "pom.xml"), rows, e, "direct"))
    j = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    for field, kind in (("dependencies", "direct"), ("devDependencies", "dev"), ("peerDependencies", "peer")):
        rows = F.transform(F.coalesce(F.map_entries(j[field]), F.array()), lambda x: F.struct(x["key"].alias("name"), x["value"].alias("version")))
        parts.append(_pairs(f.where(F.col("_b") == "package.json"), rows, "npm", kind))
    return _union(parts).distinct()


def inventory(files: DataFrame) -> DataFrame:
    """(ecosystem, name, version, rel, n_sites): every declared package once, as its first file declares it, with the number of files."""
    m = manifest_entries(files)
    return m.groupBy("ecosystem", "name").agg(F.min_by("version", "rel").alias("version"), F.min("rel").alias("rel"), F.countDistinct("rel").alias("n_sites"))


def package_nodes(files: DataFrame) -> DataFrame:
    """(kind, src, dst) import edges from a manifest's own package (npm's ``name``, go's ``module``) to what it depends on."""
    name = F.coalesce(F.get_json_object("content", "$.name"), F.nullif(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1), F.lit("")))
    own = files.where(base_name(F.col("rel")).isin("package.json", "go.mod")).select("rel", name.alias("src")).where("src is not null")
    deps = manifest_entries(files).select("rel", "name").union(lock_entries(files).where("ecosystem = 'go'").select("rel", "name"))
    return own.join(deps, "rel").select(F.lit("import").alias("kind"), "src", F.col("name").alias("dst")).distinct()


def ddl(files: DataFrame) -> DataFrame:
    """(rel, kind, name, line, refs) of the tables and views SQL texts create, with the tables they refer to."""
    stmt = r"(?is)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\w.\"`\[\]]+.*?(?:;|\z)"
    f = files.where("content is not null").select("rel", "content", F.explode(F.regexp_extract_all("content", F.lit(stmt), F.lit(0))).alias("s"))
    kind = F.lower(F.regexp_extract("s", r"(?i)\b(table|view)\b", 1))
    name = F.regexp_replace(F.regexp_extract("s", r"(?i)(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)", 1), r"[\"`\[\]]", "")
    refs = F.regexp_extract_all("s", F.lit(r"(?i)\breferences\s+[\"`\[]?([\w.]+)"), F.lit(1))
    line = F.size(F.split(F.left("content", F.instr("content", F.col("s")) - 1), "\n"))
    return f.select("rel", kind.alias("kind"), name.alias("name"), line.alias("line"), F.array_sort(F.array_distinct(refs)).alias("refs"))


def embedded_scripts(files: DataFrame) -> DataFrame:
    """(rel, nr, lang, line, script) of the ``<script>`` blocks of component files."""
    tag = r"(?is)<script\b[^>]*>.*?</script>"
    f = files.where("content is not null").select("rel", "content", F.posexplode(F.regexp_extract_all("content", F.lit(tag), F.lit(0))).alias("nr", "s"))
    lang = F.coalesce(F.nullif(F.regexp_extract("s", r"(?i)<script\b[^>]*\blang=[\"']?(\w+)", 1), F.lit("")), F.lit("js"))
    line = F.size(F.split(F.left("content", F.instr("content", F.col("s")) - 1), "\n"))
    return f.select("rel", "nr", lang.alias("lang"), line.alias("line"), F.regexp_extract("s", r"(?is)<script\b[^>]*>(.*?)</script>", 1).alias("script"))


def hcl_blocks(files: DataFrame) -> DataFrame:
    """(rel, block, type, name, attributes) of the top-level blocks of HCL texts; attributes are those of simple values."""
    blk = r"(?m)^(\w+)\s*(?:\"([^\"]+)\"\s*)?(?:\"([^\"]+)\"\s*)?\{([\s\S]*?)^\}"
    g = [F.regexp_extract_all("content", F.lit(blk), F.lit(i)) for i in (1, 2, 3, 4)]
    z = F.arrays_zip(g[0].alias("b"), g[1].alias("t"), g[2].alias("n"), g[3].alias("x"))
    f = files.where("content is not null").select("rel", F.explode(z).alias("z"))
    att = r"(?m)^\s*([\w-]+)\s*=\s*\"?([^\"\n{\[]+?)\"?\s*$"
    keys, values = F.regexp_extract_all("z.x", F.lit(att), F.lit(1)), F.regexp_extract_all("z.x", F.lit(att), F.lit(2))
    pairs = F.map_from_entries(F.array_distinct(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(p["k"], p["v"]))))
    return f.select("rel", F.col("z.b").alias("block"), F.nullif(F.col("z.t"), F.lit("")).alias("type"), F.nullif(F.col("z.n"), F.lit("")).alias("name"), pairs.alias("attributes"))


# Where toolchain files name what they use.
TOOLCHAIN = (
    ("docker", r"(^|/)(Dockerfile|Containerfile)[^/]*$", r"(?im)^FROM\s+(?:--\S+\s+)?(\S+)"),
    ("compose", r"(^|/)(docker-)?compose[^/]*\.ya?ml$", r"(?m)^\s*image:\s*['\"]?([^\s'\"]+)"),
    ("kubernetes", r"(^|/)(k8s|kubernetes|manifests|deploy)/.*\.ya?ml$", r"(?m)^\s*-?\s*image:\s*['\"]?([^\s'\"]+)"),
    ("actions", r"(^|/)\.github/workflows/[^/]+\.ya?ml$", r"(?m)^\s*-?\s*uses:\s*['\"]?([^\s'\"]+)"),
    ("helm", r"(^|/)Chart\.ya?ml$", r"(?m)^\s*-?\s*name:\s*['\"]?([^\s'\"]+)"),
    ("terraform", r"\.tf$", r"(?m)^\s*source\s*=\s*\"([^\"]+)\""),
)


def toolchain(files: DataFrame) -> DataFrame:
    """(rel, tool, ref) of images, actions, charts and modules that toolchain files use."""
    f = files.where("rel is not null and content is not null")
    return _union([f.where(F.col("rel").rlike(r)).select("rel", F.lit(t).alias("tool"), F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("ref")) for t, r, p in TOOLCHAIN]).distinct()


def lcov(lines: DataFrame) -> DataFrame:
    """(file, line, hits) of LCOV texts (rel, content): a file mark holds until the record ends; repeated lines keep their greatest hits.

    Records are split within the text, so no window over lines is needed.
    """
    r = lines.where("content is not null").select(F.explode(F.split("content", r"(?m)^end_of_record\s*$")).alias("r"))
    f = F.trim(F.regexp_extract("r", r"(?m)^SF:([^\r\n]+)", 1))
    n, h = F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+),(\d+)"), F.lit(1)), F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+),(\d+)"), F.lit(2))
    x = r.select(f.alias("file"), F.explode(F.arrays_zip(n.alias("n"), h.alias("h"))).alias("x")).where("file <> ''")
    return x.groupBy("file", F.col("x.n").cast("int").alias("line")).agg(F.max(F.col("x.h").cast("long")).alias("hits"))


def istanbul(reports: DataFrame) -> DataFrame:
    """(file, line, hits) of Istanbul JSON texts: statements spread over their lines, the greatest hits win."""
    schema = "map<string, struct<statementMap: map<string, struct<start: struct<line: int>, `end`: struct<line: int>>>, s: map<string, bigint>>>"
    x = reports.where("content is not null").select(F.explode(F.from_json("content", schema)).alias("file", "v"))
    x = x.select("file", F.col("v.s").alias("s"), F.explode("v.statementMap").alias("k", "m")).where("m.start.line <= m.end.line")
    x = x.select("file", F.explode(F.sequence("m.start.line", "m.end.line")).alias("line"), F.try_element_at("s", F.col("k")).alias("h"))
    return x.groupBy("file", "line").agg(F.max("h").alias("hits"))


OSV = "id string, aliases array<string>, database_specific struct<severity: string>, severity array<struct<type: string, score: string>>, affected array<struct<package: struct<ecosystem: string, name: string>, ranges array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>, versions: array<string>>>".replace("ranges array", "ranges: array")


def osv(raw: DataFrame) -> DataFrame:
    """(id, ecosystem, package, introduced, fixed, vector, severity) of OSV JSON texts (content): one row per window of a range.

    An introduced of '0' is an open start; an introduced without a following fixed is an open end.
    """
    a = raw.where("content is not null").select(F.from_json("content", OSV).alias("a")).where("a.id is not null")
    vector = F.get(F.filter(F.col("a.severity"), lambda s: s["type"].startswith("CVSS_V3")), F.lit(0))["score"]
    p = a.select("a.id", vector.alias("vector"), F.lower("a.database_specific.severity").alias("severity"), F.explode("a.affected").alias("f"))
    r = p.select("id", "vector", "severity", F.col("f.package.ecosystem").alias("ecosystem"), F.col("f.package.name").alias("package"), F.explode("f.ranges").alias("r"))
    ev = F.transform(F.col("r.events"), lambda e, i: F.struct(e["introduced"].alias("introduced"), F.get(F.col("r.events"), i + 1)["fixed"].alias("fixed")))
    w = r.select("id", "ecosystem", "package", "vector", "severity", F.explode(F.filter(ev, lambda e: e["introduced"].isNotNull())).alias("w"))
    return w.select("id", "ecosystem", "package", F.when(F.col("w.introduced") != "0", F.col("w.introduced")).alias("introduced"), F.col("w.fixed").alias("fixed"), "vector", "severity")


def prisma(files: DataFrame) -> DataFrame:
    """(rel, model, field, type) of the models of Prisma schemas."""
    m = r"(?m)^model\s+(\w+)\s*\{([^}]*)\}"
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(m), F.lit(1)).alias("m"), F.regexp_extract_all("content", F.lit(m), F.lit(2)).alias("b"))
    x = files.where("content is not null").select("rel", F.explode(z).alias("z"))
    fld = r"(?m)^\s+(\w+)\s+([\w]+(?:\[\])?\??)"
    p = F.arrays_zip(F.regexp_extract_all("z.b", F.lit(fld), F.lit(1)).alias("f"), F.regexp_extract_all("z.b", F.lit(fld), F.lit(2)).alias("t"))
    return x.select("rel", F.col("z.m").alias("model"), F.explode(p).alias("p")).select("rel", "model", F.col("p.f").alias("field"), F.col("p.t").alias("type"))


def toml_values(files: DataFrame) -> DataFrame:
    """(rel, section, key, value) of the simple values of TOML and INI texts."""
    s = F.split("content", r"(?m)^(?=\[)")
    x = files.where("content is not null").select("rel", F.explode(s).alias("s"))
    kv = r"(?m)^\s*([\w.\"-]+)\s*=\s*\"?([^\"\n#]*?)\"?\s*(?:#.*)?$"
    p = F.arrays_zip(F.regexp_extract_all("s", F.lit(kv), F.lit(1)).alias("k"), F.regexp_extract_all("s", F.lit(kv), F.lit(2)).alias("v"))
    return x.select("rel", F.regexp_extract("s", r"^\[+([^\]\n]+)\]+", 1).alias("section"), F.explode(p).alias("p")).select("rel", "section", F.col("p.k").alias("key"), F.col("p.v").alias("value"))


def read_files(spark, folder: str, pattern: str = "*") -> DataFrame:
    """(rel, content, length, modified) of text files under a folder; only paths that match are opened."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").removeprefix("file:")
    return b.select(F.regexp_replace("path", rf"^(?:file:)?/*{root}/?", "").alias("rel"), F.decode("content", "UTF-8").alias("content"), "length", F.col("modificationTime").alias("modified"))
