"""Graphs as text: one line per node or edge, so that any size is written in parallel by ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("ndjson", "dot", "cypher", "sql", "graphml", "md")


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sql_text(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def quoted(c: Column) -> Column:
    """In double quotes with backslashes and quotes escaped; null is the empty string."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def node_line(form: str) -> Column:
    """The line of a node (id, kind, name, file)."""
    i, k, n, f = (F.col(c) for c in ("id", "kind", "name", "file"))
    if form == "ndjson":
        return F.to_json(F.struct(F.lit("node").alias("type"), i, k, n, f))
    if form == "dot":
        return F.concat(F.lit("  "), quoted(i), F.lit(" [label="), quoted(n), F.lit("];"))
    if form == "cypher":
        return F.concat(F.lit("CREATE (:Node {id: "), quoted(i), F.lit(", kind: "), quoted(k), F.lit(", name: "), quoted(n), F.lit("});"))
    if form == "sql":
        return F.concat(F.lit("INSERT INTO nodes VALUES ("), F.concat_ws(", ", *map(sql_text, (i, k, n, f))), F.lit(");"))
    if form == "graphml":
        return F.concat(F.lit('<node id="'), xml(i), F.lit('"><data key="name">'), xml(F.coalesce(n, F.lit(""))), F.lit("</data></node>"))
    return F.concat(F.lit("- **"), F.coalesce(n, i), F.lit("** ("), F.coalesce(k, F.lit("")), F.lit(") "), F.coalesce(f, F.lit("")))


def edge_line(form: str) -> Column:
    """The line of an edge (kind, src, dst)."""
    k, s, d = (F.col(c) for c in ("kind", "src", "dst"))
    if form == "ndjson":
        return F.to_json(F.struct(F.lit("edge").alias("type"), k, s, d))
    if form == "dot":
        return F.concat(F.lit("  "), quoted(s), F.lit(" -> "), quoted(d), F.lit(" [label="), quoted(k), F.lit("];"))
    if form == "cypher":
        return F.concat(F.lit("MATCH (a:Node {id: "), quoted(s), F.lit("}), (b:Node {id: "), quoted(d), F.lit("}) CREATE (a)-[:"), F.upper(k), F.lit("]->(b);"))
    if form == "sql":
        return F.concat(F.lit("INSERT INTO edges VALUES ("), F.concat_ws(", ", *map(sql_text, (k, s, d))), F.lit(");"))
    if form == "graphml":
        return F.concat(F.lit('<edge source="'), xml(s), F.lit('" target="'), xml(d), F.lit('"><data key="kind">'), xml(k), F.lit("</data></edge>"))
    return F.concat(F.lit("  - "), s, F.lit(" "), k, F.lit(" "), d)


# What stands before and behind the lines in one file.
FRAME = {
    "dot": ("digraph g {", "}"), "graphml": ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "</graph></graphml>"),
    "sql": ("CREATE TABLE nodes (id TEXT, kind TEXT, name TEXT, file TEXT); CREATE TABLE edges (kind TEXT, src TEXT, dst TEXT);", ""),
}


def lines(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(value): all lines of a graph in a format, nodes and edges; frame lines are not among them."""
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")
    return nodes.select(node_line(form).alias("value")).unionByName(edges.select(edge_line(form).alias("value")))


def write(nodes: DataFrame, edges: DataFrame, form: str, path: str) -> None:
    """Writes a folder of text parts in parallel; the frame goes into the first and last part by name."""
    lines(nodes, edges, form).write.mode("overwrite").text(path)
    head, tail = FRAME.get(form, ("", ""))
    spark = nodes.sparkSession
    for name, text in (("part-!head", head), ("part-~tail", tail)):
        if text:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def cyclonedx(components: DataFrame) -> DataFrame:
    """(value): one CycloneDX component a line, of (ecosystem, name, version)."""
    purl = F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), F.coalesce("version", F.lit("")))
    return components.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", purl.alias("purl"))).alias("value"))


def spdx(components: DataFrame) -> DataFrame:
    """(value): one SPDX package a line."""
    ident = F.concat(F.lit("SPDXRef-"), F.regexp_replace(F.concat_ws("-", "ecosystem", "name", "version"), "[^A-Za-z0-9.-]", "-"))
    return components.select(F.to_json(F.struct(ident.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"))).alias("value"))


def sarif(findings: DataFrame) -> DataFrame:
    """(value): one SARIF result a line, of (rule, level, message, file, line)."""
    at = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(at).alias("locations"))).alias("value"))
