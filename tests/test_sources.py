from graphloom.sinks import export
from graphloom.sources import manifests as m


def files(spark, **texts):
    rows = [(k.replace("__", "/"), v) for k, v in texts.items()]
    return spark.createDataFrame([*rows, ("empty", ""), (None, "x"), ("nothing", None)], "rel string, content string")


def named(spark, rows):
    return spark.createDataFrame(rows, "rel string, content string")


def test_lockfiles(spark):
    rows = [
        ("a/package-lock.json", '{"packages": {"": {"version": "1"}, "node_modules/left": {"version": "1.2.3"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}'),
        ("yarn.lock", 'left@^1.0.0, left@^1.1:\n  version "1.3.0"\n  resolved "x"\n\n"@s/b@^2":\n  version "2.1.0"\n'), ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n'),
        ("Gemfile.lock", "GEM\n  specs:\n    rack (2.2.3)\n      dep (>= 1)\n"), ("go.mod", "module x.y/z\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"), ("requirements.txt", "flask==2.0 ; x\n# c\nfoo[bar]==1\n"),
        ("Pipfile.lock", '{"default": {"flask": {"hashes": ["x"], "version": "==2.0"}}}'), ("pubspec.lock", 'packages:\n  http:\n    dependency: x\n    description:\n      name: http\n    version: "0.13"\n'),
        ("mix.lock", '%{"jason": {:hex, :jason, "1.2.2", "x"}}'), ("composer.lock", '{"packages": [{"name": "a/b", "version": "1.0"}]}'), ("gradle.lockfile", "a.b:c:1.2=compile\n"),
        ("pnpm-lock.yaml", "packages:\n  /left@1.3.0:\n    x: y\n"), ("broken/package-lock.json", "{nope"), ("yarn.lock", None),
    ]
    got = {(r["ecosystem"], r["name"], r["version"]) for r in m.lock_entries(named(spark, rows)).collect()}
    assert got == {
        ("npm", "left", "1.2.3"), ("npm", "@s/b", "2.0.0"), ("npm", "left", "1.3.0"), ("npm", "@s/b", "2.1.0"), ("cargo", "serde", "1.0.1"), ("rubygems", "rack", "2.2.3"), ("go", "github.com/a/b", "v1.2.3"),
        ("pypi", "flask", "2.0"), ("pypi", "foo", "1"), ("pub", "http", "0.13"), ("hex", "jason", "1.2.2"), ("composer", "a/b", "1.0"), ("maven", "a.b:c", "1.2"),
    }


def test_manifests(spark):
    rows = [
        ("package.json", '{"name": "me", "dependencies": {"left": "^1"}, "devDependencies": {"jest": "29"}}'), ("b/package.json", '{"name": "you", "dependencies": {"left": "~1"}}'), ("Cargo.toml", '[dependencies]\nserde = "1.0"\nx = { version = "2" }\n'),
        ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>"), ("a.csproj", '<PackageReference Include="N" Version="3" />'), ("Gemfile", "gem 'rack', '~> 2'\n"),
    ]
    f = named(spark, rows)
    inv = {(r["ecosystem"], r["name"]): (r["version"], r["n_sites"]) for r in m.inventory(f).collect()}
    assert inv[("npm", "left")] == ("~1", 2) and inv[("npm", "jest")] == ("29", 1) and inv[("maven", "g:a")] == ("1", 1) and inv[("nuget", "N")] == ("3", 1) and inv[("rubygems", "rack")] == ("~> 2", 1) and inv[("cargo", "x")] == ("2", 1)
    assert ("me", "left") in {(r["src"], r["dst"]) for r in m.package_nodes(f).collect()}


def test_ddl_scripts_hcl_toolchain(spark):
    sql = "-- x\nCREATE TABLE IF NOT EXISTS a (id int references b(id));\n\ncreate view v as select 1;\n"
    assert sorted((r["kind"], r["name"], r["line"], r["refs"]) for r in m.ddl(named(spark, [("x.sql", sql), ("y.sql", "")])).collect()) == [("table", "a", 2, ["b"]), ("view", "v", 4, [])]
    vue = '<template/>\n<script lang="ts">\nlet a\n</script>\n<script>b</script>'
    assert [(r["nr"], r["lang"], r["line"]) for r in m.embedded_scripts(named(spark, [("a.vue", vue)])).orderBy("nr").collect()] == [(0, "ts", 2), (1, "js", 5)]
    hcl = 'resource "aws_x" "y" {\n  size = 3\n  name = "n"\n}\nlocals {\n a = 1\n}\n'
    assert sorted((r["block"], r["type"], r["name"], tuple(sorted(r["attributes"].items()))) for r in m.hcl_blocks(named(spark, [("a.tf", hcl)])).collect()) == [("locals", None, None, (("a", "1"),)), ("resource", "aws_x", "y", (("name", "n"), ("size", "3")))]
    t = m.toolchain(named(spark, [("Dockerfile", "FROM --platform=x node:18 AS b\nFROM alpine\n"), (".github/workflows/ci.yml", "    - uses: actions/checkout@v4\n"), ("m.tf", 'source = "x/y"\n')]))
    assert {(r["tool"], r["ref"]) for r in t.collect()} == {("docker", "node:18"), ("docker", "alpine"), ("actions", "actions/checkout@v4"), ("terraform", "x/y")}
    assert {(r["model"], r["field"], r["type"]) for r in m.prisma(named(spark, [("s.prisma", "model User {\n  id Int @id\n  posts Post[]\n}\n")])).collect()} == {("User", "id", "Int"), ("User", "posts", "Post[]")}
    assert {(r["section"], r["key"], r["value"]) for r in m.toml_values(named(spark, [("a.toml", 'a = 1\n[b.c]\nd = "e" # x\n')])).collect()} == {("", "a", "1"), ("b.c", "d", "e")}


def test_coverage_and_advisories(spark):
    a = "SF:a.ts\nDA:1,0\nDA:2,5\nend_of_record\nSF:b.ts\nDA:1,1\nend_of_record\n"
    got = {(r["file"], r["line"]): r["hits"] for r in m.lcov(named(spark, [("l1", a), ("l2", "SF:a.ts\nDA:1,3\nend_of_record\n")])).collect()}
    assert got == {("a.ts", 1): 3, ("a.ts", 2): 5, ("b.ts", 1): 1}
    j = '{"a.ts": {"statementMap": {"0": {"start": {"line": 1}, "end": {"line": 2}}, "1": {"start": {"line": 2}, "end": {"line": 2}}}, "s": {"0": 1, "1": 4}}}'
    assert {(r["line"]): r["hits"] for r in m.istanbul(named(spark, [("c", j)])).collect()} == {1: 1, 2: 4}
    o = '{"id": "X-1", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}], "database_specific": {"severity": "HIGH"}, "affected": [{"package": {"ecosystem": "npm", "name": "left"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}]}]}]}'
    assert sorted((r["package"], str(r["introduced"]), str(r["fixed"]), r["severity"]) for r in m.osv(named(spark, [("o", o), ("bad", "{")])).collect()) == [("left", "2.0", "None", "high"), ("left", "None", "1.2", "high")]


def test_export_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("a", "class", 'q"\\', "f.ts"), ("b", None, None, None)], "id string, kind string, name string, file string")
    e = spark.createDataFrame([("call", "a", "b")], "kind string, src string, dst string")
    for form in export.FORMATS:
        export.write(n, e, form, str(tmp_path / form))
        assert spark.read.text(str(tmp_path / form)).count() == 3
    import json

    back = [json.loads(r["value"]) for r in export.lines(n, e, "ndjson").collect()]
    assert {"type": "node", "id": "a", "kind": "class", "name": 'q"\\', "file": "f.ts"} in back
    assert export.sarif(spark.createDataFrame([("r", "error", "m", "f", 3)], "rule string, level string, message string, file string, line int")).count() == 1
    assert "pkg:npm/x@1" in export.cyclonedx(spark.createDataFrame([("npm", "x", "1")], "ecosystem string, name string, version string")).first()["value"]
