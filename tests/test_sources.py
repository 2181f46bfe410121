"""Sources, sinks and record operators on small files and tables."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import records, text
from siltstone.sources import files, manifests, reports, rules, sinks


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_tree_scan(spark, tmp_path):
    for name in ("src/a.py", "src/b.js", "src/x.min.js", "node_modules/c.js", ".git/d.py", "top.py", "lib/jquery-3.1.js", "src/data.bin"):
        put(tmp_path, name, "x = 1\n# skip-me\n" if name == "src/a.py" else "y")
    found = files.scan(spark, str(tmp_path))
    assert {r.path: r.lang for r in found.collect()} == {"src/a.py": "python", "src/b.js": "javascript", "top.py": "python", "src/data.bin": None}
    assert {(r.folder, r.lang, r.n) for r in files.census(found).collect()} == {("src", "python", 1), ("src", "javascript", 1), (".", "python", 1)}
    lines = text.lines(found, "path", "text")
    assert {r.id for r in files.skip_marked(lines, "skip-me").collect()} == {"src/b.js", "top.py", "src/data.bin"}
    roots = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a",)], "root string")
    assert {r.root for r in files.collapse_roots(roots).collect()} == {"a", "ab"}


def test_reports(spark, tmp_path):
    sarif = {"runs": [{"results": [{"ruleId": "r1", "message": {"text": "m"}, "properties": {"tags": ["x", "cwe-79"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}]}, {"ruleId": "r2", "message": {"text": "n"}, "locations": []}]}]}
    got = reports.sarif(spark, put(tmp_path, "s.sarif", sarif), ["cwe-79", "cwe-89"]).orderBy("rule").collect()
    assert [(r.file, r.line, r.rule, r.family) for r in got] == [("a.py", 3, "r1", "cwe-79"), (None, None, "r2", None)]
    texts = spark.createDataFrame([('{"results": [{"line": 1}, {"line": 2}]}',), ("no json",), (None,)], "t string")
    assert reports.json_items(texts, "t", "struct<line:int>", "results").count() == 2
    truth = put(tmp_path, "t.csv", "# head\nCase1,sqli,true,89\nCase2,xss,false,79\n")
    assert [(r.name, r.real) for r in reports.truth_csv(spark, truth, "Case").collect()] == [("Case1", True), ("Case2", False)]
    clones = put(tmp_path, "c.csv", "lines,tokens,occurrences\n10,55,2,1,a.py,7,b.py\n")
    assert [(w.file, w.line) for w in reports.clone_csv(spark, clones).first()["where"]] == [("a.py", 1), ("b.py", 7)]
    metrics = put(tmp_path, "m.csv", '5,12,1,1,1,x,"a.py","f","f()",3,9\n5,2,1,1,1,x,"a.py","g","g()",8,9\nshort,99\n')
    assert [(r.function, r.ccn, r.line) for r in reports.metric_csv(spark, metrics).collect()] == [("f", 12, 3)]
    lints = put(tmp_path, "l.json", '{"reason":"compiler-message","message":{"code":{"code":"x"},"spans":[{"file_name":"a.rs","line_start":4}]}}\n{"reason":"other"}\n')
    assert [tuple(r) for r in reports.compiler_messages(spark, lints, ["x"]).collect()] == [("a.rs", 4, "x")]
    dot = spark.createDataFrame([('digraph { "a.b" -> "c";\n d -> e\n }',)], "t string")
    assert {tuple(r) for r in reports.arrow_edges(dot, "t").collect()} == {("a.b", "c"), ("d", "e")}
    nested = spark.createDataFrame([(json.dumps({"name": "f", "kind": "unit", "start_line": 1, "spaces": [{"name": "g", "kind": "function", "start_line": 2, "spaces": [{"name": "h", "kind": "closure", "start_line": 3, "spaces": []}]}]}),)], "t string")
    assert [r.name for r in reports.nested_spaces(nested, "t").orderBy("start_line").collect()] == ["f", "g", "h"]


def test_inventories(spark):
    given = [
        ("requirements-dev.txt", "flask==2.0 ; python\n# x\nrequests[sec]==1.1\nloose>=3\n"),
        ("package-lock.json", json.dumps({"packages": {"": {"version": "1"}, "node_modules/@a/b": {"version": "3.1"}}})),
        ("yarn.lock", '"@s/x@^1.0":\n  version "1.2"\nlodash@4:\n  version: 4.1\n'),
        ("Gemfile.lock", "GEM\n  specs:\n    rack (2.2.1)\n      dep (>= 1)\n"),
        ("composer.lock", json.dumps({"packages": [{"name": "v/p", "version": "v1.0"}]})),
        ("go.sum", "ex.com/m v1.2.0 h1:abc=\nex.com/m v1.2.0/go.mod h1:def=\n"),
        ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0"\n'),
        ("Pipfile.lock", json.dumps({"default": {"attrs": {"version": "==21.1"}}})),
        ("readme.md", "flask==9"),
    ]
    got = {(r.ecosystem, r.name, r.version) for r in manifests.inventory(spark.createDataFrame(given, "path string, text string")).collect()}
    assert got == {("PyPI", "flask", "2.0"), ("PyPI", "requests", "1.1"), ("npm", "@a/b", "3.1"), ("npm", "@s/x", "1.2"), ("npm", "lodash", "4.1"), ("RubyGems", "rack", "2.2.1"), ("Packagist", "v/p", "1.0"), ("Go", "ex.com/m", "1.2.0"), ("crates.io", "serde", "1.0"), ("PyPI", "attrs", "21.1")}


def test_poms(spark):
    pom = "<project><properties><x.version>1.5</x.version></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>9</version></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${x.version}</version></dependency><dependency><groupId>g</groupId><artifactId>m</artifactId></dependency></dependencies></project>"
    got = manifests.poms(spark.createDataFrame([("pom.xml", pom)], "path string, text string"))
    assert {(r.name, r.version, r.managed) for r in got.collect()} == {("g:a", "1.5", False), ("g:m", "", False), ("g:m", "9", True)}
    fixed = manifests.managed_versions(got.where("not managed"), got.where("managed"))
    assert {(r.name, r.version) for r in fixed.collect()} == {("g:a", "1.5"), ("g:m", "9")}


def test_poms_read_a_file_once(spark):
    """A large file is read once, and its dependencies don't carry it."""
    dep = "<dependency><groupId>g</groupId><artifactId>a{}</artifactId><version>${{project.version}}</version></dependency>"
    deps = lambda numbers: "<dependencies>" + "".join(map(dep.format, numbers)) + "</dependencies>"
    pom = f"<project><parent><groupId>g</groupId><artifactId>p</artifactId><version>3</version></parent><dependencyManagement>{deps(range(50))}</dependencyManagement>{deps(range(50, 3000))}</project>"
    files = [("pom.xml", pom), ("x/pom.xml", "<project><version>1</version></project>"), ("y/pom.xml", "no project"), ("z/pom.xml", None)]
    got = manifests.poms(spark.createDataFrame(files, "path string, text string")).where("parent = 'g:p'")
    assert {(r.name, r.managed) for r in got.collect()} == {(f"g:a{i}", i < 50) for i in range(3000)}
    assert {tuple(r) for r in got.select("version", "exclusions", "parent_version", "manifest").withColumn("exclusions", F.size("exclusions")).distinct().collect()} == {("3", 0, "3", "pom.xml")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml(") == 1
    assert not any("project#" in line for line in plan.splitlines() if "Generate explode" in line)


def test_yaml_subset(spark):
    assert rules.parse_yaml('a:\n  b: [1, "x # y"]\n  c: true # note\nd:\n  - e: 1\n    f: two\n  - g\nh: "q: r"\n') == {"a": {"b": [1, "x # y"], "c": True}, "d": [{"e": 1, "f": "two"}, "g"], "h": "q: r"}
    for bad, line in (("a: 1\na: 2\n", 2), ("a:\n  b: 1\n    c: 2\n", 3), ("a: [1\n", 1), ("just text\n", 1)):
        with pytest.raises(rules.YamlError, match=f"line {line}"):
            rules.parse_yaml(bad)
    df = spark.createDataFrame([("x.yml", "a:\n  - b: 1\n"), ("y.yml", "a: 1\na: 2\n")], "path string, text string")
    assert {(r.path, r.key, r.value, r.error) for r in rules.yaml_leaves(df).collect()} == {("x.yml", "a[0].b", "1", None), ("y.yml", None, None, "line 2: key a is there twice")}


def test_rules_and_documents(spark):
    toml = '[[rules]]\nid = "r"\nregex = \'\'\'(?i)ab(?s)c\\Z\'\'\'\nentropy = 3\nkeywords = ["AB"]\n'
    r = rules.toml_rules(spark, toml).first()
    assert (r.regex, r.entropy, r.keywords) == (r"(?is)abc\z", 3.0, ["ab"])
    md = "---\nid: REQ-0001\nstatus: open\ncovers: [TS-0001, TS-0002]\n---\n# T\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    docs = spark.createDataFrame([("x.md", md), ("y.md", "---\nid: REQ-0001\ncovers: []\n---\nz"), ("z.md", "---\nid: TS-0001\n---\n")], "path string, text string")
    front = rules.front_matter(docs)
    assert front.where("path = 'x.md'").first()["covers"] == ["TS-0001", "TS-0002"]
    assert {(r.path, r.problem) for r in records.dangling(front).collect()} == {("x.md", "no such id"), ("y.md", "id defined before")}
    assert [r.cells for r in rules.markdown_tables(docs).orderBy("line").collect()] == [["a", "b"], ["1", "2"]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("npm", "@a/b", "1", "MIT"), ("PyPI", "x", "2", None)], "ecosystem string, name string, version string, licence string")
    bom = [json.loads(r.value) for r in sinks.cyclonedx(df).collect()]
    assert bom[0]["purl"] == "pkg:npm/%40a/b@1" and bom[0]["licenses"][0]["license"]["id"] == "MIT" and "licenses" not in bom[1]
    assert [json.loads(r.value)["licenseDeclared"] for r in sinks.spdx(df).collect()] == ["MIT", "NOASSERTION"]
    sinks.write_markdown(df.orderBy("name"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()][0] == "| ecosystem | name | version | licence |"
    sinks.write_json(df, str(tmp_path / "j"), "ecosystem")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.upsert(df, df.where("name = 'x'").withColumn("version", F.lit("3")), "name").where("version = '3'").count() == 1
    tagged = spark.createDataFrame([("",), (None,), ("[test]",)], "tag string")
    assert sinks.gate(tagged) == (True, 2) and sinks.gate(tagged.where("tag = '[test]'")) == (False, 0)


def test_package_resolution(spark):
    wanted = spark.createDataFrame([("app", "1")], "name string, version string")
    requires = spark.createDataFrame([("app", "1", "a", "1"), ("a", "1", "b", "1"), ("b", "2", "c", "1"), ("app", "1", "x", "1"), ("x", "1", "y", "1")], "name string, version string, dep string, dep_version string")
    managed = spark.createDataFrame([("b", "2")], "name string, version string")
    excluded = spark.createDataFrame([("app", "x")], "root string, name string")
    got = records.resolve_packages(wanted, requires, managed, excluded)
    assert {(r.name, r.version, r.depth) for r in got.collect()} == {("app", "1", 0), ("a", "1", 1), ("b", "2", 2), ("c", "1", 3)}


def test_taint_paths(spark):
    flow = [("in", "x", "assign"), ("x", "y", "call"), ("y", "z", "call"), ("z", "w", "call"), ("x", "c", "clean"), ("c", "s3", "assign"), ("z", "s1", "assign"), ("w", "s2", "assign")]
    got = records.taint_paths(spark.createDataFrame([("in",)], "var string"), spark.createDataFrame(flow, "src string, dst string, kind string"), spark.createDataFrame([("s1", "sql"), ("s2", "sql"), ("s3", "sql")], "var string, kind string"))
    assert [tuple(r) for r in got.collect()] == [("in", "s1", "sql", 2)]


def test_names_and_contracts(spark):
    calls = spark.createDataFrame([(1, "a", "f", None), (2, "a", "g", "b"), (3, "a", "h", None)], "id int, file string, name string, imported string")
    defs = spark.createDataFrame([(10, "a", "f"), (11, "b", "f"), (12, "b", "g"), (13, "c", "h")], "def_id int, file string, name string")
    assert {tuple(r) for r in records.name_resolution(calls, defs).collect()} == {(1, 10), (2, 12)}
    old = spark.createDataFrame([("f", "f(a, b)"), ("g", "g(a)"), ("h", "h()"), ("k", "k(x: dict[str, int])")], "name string, signature string")
    new = spark.createDataFrame([("f", "f(a, b, c=1)"), ("g", "g(a, b)"), ("k", "k(x: dict[str, int], y=2)")], "name string, signature string")
    assert {tuple(r) for r in records.contract_changes(old, new).collect()} == {("g", "changed"), ("h", "removed")}
    tree = spark.createDataFrame([("src/a/x.py",), ("src/b.py",), ("z.py",)], "path string")
    parts = spark.createDataFrame([("all", "^src(/.*)?$", 1), ("a", "^src/a(/.*)?$", 2)], "name string, pattern string, depth int")
    assert {tuple(r) for r in records.implied_files(parts, tree).collect()} == {("src/a/x.py", "a"), ("src/b.py", "all")}
