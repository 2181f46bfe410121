"""Operators over facts, rules and isolations on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.operators import bands, facts, isolations, records, rules, scoring
from siltstone.sources.rules import secret_rules


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_written_tables(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    table = scratch.cut(df)
    assert rows(table, "id", "k") == rows(df, "id", "k")
    system = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    there = lambda: system.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(system)
    assert there()
    scratch.drop(table, None, df)
    assert not there()
    many = scratch.Gathered(spark.range(1).toDF("x"))
    for k in range(1, 20):
        many.add(spark.range(k, k + 1).toDF("x"))
    assert rows(many.all(), "x") == sorted([(k,) for k in range(20)], key=str) and len(many.tables) < 10
    assert spark.conf.get(scratch.CLEANUP) == "false"


DECLARED = [("shop", "src"), ("shop.cart", "src/cart"), ("shop.store", "src/store"), ("shop.store.disk", "src/store/disk"), ("tools", "tools")]
OPENED = [("shop.cart", ".", "accepted"), ("shop.store", ".", "accepted"), ("shop.store", "api/v2", "accepted"), ("shop.store", "disk", "rejected"), ("shop.store.disk", ".", "accepted"), ("tools", "deep", "proposed")]
# Edges and the parts that they violate: deeper than a frontier, through a rejected folder, from the part around it.
JUDGED = [
    ("src/run.py", "src/cart/a.py", ""), ("src/run.py", "src/cart/own/a.py", "shop.cart"), ("src/cart/a.py", "src/store/a.py", ""), ("src/cart/a.py", "src/store/api/a.py", ""),
    ("src/cart/a.py", "src/store/api/v2/a.py", ""), ("src/cart/a.py", "src/store/api/v2/x/a.py", "shop.store"), ("src/cart/a.py", "src/store/api/v1/a.py", "shop.store"),
    ("src/cart/a.py", "src/store/disk/a.py", "shop.store"), ("src/store/b.py", "src/store/disk/a.py", ""), ("src/store/b.py", "src/store/disk/in/a.py", "shop.store.disk"),
    ("src/store/disk/a.py", "src/store/api/v9/z/a.py", ""), ("src/run.py", "tools/very/deep/a.py", ""),
]


def test_frontiers(spark):
    parts, frontiers = spark.createDataFrame(DECLARED, "name string, path string"), spark.createDataFrame(OPENED, "name string, folder string, status string")
    edges = spark.createDataFrame([x[:2] for x in JUDGED], "src string, dst string")
    assert {(r.src, r.dst): r.names for r in isolations.violations(edges, parts, frontiers).collect()} == {x[:2]: x[2] for x in JUDGED if x[2]}
    tests = F.col("src").startswith("src/run")
    offered = isolations.proposal(edges, parts, tests)
    assert {(r.name, r.folder) for r in offered.collect() if r.name == "shop.store"} == {("shop.store", "."), ("shop.store", "api/v2/x"), ("shop.store", "api/v1"), ("shop.store", "disk")}
    accepted = offered.select("name", "folder", F.lit("accepted").alias("status"))
    assert isolations.violations(edges.where(~tests), parts, accepted).collect() == []
    assert rows(isolations.unused(edges, parts, accepted.unionByName(spark.createDataFrame([("shop.cart", "own", "accepted")], accepted.schema)), tests), "name", "folder") == [("shop.cart", "own")]
    held = isolations.owners(edges.select(F.col("dst").alias("path")), parts.unionByName(spark.createDataFrame([("other", "src/store/disk/in")], parts.schema)))
    assert {r.path: (r.name, r.error) for r in held.collect()}["src/store/disk/in/a.py"] == ("other", True)
    may = isolations.context(edges.select(F.col("dst").alias("path")), parts, frontiers, "shop.cart")
    assert {r.path: r.reason for r in may.collect()} == {"src/cart/a.py": "own", "src/cart/own/a.py": "own", "src/store/a.py": "visible", "src/store/api/a.py": "visible", "src/store/api/v2/a.py": "visible", "tools/very/deep/a.py": "open"}


def test_data_boundary(spark):
    tokens = spark.createDataFrame([("pay/a.py", 1, "pan", False), ("web/b.py", 2, "pan", False), ("web/b.py", 3, "pan", True), ("web/b.py", 4, "name", False)], "file string, line long, name string, comment boolean")
    held = spark.createDataFrame([("pay/a.py", "pay"), ("web/b.py", "web")], "path string, name string")
    fields = spark.createDataFrame([("pan", "pay")], "field string, stays_in string")
    assert rows(isolations.data_outside(tokens, held, fields), "file", "line", "field") == [("web/b.py", 2, "pan")]
    assigns = spark.createDataFrame([("f", "one", 1, "x", "pan"), ("f", "one", 3, "x", "safe"), ("f", "two", 1, "y", "pan")], "file string, fn string, line long, local string, value string")
    sinks = spark.createDataFrame([("f", "one", 2, "x"), ("f", "one", 4, "x"), ("f", "one", 5, "y"), ("f", "two", 6, "pan")], "file string, fn string, line long, arg string")
    assert rows(isolations.data_sinks(sinks, assigns, fields), "file", "line", "field") == [("f", 2, "pan"), ("f", 6, "pan")]


def test_secret_rules(spark):
    text = """
[[rules]]
id = "k"
regex = '''key-([a-z0-9]{8,})'''
keywords = ["KEY-"]
entropy = 2
secretGroup = 1
[[rules.allowlists]]
stopwords = ["dummy"]
paths = ['''^lib/''']
[[rules]]
id = "whole"
regex = '''(?:tok)_[0-9]{6}'''
secretGroup = 0
path = '''[.]env$'''
[[rules]]
id = "pem"
path = '''[.]pem$'''
[[allowlists]]
condition = "AND"
regexTarget = "line"
regexes = ['''# ok''', '''0123456789abcdefghij01''']
paths = ['''^doc/''']
"""
    found, names, allowed = secret_rules(text)
    assert allowed[0].every and len(allowed[0].hashes) == 1 and names == [("pem", "[.]pem$")]
    given = [("src/a", 1, "KEY key-a1b2c3d4"), ("src/a", 2, "key-aaaaaaaa"), ("src/a", 3, "key-dummy123"), ("lib/a", 4, "key-a1b2c3d4"), ("x.env", 5, "tok_123456"), ("x.py", 6, "tok_123456"), ("doc/a", 7, "key-a1b2c3d4 # ok"), ("src/a", 8, "key-a1b2c3d4 # ok"), ("src/a", 9, "nothing")]
    lines = spark.createDataFrame(given, "path string, line long, text string")
    assert rows(rules.secret_findings(lines, found, allowed[:0]), "line", "rule", "secret") == [(1, "k", "a1b2c3d4"), (5, "whole", "tok_123456"), (7, "k", "a1b2c3d4"), (8, "k", "a1b2c3d4")]
    plain = rules.Allow(regexes=["# ok"], paths=["^doc/"], target="line", every=True)
    assert rows(rules.secret_findings(lines, found, [plain]), "line") == [(1,), (5,), (8,)]
    files = spark.createDataFrame([("a/x.pem",), ("a/x.py",)], "path string")
    assert rows(rules.secret_files(files, names), "path", "rule") == [("a/x.pem", "pem")]
    commits = spark.createDataFrame([(1, "a", "key-a1b2c3d4"), (2, "a", "x\nkey-a1b2c3d4"), (3, "b.png", "key-a1b2c3d4"), (9, "b", "key-z9y8x7w6")], "seq long, path string, text string")
    assert rows(rules.history_secrets(commits, found), "path", "secret", "first_seen") == [("a", "a1b2c3d4", 1), ("b", "z9y8x7w6", 9)]
    assert rows(rules.history_secrets(commits, found, last=3), "path") == [("b",)]


def test_neutralised_patterns_keep_their_meaning():
    pattern = r"token-[a-z-]{5,}xyzwvuts"
    assert re.search(pattern, pattern + "token-abcdexyzwvuts") and rules.neutralised("abc") == "abc"
    once = rules.neutralised(r"secretword[a-z]*")
    assert not re.search(once, once) and re.search(once, "secretwordx")


def test_scope_rules(spark):
    lines = spark.createDataFrame([("a.yml", 1, "m1", 1, "start"), ("a.yml", 1, "m1", 2, "guard"), ("a.yml", 1, "m2", 3, "start"), ("b.txt", 1, "m1", 4, "start")], "path string, x int, unit string, line long, text string")
    rule = [rules.ScopeRule("open", "^start", "^guard", r"\.yml$", "CWE-1")]
    assert rows(rules.scope_findings(lines, rule, "path", "unit"), "path", "unit", "line", "cwe") == [("a.yml", "m2", 3, "CWE-1")]
    assert rows(rules.scope_findings(lines, rule), "path") == []
    assert rows(rules.conjunctions(lines, [("both", "start", "guard")]), "path", "rule") == [("a.yml", "both")]
    assert rows(rules.after_marker(lines, "guard"), "path", "line") == [("a.yml", 3)] and rows(rules.repeated_marker(lines, "start"), "path", "line") == [("a.yml", 3)]


def test_calls_and_owners(spark):
    calls = spark.createDataFrame([(1, "a", "C", None, "f", None, None), (2, "a", "C", "self", "g", None, None), (3, "a", "C", "m", "h", None, "b"), (4, "a", "C", "item", "f", None, None), (5, "a", "C", None, "k", "b", None), (6, "a", "C", "D", "n", "b", None)], "id int, file string, cls string, receiver string, name string, imported string, module string")
    definitions = spark.createDataFrame([(10, "a", None, "f"), (11, "a", "C", "g"), (12, "b", None, "h"), (13, "b", None, "k"), (14, "b", "D", "n"), (15, "b", None, "f")], "def_id int, file string, cls string, name string")
    assert rows(facts.resolve_calls(calls, definitions), "id", "def_id") == [(1, 10), (2, 11), (3, 12), (5, 13), (6, 14)]
    methods = spark.createDataFrame([(1, "A", "go", 1), (2, "B", "go", 1), (3, "C", "go", 2), (4, "D", "run", 0), (5, "E", "run", 0)], "def_id int, cls string, name string, arity int")
    implements = spark.createDataFrame([("A", "I"), ("B", "I")], "cls string, type string")
    typed = spark.createDataFrame([(1, "I", "go", 1), (2, "A", "go", 1), (3, None, "go", 2), (4, None, "run", 0), (5, "C", "run", 0)], "id int, type string, name string, arity int")
    assert rows(facts.typed_calls(typed, methods, implements, most=1), "id", "def_id", "how") == [(1, 1, "type"), (1, 2, "type"), (2, 1, "type"), (3, 3, "name")]
    fields = spark.createDataFrame([("Note", "by", "User", False), ("Page", "note", "Note", False), ("Book", "page", "Page", False), ("Club", "all", "User", True)], "entity string, field string, type string, many boolean")
    assert rows(facts.owned_entities(fields), "entity", "through") == [("Note", None), ("Page", "note")]


def test_wrappers_and_leftovers(spark):
    shape = "id int, statements int, params array<string>, args array<string>, names array<string>, target string, decorated boolean, constructor boolean"
    none2 = [None, None]
    given = [(1, 1, ["a", "b"], ["a", "b"], none2, "t", False, False), (2, 1, ["a", "b"], ["b", "a"], none2, "t", False, False), (3, 1, ["a", "b"], ["b", "a"], ["b", "a"], "t", False, False), (4, 2, ["a"], ["a"], [None], "t", False, False), (5, 1, ["a"], ["a"], [None], "t", True, False), (6, 1, ["a"], ["a"], [None], "T", False, True), (7, 1, [], [], [], "t", False, False), (8, 1, ["a"], ["a", "1"], none2, "t", False, False)]
    assert rows(facts.wrappers(spark.createDataFrame(given, shape)), "id") == [(1,), (3,)]
    defs = spark.createDataFrame([("f", "s", "x", "variable"), ("f", "s", "_y", "variable"), ("f", "t", "x", "variable")], "file string, scope string, name string, kind string")
    uses = spark.createDataFrame([("f", "s", "x")], "file string, scope string, name string")
    assert rows(facts.leftovers(defs, uses), "scope", "name") == [("t", "x")]


def test_assembled_strings(spark):
    assigns = spark.createDataFrame([("f", "u", 1, "q", "select * from t where k = "), ("f", "u", 5, "q", None), ("f", "u", 7, "p", "/srv/"), ("f", "v", 1, "h", "<b>")], "file string, unit string, line long, name string, literal string")
    uses = spark.createDataFrame([("f", "u", 3, "q", "sql"), ("f", "u", 6, "q", "sql"), ("f", "u", 8, "p", "path"), ("f", "u", 9, "p", "sql"), ("f", "u", 48, "p", "path"), ("f", "u", 47, "p", "shell"), ("f", "w", 3, "h", "html")], "file string, unit string, line long, name string, sink string")
    assert rows(facts.assembled_uses(assigns, uses), "line", "def_line", "cwe") == [(3, 1, "CWE-89"), (47, 7, "CWE-78"), (8, 7, "CWE-22")]


def test_pairs_in_spans(spark):
    points = spark.createDataFrame([("f", 1, 12, "a"), ("f", 2, 12, "b"), ("f", 3, 13, "a"), ("f", 4, 99, "a")], "file string, id long, line long, name string")
    spans = spark.createDataFrame([("f", 1, 1, 50, None), ("f", 2, 10, 20, "a"), ("f", 3, 11, 20, "c"), ("f", 4, 60, 70, "a")], "file string, id long, start long, end long, name string")
    assert rows(bands.contained_pairs(points, spans, "file"), "id", "span_id") == [(1, 2), (2, 1)]


def test_asof_over_cells(spark):
    """Marks in other cells, in the same line, none above, and nulls; every cell width gives the same."""
    points = spark.createDataFrame([(k, "f" if k % 3 else "g", k * 7 % 90) for k in range(60)], "id long, file string, line long")
    marks = spark.createDataFrame([("f" if k % 2 else "g", k * 11 % 90, None if k % 5 == 0 else k) for k in range(20)], "file string, line long, value long")
    want = {}
    for p in points.collect():
        above = [(m.line, m.value) for m in marks.collect() if m.file == p.file and m.line <= p.line and m.value is not None]
        want[p.id] = max(above)[1] if above else None
    for cell in (1, 10, 4096):
        got = bands.asof_at_or_above(points, marks, "file", "line", "value", cell)
        assert {r.id: r.value for r in got.collect()} == want and set(got.columns) == {"id", "file", "line", "value"}


def test_loops_raise_when_they_do_not_settle(spark):
    chain = [(f"p{k}", "1", f"p{k + 1}", "1") for k in range(8)]
    requires = spark.createDataFrame(chain, "name string, version string, dep string, dep_version string")
    wanted = spark.createDataFrame([("p0", "1")], "name string, version string")
    none = spark.createDataFrame([], "name string, version string")
    excluded = spark.createDataFrame([], "root string, name string")
    assert records.resolve_packages(wanted, requires, none, excluded).count() == 9
    with pytest.raises(RuntimeError):
        records.resolve_packages(wanted, requires, none, excluded, rounds=3)
    flow = spark.createDataFrame([(f"v{k}", f"v{k + 1}", "assign") for k in range(8)], "src string, dst string, kind string")
    source, sink = spark.createDataFrame([("v0",)], "var string"), spark.createDataFrame([("v8", "sql")], "var string, kind string")
    assert records.taint_paths(source, flow, sink).count() == 1
    with pytest.raises(RuntimeError):
        records.taint_paths(source, flow, sink, rounds=3)


def test_small_record_operators(spark):
    scopes = spark.createDataFrame([(1, "a/b/**"), (2, "a/b/c.py"), (3, "a/bc"), (4, "a"), (5, "z")], "id int, path string")
    assert rows(records.scope_overlaps(scopes), "a", "b") == [(1, 2), (1, 4), (2, 4), (3, 4)]
    seats = spark.createDataFrame([(1, "x", True, 90, 20), (2, "x", False, 90, 20), (3, "y", True, 10, 20), (4, "x", True, 10, 20), (5, "y", False, None, 20)], "seat int, host string, alive boolean, heartbeat long, lease long")
    take = lambda force: {r.seat: (r.state, r.takeover) for r in records.seat_takeover(seats, F.lit("x"), F.lit(100), force).collect()}
    assert take(False) == {1: ("live", False), 2: ("dead", True), 3: ("expired", False), 4: ("expired", True), 5: ("free", True)} and take(True)[3] == ("expired", True)
    values = spark.createDataFrame([("a", 3), ("b", 1)], "k string, v int")
    assert rows(scoring.fold_max(values, spark.createDataFrame([("a", 2), ("b", 9), ("c", 5)], "k string, v int"), ["k"], "v"), "k", "v") == [("a", 3), ("b", 9)]
    assert [r.k for r in scoring.worst_first(values.withColumn("w", F.lit(4)), "v", "w", "k").collect()] == ["b", "a"]
