"""Column functions against specifications and answers of our own."""

import itertools
import re

from pyspark.sql import functions as F

from siltstone.functions import code, licences, packages, severity, strings, versions


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def scored(vector):
    """The public base score equations of CVSS 3.1 (section 7.1 and appendix A), in integers where rounding matters."""
    part = dict(p.split(":") for p in vector.split("/")[1:])
    weigh = lambda m: severity.WEIGHTS["PR_CHANGED" if m == "PR" and part["S"] == "C" else m][part[m]]
    base = 1 - (1 - weigh("C")) * (1 - weigh("I")) * (1 - weigh("A"))
    impact = 7.52 * (base - 0.029) - 3.25 * (base - 0.02) ** 15 if part["S"] == "C" else 6.42 * base
    if impact <= 0:
        return 0.0
    ease = 8.22 * weigh("AV") * weigh("AC") * weigh("PR") * weigh("UI")
    whole = round(min((1.08 if part["S"] == "C" else 1) * (impact + ease), 10) * 100_000)
    return whole / 100_000 if whole % 10_000 == 0 else (whole // 10_000 + 1) / 10


def test_cvss_over_all_vectors(spark):
    options = [("AV", "NALP"), ("AC", "LH"), ("PR", "NLH"), ("UI", "NR"), ("S", "UC"), ("C", "HLN"), ("I", "HLN"), ("A", "HLN")]
    vectors = ["CVSS:3.1/" + "/".join(f"{m}:{v}" for (m, _), v in zip(options, combo, strict=True)) for combo in itertools.product(*(o for _, o in options))]
    assert values(spark, vectors, severity.base_score) == [scored(v) for v in vectors]
    # Three examples that the public user guide scores.
    known = {"CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 8.8, "CVSS:3.0/AV:L/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:H": 7.8, "CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 6.8}
    assert values(spark, list(known), severity.base_score) == list(known.values())
    wrong = ["CVSS:4.0/AV:N/AC:L", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", ""]
    assert values(spark, wrong, severity.base_score) == [None] * 4


def test_severity_bands(spark):
    """The label changes exactly at the public bounds, a tenth apart."""
    bounds = {"critical": 90, "high": 70, "medium": 40, "low": 1, "none": 0}
    tenths = list(range(101))
    df = spark.createDataFrame([(t, t / 10) for t in tenths], "t int, s double")
    got = [r[1] for r in df.select("t", severity.label(F.col("s"))).orderBy("t").collect()]
    assert got == [next(name for name, low in bounds.items() if t >= low) for t in tenths]
    assert values(spark, [" Moderate ", "LOW", "catastrophic", None], severity.normal_label) == ["medium", "low", "unknown", "unknown"]
    ranks = values(spark, severity.RANKS, severity.rank)
    assert ranks == sorted(ranks) and values(spark, severity.RANKS, lambda c: severity.at_or_above(c, "medium")) == [False] * 3 + [True] * 3


def test_licences(spark):
    given = ["Zlib", "ISC OR AGPL-3.0", "EPL-2.0 AND BSD-2-Clause", "(LGPL-3.0 OR AGPL-3.0) AND ISC", "Commercial", " the MIT License ", None, "Mitel licence", "Apachean", "License :: OSI Approved :: Apache Software License"]
    assert values(spark, given, licences.expression_class) == ["permissive", "permissive", "weak", "weak", "proprietary", "permissive", "unknown", "unknown", "unknown", "permissive"]


def test_version_order(spark):
    given = ["3.0-beta", "3.0", "3.0.1", "0.9", "0.10", "00.11", "v1", "1.20231231235959123.0", "1.3", "", "main"]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    order = lambda **how: [r.v for r in df.orderBy(versions.version_key(F.col("v"), **how)).collect()]
    assert order() == ["", "main", "0.9", "0.10", "00.11", "v1", "1.3", "1.20231231235959123.0", "3.0", "3.0-beta", "3.0.1"]
    assert order(prerelease_first=True)[-3:] == ["3.0-beta", "3.0", "3.0.1"]
    fixes = F.array(F.lit("4.4"), F.lit("4.12"), F.lit("5.0"))
    assert values(spark, ["4.5", "4.12", "3.1", "5.0"], lambda c: versions.fixed_version(fixes, c)) == ["4.12", "5.0", "5.0", "5.0"]


def test_globs():
    match = lambda g, p: bool(re.match(strings.glob_regex(g), p))
    assert match("lib", "lib") and match("lib/", "lib/deep/x.rs") and not match("lib", "library/x.rs")
    assert match("lib/*.rs", "lib/x.rs") and not match("lib/*.rs", "lib/deep/x.rs") and match("lib/**/x.rs", "lib/x.rs") and match("**/x.rs", "a/b/x.rs") and not match("**/x.rs", "a/yx.rs")


def test_entropy_and_names(spark):
    texts = ["", "zzzz", "abab", "aabbccdd", "€€x", None]
    want = [0.0, 0.0, 1.0, 2.0, 0.918296, None]
    assert [None if v is None else round(v, 6) for v in values(spark, texts, strings.entropy)] == want
    assert values(spark, ["pkg/mod.py::Cls.run", "solo", "x::y"], strings.last_name) == ["run", "solo", "y"]
    ids = ["ADR-0007", "ADR-DATA-0007", "ADR-DTAA-0007", "ADR-7", "adr-0007", "ZZZ-0007"]
    assert values(spark, ids, lambda c: strings.id_problem(c, ["ADR"])) == [None, None, "domain", "digits", "shape", "prefix"]
    assert values(spark, ["DTAA", "CORE", "NOTHING"], lambda c: strings.nearest(c, strings.GLOSSARY)) == ["DATA", "CORE", None]
    assert values(spark, ["2h", "45m", "1d2h", "2h45m", "h", ""], strings.lease_minutes) == [120, 45, 1560, 165, None, None]


def test_two_test_rules(spark):
    paths = ["a/test/x.go", "fixtures/a.js", "a/x.spec.ts", "pkg/test_x.py", "src/contest/x.py", "a/FooTests.java"]
    assert values(spark, paths, strings.test_path) == [True, False, False, True, False, True]
    assert values(spark, paths, strings.test_folder_path) == [True, True, True, True, False, False]


def test_package_urls(spark):
    df = spark.createDataFrame([("npm", "@org/tool", "2.1"), ("PyPI", "PyYAML", "6"), ("Maven", "com.x:core", "9")], "e string, n string, v string")
    assert [r[0] for r in df.select(packages.package_url(F.col("e"), F.col("n"), F.col("v"))).collect()] == ["pkg:npm/%40org/tool@2.1", "pkg:pypi/pyyaml@6", "pkg:maven/com.x/core@9"]


def test_code_only(spark):
    python = 'a = "x # y" # z\n"""doc\nMARK"""\nb = \'it\\\'s\' + MARK # "'
    assert values(spark, [python], lambda c: code.code_only(c, F.lit("python"))) == ["a =  \n\n\nb =  + MARK "]
    java = "int a; // MARK \"\n/* MARK\n */ String s = \"// no\" + MARK;"
    assert values(spark, [java], lambda c: code.code_only(c, F.lit("java"))) == ["int a; \n\n String s =  + MARK;"]


def test_signatures(spark):
    assert values(spark, ["f(x: map[str, list[int]], y=(1, 2), cb=(a, b) => c)", "f()", "f(a)"], code.parameters) == [["x: map[str, list[int]]", "y=(1, 2)", "cb=(a, b) ⇒ c"], [], ["a"]]
    cases = [("(x)", "(x, y=0)", "python", True), ("(x)", "(x, y)", "python", False), ("(x)", "(x, y?: int)", "js", True), ("(x)", "(x, y?: int)", "python", False), ("(x)", "(x, y=0)", "rust", False), ("(x, y)", "(x)", "js", False), ("(x)", "(x, **more)", "python", True), ("(x)", "(z)", "js", False), ("(x)", "(x, f: () => int)", "js", False)]
    df = spark.createDataFrame(cases, "a string, b string, l string, want boolean")
    assert [r for r in df.select("want", code.compatible(F.col("a"), F.col("b"), F.col("l")).alias("got")).collect() if r.want != r.got] == []


def test_credentials(spark):
    assert values(spark, ["9f8e7d6c5b4a39281706abcd", "9f8e7d6c5b4a3928.706abcd", "abcdefabcdefabcdefabcdef", "short1"], code.credential_like) == [True, False, False, False]
