"""Queries over records: severities, licences, packages, policies, seats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import severity
from siltstone.functions.licences import expression_class, undecided
from siltstone.functions.packages import package_url
from siltstone.functions.versions import fixed_version
from siltstone.plans.bindings import FINDINGS, findings, table
from siltstone.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 101) / 10 END AS score FROM part),
l AS (SELECT CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score >= 0.1 THEN 'low' ELSE 'none' END AS severity FROM s)
SELECT severity, count(*) AS n, list_position(['none', 'low', 'unknown', 'medium', 'high', 'critical'], severity) - 1 >= 2 AS gated FROM l GROUP BY severity""")
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("p_partkey") % 13 == 0, None).otherwise((F.col("p_partkey") % 101) / 10)
    told = table(spark, sf_dir, "part").select(severity.label(score).alias("severity"))
    return told.groupBy("severity").agg(F.count("*").alias("n")).withColumn("gated", severity.at_or_above(F.col("severity"), "unknown"))


PARTS = ["AV:N AV:A AV:L AV:P", "AC:L AC:H", "PR:N PR:L PR:H", "UI:N UI:R", "S:U S:C", "C:H C:L C:N", "I:H I:L I:N", "A:H A:L A:N"]


DIGITS = "p_partkey // {0} % {1}"


def _weighed(metric: str, place: int) -> str:
    """SQL of a metric's weight by the digit of the part key that spells it."""
    options = PARTS[place].split()
    scale = 1
    for part in PARTS[:place]:
        scale *= len(part.split())
    weights = [severity.WEIGHTS[metric][x.split(":")[1]] for x in options]
    return f"({weights})[{DIGITS.format(scale, len(options))} + 1]"


@query(f"""WITH v AS (SELECT p_partkey AS id, {_weighed("AV", 0)} AS av, {_weighed("AC", 1)} AS ac, {_weighed("PR", 2)} AS pr, {_weighed("PR_CHANGED", 2)} AS prc, {_weighed("UI", 3)} AS ui, ({DIGITS.format(48, 2)}) = 1 AS changed,
  {_weighed("C", 5)} AS c, {_weighed("I", 6)} AS i, {_weighed("A", 7)} AS a FROM part),
b AS (SELECT id, changed, 1 - (1 - c) * (1 - i) * (1 - a) AS iss, 8.22 * av * ac * (CASE WHEN changed THEN prc ELSE pr END) * ui AS ease FROM v),
m AS (SELECT id, changed, ease, CASE WHEN changed THEN 7.52 * (iss - 0.029) - 3.25 * power(iss - 0.02, 15) ELSE 6.42 * iss END AS impact FROM b),
t AS (SELECT id, CASE WHEN impact <= 0 THEN 0 ELSE round(least((CASE WHEN changed THEN 1.08 ELSE 1.0 END) * (impact + ease), 10) * 100000)::BIGINT END AS whole FROM m)
SELECT id, CASE WHEN whole % 10000 = 0 THEN whole / 100000.0 ELSE (whole // 10000 + 1) / 10.0 END AS score FROM t""")
def cvss_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors spelled from part keys, scored; the SQL computes the specification's formula from the same digits."""
    rest, pieces = F.col("p_partkey"), []
    for part in PARTS:
        options = part.split()
        pieces.append(F.element_at(F.array(*map(F.lit, options)), (rest % len(options) + 1).cast("int")))
        rest = F.floor(rest / len(options))
    vector = F.concat_ws("/", F.lit("CVSS:3.1"), *pieces)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), vector.alias("vector")).select("id", severity.base_score(F.col("vector")).alias("score"))


EXPRESSIONS = ["MIT", "MIT OR GPL-3.0", "Apache-2.0 AND LGPL-2.1", "GPL-2.0", "Proprietary", "UNKNOWN", "MPL-2.0 OR (MIT AND GPL-3.0)", "BSD-3-Clause AND MIT"]
EXPECTED = ["permissive", "permissive", "weak", "strong", "proprietary", "unknown", "weak", "permissive"]


@query(f"""WITH e AS (SELECT ({EXPRESSIONS!r})[p_size % 8 + 1] AS expression, ({EXPECTED!r})[p_size % 8 + 1] AS class FROM part)
SELECT expression, class, count(*) AS n, class IN ('strong', 'proprietary', 'unknown') AND expression <> 'GPL-2.0' AS undecided FROM e GROUP BY ALL""")
def licence_expression_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, EXPRESSIONS)), F.col("p_size") % 8 + 1)
    told = table(spark, sf_dir, "part").select(pick.alias("expression")).groupBy("expression").agg(F.count("*").alias("n"))
    told = told.withColumn("class", expression_class(F.col("expression")))
    return told.withColumn("undecided", undecided(F.col("class"), F.col("expression"), ["GPL-2.0"])).select("expression", "class", "n", "undecided")


@query("""WITH e AS (SELECT p_partkey, (['npm', 'PyPI', 'RubyGems', 'crates.io', 'Maven'])[p_partkey % 5 + 1] AS eco, (['@scope/', 'Pkg', 'gem', 'crate', 'org.x:'])[p_partkey % 5 + 1] || p_partkey AS name FROM part)
SELECT p_partkey AS id, 'pkg:' || (['npm', 'pypi', 'gem', 'cargo', 'maven'])[p_partkey % 5 + 1] || '/' || CASE eco WHEN 'npm' THEN replace(name, '@', '%40') WHEN 'PyPI' THEN lower(name) WHEN 'Maven' THEN replace(name, ':', '/') ELSE name END || '@1.0' AS purl FROM e""")
def package_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(pick("@scope/", "Pkg", "gem", "crate", "org.x:"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), package_url(pick("npm", "PyPI", "RubyGems", "crates.io", "Maven"), name, F.lit("1.0")).alias("purl"))


FIXES = ["1.2", "1.10", "2.3", "2.20.1", "3.0"]
AS_NUMBERS = "list_transform(string_split({}, '.'), lambda v: v::INT)"


@query(f"""WITH c AS (SELECT DISTINCT p_size AS id, p_size % 5 || '.' || p_size % 13 AS cur FROM part), f AS (SELECT unnest({FIXES!r}) AS fix),
m AS (SELECT id, min_by(fix, {AS_NUMBERS.format("fix")}) FILTER (string_split(fix, '.')[1] = string_split(cur, '.')[1] AND {AS_NUMBERS.format("fix")} > {AS_NUMBERS.format("cur")}) AS own, max_by(fix, {AS_NUMBERS.format("fix")}) AS top FROM c, f GROUP BY id)
SELECT id, coalesce(own, top) AS fixed FROM m""")
def fixed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix above the current version on its branch, else the highest."""
    size = F.col("p_size")
    current = F.concat_ws(".", (size % 5).cast("string"), (size % 13).cast("string"))
    rows = table(spark, sf_dir, "part").select(size.alias("id"), current.alias("cur")).distinct()
    return rows.select("id", fixed_version(F.array(*map(F.lit, FIXES)), F.col("cur")).alias("fixed"))


@query("""WITH s AS (SELECT o_custkey AS id, o_orderkey AS step, o_orderpriority IN ('1-URGENT', '2-HIGH') AS required, o_orderstatus <> 'P' AS passed FROM orders)
SELECT id, count(*) AS steps, bool_and(passed OR NOT required) AS closes, count(*) FILTER (NOT passed AND NOT required) AS advice FROM s GROUP BY id""")
def policy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    required, passed = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("steps"), F.bool_and(passed | ~required).alias("closes"), F.count_if(~passed & ~required).alias("advice"))


@query(f"""WITH {FINDINGS}, h AS (SELECT file AS seat, max(line) AS beat, max_by(engine, {{'l': line, 'i': id}}) AS last FROM fnd GROUP BY file), n AS (SELECT max(line) AS now FROM fnd)
SELECT seat, now - beat AS age, CASE WHEN last = 'error' THEN 'dead' WHEN now - beat > 240 THEN 'expired' ELSE 'live' END AS status FROM h, n""")
def seat_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event per user as heartbeat, four hours of lease; an error as last event stands for a gone process."""
    found = findings(spark, sf_dir)
    seats = found.groupBy(F.col("file").alias("seat")).agg(F.max("line").alias("beat"), F.max_by("engine", F.struct("line", "id")).alias("last"))
    aged = seats.join(F.broadcast(found.agg(F.max("line").alias("now")))).withColumn("age", F.col("now") - F.col("beat"))
    return aged.select("seat", "age", F.when(F.col("last") == "error", "dead").when(F.col("age") > 240, "expired").otherwise("live").alias("status"))


@query(f"""WITH {FINDINGS} SELECT project, count(*) AS findings, count(*) FILTER (engine = 'error') AS live, count(*) FILTER (engine = 'error') > 0 AS fails FROM fnd GROUP BY project""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.count_if(F.col("engine") == "error")
    return findings(spark, sf_dir).groupBy("project").agg(F.count("*").alias("findings"), live.alias("live"), (live > 0).alias("fails"))


@query("""WITH p AS (SELECT c_custkey, 'src/' || n_name || '/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'tests/' WHEN 'MACHINERY' THEN 'docs/' ELSE '' END || c_custkey || '.py' AS path, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN regexp_matches(path, '(^|/)tests?/') THEN '[test]' WHEN regexp_matches(path, '(^|/)docs/') THEN '[docs]' WHEN c_acctbal < 0 THEN '[accepted]' ELSE '' END AS tag, count(*) AS n FROM p GROUP BY 1""")
def status_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    middle = F.when(F.col("c_mktsegment") == "BUILDING", "tests/").when(F.col("c_mktsegment") == "MACHINERY", "docs/").otherwise("")
    path = F.concat(F.lit("src/"), F.col("n_name"), F.lit("/"), middle, F.col("c_custkey").cast("string"), F.lit(".py"))
    told = c.join(n, c.c_nationkey == n.n_nationkey).select(path.alias("path"), "c_acctbal")
    tag = F.when(F.col("path").rlike("(^|/)tests?/"), "[test]").when(F.col("path").rlike("(^|/)docs/"), "[docs]").when(F.col("c_acctbal") < 0, "[accepted]").otherwise("")
    return told.groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))
