"""Join queries: band, interval, as-of, equi, anti and override joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.strings import glob_regex
from siltstone.operators import bands
from siltstone.operators.scoring import percent
from siltstone.plans.bindings import FINDINGS, findings, table
from siltstone.plans.registry import registry
from siltstone.sources.manifests import missing_installs

QUERIES, ORACLE_SQL, query = registry()
REACH = 360


@query(f"""WITH {FINDINGS},
o AS (SELECT *, EXISTS (SELECT 1 FROM fnd t WHERE t.engine = 'purchase' AND t.file = f.file AND abs(t.line - f.line) <= {REACH}) AS near FROM fnd f WHERE engine = 'error'),
t AS (SELECT *, EXISTS (SELECT 1 FROM fnd t WHERE t.engine = 'error' AND t.file = f.file AND abs(t.line - f.line) <= {REACH}) AS near FROM fnd f WHERE engine = 'purchase'),
a AS (SELECT project, count(*) AS ours, count(*) FILTER (near) AS ours_in_theirs FROM o GROUP BY 1),
b AS (SELECT project, count(*) AS theirs, count(*) FILTER (near) AS theirs_in_ours FROM t GROUP BY 1)
SELECT project, ours, theirs, ours_in_theirs, theirs_in_ours, ours - ours_in_theirs AS only_ours, theirs - theirs_in_ours AS only_theirs,
  round(100.0 * theirs_in_ours / theirs, 1) AS recall, round(100.0 * ours_in_theirs / ours, 1) AS precision FROM a JOIN b USING (project)""")
def band_match_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, theirs = findings(spark, sf_dir, "error"), findings(spark, sf_dir, "purchase")
    sides = [
        ours.groupBy("project").agg(F.count("*").alias("ours")),
        theirs.groupBy("project").agg(F.count("*").alias("theirs")),
        bands.band_semi(ours, theirs, ["file"], "line", REACH).groupBy("project").agg(F.count("*").alias("ours_in_theirs")),
        bands.band_semi(theirs, ours, ["file"], "line", REACH).groupBy("project").agg(F.count("*").alias("theirs_in_ours")),
    ]
    out = sides[0].join(sides[1], "project").join(sides[2], "project", "left").join(sides[3], "project", "left").na.fill(0)
    return out.withColumns(
        {
            "only_ours": F.col("ours") - F.col("ours_in_theirs"),
            "only_theirs": F.col("theirs") - F.col("theirs_in_ours"),
            "recall": percent(F.col("theirs_in_ours"), F.col("theirs")),
            "precision": percent(F.col("ours_in_theirs"), F.col("ours")),
        }
    )


@query(f"""WITH {FINDINGS} SELECT cls, count(*) AS n FROM fnd f WHERE engine = 'error'
AND EXISTS (SELECT 1 FROM fnd t WHERE t.engine = 'click' AND t.file = f.file AND t.cls = f.cls AND abs(t.line - f.line) <= 720) GROUP BY cls""")
def band_match_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bands.band_semi(findings(spark, sf_dir, "error"), findings(spark, sf_dir, "click"), ["file", "cls"], "line", 720)
    return found.groupBy("cls").agg(F.count("*").alias("n"))


SPANS = "spans AS (SELECT id AS s_id, file AS s_file, line AS s, line + 600 AS e FROM fnd WHERE engine = 'view')"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir, "view").select("id", "file", F.col("line").alias("start"), (F.col("line") + 600).alias("end"))


@query(f"""WITH {FINDINGS}, {SPANS}
SELECT id, s AS start FROM fnd JOIN spans ON file = s_file AND line BETWEEN s AND e WHERE engine = 'error' QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, e) = 1""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.innermost(findings(spark, sf_dir, "error"), _spans(spark, sf_dir), "file", "id", "line", "start", "end").select("id", F.col("s_start").alias("start"))


@query(f"""WITH {FINDINGS}, {SPANS}
SELECT id, s AS start, abs(line - s) AS distance FROM fnd JOIN spans ON file = s_file AND line BETWEEN s - 8 AND e WHERE engine = 'error'
QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(line - s), s, e) = 1""")
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bands.nearest_start(findings(spark, sf_dir, "error"), _spans(spark, sf_dir), "file", "id", "line", "start", "end")
    return found.select("id", F.col("s_start").alias("start"), "distance")


@query(f"""WITH {FINDINGS}
SELECT f.id, max_by(m.value, {{'l': m.line, 'v': m.value}}) AS value FROM fnd f LEFT JOIN fnd m ON m.engine = 'click' AND m.file = f.file AND m.line <= f.line
WHERE f.engine = 'error' GROUP BY f.id""")
def asof_at_or_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = findings(spark, sf_dir, "error").select("id", "file", "line")
    return bands.asof_at_or_above(points, findings(spark, sf_dir, "click"), "file", "line", "value").select("id", "value")


TWO_YEARS = """a AS (SELECT l_suppkey AS file, l_partkey AS name, max(l_quantity) AS ours FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY ALL),
b AS (SELECT l_suppkey AS file, l_partkey AS name, max(l_quantity) AS theirs FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY ALL)"""


def two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two metrics of the same functions (supplier = file, part = name), by shipping date."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("name"), "l_quantity", "l_shipdate")
    early = F.col("l_shipdate") < F.expr("timestamp_ntz'1996-01-01'")
    return lines.where(early).groupBy("file", "name").agg(F.max("l_quantity").alias("ours")), lines.where(~early).groupBy("file", "name").agg(F.max("l_quantity").alias("theirs"))


@query(f"""WITH {TWO_YEARS} SELECT file, count(*) FILTER (ours IS NOT NULL AND theirs IS NOT NULL) AS paired, count(*) FILTER (theirs IS NULL) AS only_ours,
count(*) FILTER (ours IS NULL) AS only_theirs FROM a FULL JOIN b USING (file, name) GROUP BY file""")
def equi_pair_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sides(spark, sf_dir)
    return a.join(b, ["file", "name"], "full").groupBy("file").agg(
        F.count_if(F.col("ours").isNotNull() & F.col("theirs").isNotNull()).alias("paired"), F.count_if(F.col("theirs").isNull()).alias("only_ours"), F.count_if(F.col("ours").isNull()).alias("only_theirs")
    )


@query(f"""WITH {FINDINGS}, t AS (SELECT project, EXISTS (SELECT 1 FROM fnd o WHERE o.engine IN ('purchase', 'click') AND o.file = f.file AND abs(o.line - f.line) <= 60) AS near FROM fnd f WHERE engine = 'error')
SELECT project, count(*) AS documented, count(*) FILTER (near) AS found, round(100.0 * count(*) FILTER (near) / count(*), 1) AS recall FROM t GROUP BY project""")
def any_near_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = findings(spark, sf_dir, "error")
    found = bands.band_semi(truth, findings(spark, sf_dir).where("engine in ('purchase', 'click')"), ["file"], "line", 60).groupBy("project").agg(F.count("*").alias("found"))
    out = truth.groupBy("project").agg(F.count("*").alias("documented")).join(found, "project", "left").na.fill(0)
    return out.withColumn("recall", percent(F.col("found"), F.col("documented")))


HOLDINGS = "g AS (SELECT DISTINCT p_brand AS g, l_suppkey AS f FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("p_brand").alias("g"), F.col("l_suppkey").alias("f")).distinct()


@query(f"""WITH {HOLDINGS}, n AS (SELECT g, count(*) AS n FROM g GROUP BY g)
SELECT x.g AS a, y.g AS b, count(*) AS shared FROM g x JOIN g y ON x.f = y.f AND x.g < y.g JOIN n nx ON nx.g = x.g JOIN n ny ON ny.g = y.g
GROUP BY x.g, y.g, nx.n, ny.n HAVING count(*) >= least(2, nx.n, ny.n)""")
def set_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _holdings(spark, sf_dir)
    sizes = held.groupBy("g").agg(F.count("*").alias("n"))
    x, y = held.select(F.col("g").alias("a"), "f"), held.select(F.col("g").alias("b"), "f")
    pairs = x.join(y, "f").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = pairs.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return out.where("shared >= least(2, na, nb)").select("a", "b", "shared")


@query("SELECT p_partkey AS id, p_name AS what FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(reported, "p_partkey", "left_anti").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("what"))


@query("""WITH c AS (SELECT l_suppkey AS tool, count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01') AS recorded, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01') AS measured FROM lineitem GROUP BY 1)
SELECT tool, recorded, measured FROM c WHERE recorded > 0 AND measured > 0 AND 10 * abs(recorded - measured) > greatest(10, measured)""")
def tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, cut = table(spark, sf_dir, "lineitem"), F.expr("timestamp_ntz'1996-01-01'")
    recorded = lines.where(F.col("l_shipdate") < cut).groupBy(F.col("l_suppkey").alias("tool")).agg(F.count("*").alias("recorded"))
    measured = lines.where(F.col("l_shipdate") >= cut).groupBy(F.col("l_suppkey").alias("tool")).agg(F.count("*").alias("measured"))
    return recorded.join(measured, "tool").where("10 * abs(recorded - measured) > greatest(10, measured)")


@query("SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def declared_not_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are declared names, those with a pending order are installed."""
    installed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("name"))
    return missing_installs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")), installed)


@query("""SELECT p_partkey AS package, p_brand AS manifest, count(DISTINCT l_suppkey) AS n, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS ids
FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY ALL""")
def advisories_per_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, hits = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount > 0.08")
    ids = F.sort_array(F.collect_set(F.col("l_suppkey").cast("string")))
    found = hits.join(parts, hits.l_partkey == parts.p_partkey).groupBy(F.col("p_partkey").alias("package"), F.col("p_brand").alias("manifest")).agg(ids.alias("ids"))
    return found.select("package", "manifest", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


LAYERS = {"signup": 0, "purchase": 1, "error": 2, "click": 3, "view": 4}


@query(f"""WITH {FINDINGS}, p AS (SELECT *, CASE engine {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LAYERS.items())} END AS pri FROM fnd)
SELECT file, cls, engine AS winner, id FROM p QUALIFY row_number() OVER (PARTITION BY file, cls ORDER BY pri, line DESC, id) = 1""")
def layered_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv)), F.col("engine"))
    first = F.min_by(F.struct("engine", "id"), F.struct(rank, -F.col("line"), F.col("id")))
    return findings(spark, sf_dir).groupBy("file", "cls").agg(first.alias("w")).select("file", "cls", F.col("w.engine").alias("winner"), "w.id")


GLOBS = {"all": "**", "europe": "EUROPE", "asia": "ASIA/**", "furniture": "**/FURNITURE", "asian_furniture": "ASIA/*/FURNITURE"}
PATHS = "paths AS (SELECT c_custkey AS id, r_name || '/' || n_name || '/' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {PATHS}, g(name, pattern, rx) AS (VALUES {", ".join(f"('{k}', '{v}', '{glob_regex(v)}')" for k, v in GLOBS.items())}),
m AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY length(pattern) DESC, name) AS r FROM paths JOIN g ON regexp_matches(path, rx))
SELECT name AS owner, count(*) AS n FROM m WHERE r = 1 GROUP BY name""")
def glob_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest matching glob owns a path; the globs are parameters, tested in one pass over the paths."""
    order = sorted(GLOBS, key=lambda k: (-len(GLOBS[k]), k))
    owner = F.coalesce(*(F.when(F.col("path").rlike(glob_regex(GLOBS[k])), k) for k in order))
    return paths(spark, sf_dir).select(owner.alias("owner")).where("owner is not null").groupBy("owner").agg(F.count("*").alias("n"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files below region/nation/segment."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    told = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return told.select(F.col("c_custkey").alias("id"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"), "c_acctbal")


@query(f"""WITH {HOLDINGS} SELECT x.f AS a, y.f AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.f < y.f GROUP BY ALL HAVING count(*) >= 12""")
def scope_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.shared_members(_holdings(spark, sf_dir), 12)


@query("""WITH s AS (SELECT o_custkey AS id, count(*) AS specs, count(*) FILTER (o_orderstatus = 'F') AS automated FROM orders GROUP BY 1),
i AS (SELECT o_custkey AS id, count(*) AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT c_custkey AS id, coalesce(specs, 0) AS specs, coalesce(code, 0) AS code,
CASE WHEN specs IS NULL THEN 'no test spec' WHEN code IS NULL THEN 'no code' WHEN automated = 0 THEN 'spec not automated' ELSE '' END AS gap
FROM customer LEFT JOIN s ON s.id = c_custkey LEFT JOIN i ON i.id = c_custkey""")
def traceability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    code = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    specs = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("specs"), F.count_if(F.col("o_orderstatus") == "F").alias("automated"))
    made = orders.join(code, "o_orderkey").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("code"))
    gap = F.when(F.col("specs").isNull(), "no test spec").when(F.col("code").isNull(), "no code").when(F.col("automated") == 0, "spec not automated").otherwise("")
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(specs, "id", "left").join(made, "id", "left")
    return out.select("id", F.coalesce("specs", F.lit(0)).alias("specs"), F.coalesce("code", F.lit(0)).alias("code"), gap.alias("gap"))


@query(f"""WITH {FINDINGS},
t AS (SELECT cls, EXISTS (SELECT 1 FROM fnd o WHERE o.engine = 'error' AND o.file = f.file AND abs(o.line - f.line) <= 30) AS near FROM fnd f WHERE engine = 'purchase'),
o AS (SELECT cls, EXISTS (SELECT 1 FROM fnd t WHERE t.engine = 'purchase' AND t.file = f.file AND abs(t.line - f.line) <= 30) AS near FROM fnd f WHERE engine = 'error'),
x AS (SELECT cls, count(*) AS theirs, count(*) FILTER (near) AS reproduced FROM t GROUP BY 1), y AS (SELECT cls, count(*) FILTER (NOT near) AS ours_alone FROM o GROUP BY 1)
SELECT cls, theirs, reproduced, coalesce(ours_alone, 0) AS ours_alone FROM x LEFT JOIN y USING (cls)""")
def rule_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, theirs = findings(spark, sf_dir, "error"), findings(spark, sf_dir, "purchase")
    count = lambda df, name: df.groupBy("cls").agg(F.count("*").alias(name))
    out = count(theirs, "theirs").join(count(bands.band_semi(theirs, ours, ["file"], "line", 30), "reproduced"), "cls", "left")
    return out.join(count(bands.band_anti(ours, theirs, ["file"], "line", 30), "ours_alone"), "cls", "left").na.fill(0)


@query(f"""WITH {FINDINGS}, e AS (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY line, id) AS next FROM fnd WHERE engine IN ('signup', 'click')),
u AS (SELECT u.id, d.id AS def, d.engine, d.line FROM fnd u JOIN fnd d ON d.file = u.file AND d.engine IN ('signup', 'click') AND d.line < u.line AND u.line - d.line <= 400 WHERE u.engine = 'purchase')
SELECT id, engine AS literal, count(*) OVER () AS uses FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY line DESC, def DESC) = 1""")
def assembled_then_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A use sees the last definition before it within 400 lines; ``uses`` counts all (definition, use) pairs."""
    spans = findings(spark, sf_dir).where("engine in ('signup', 'click')").select("id", "file", "engine", (F.col("line") + 1).alias("start"), (F.col("line") + 400).alias("end"))
    pairs = bands._intervals(findings(spark, sf_dir, "purchase"), spans, "file", "line", "start", "end", 0, 512)
    last = Window.partitionBy("id").orderBy(F.desc("s_start"), F.desc("s_id"))
    picked = pairs.withColumn("r", F.row_number().over(last)).where("r = 1").select("id", F.col("s_engine").alias("literal"))
    return picked.join(F.broadcast(pairs.agg(F.count("*").alias("uses"))))
