"""Queries over isolations: parts of a tree, their frontiers, contracts and data.

Files are a nation's customers and suppliers; folders are region, nation and a layer; tests are some nations' files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import isolations, records
from siltstone.plans.bindings import table
from siltstone.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()

PARTS = [("asia", "ASIA"), ("asia.china", "ASIA/CHINA"), ("asia.japan", "ASIA/JAPAN"), ("europe", "EUROPE"), ("europe.france", "EUROPE/FRANCE"), ("africa", "AFRICA"), ("other", "EUROPE/FRANCE/ports")]
FRONTIERS = [("asia", ".", "accepted"), ("asia", "INDIA/ports", "accepted"), ("asia.china", ".", "accepted"), ("europe", "GERMANY/ports/sql", "accepted"), ("europe", "RUSSIA", "rejected"), ("europe.france", "ports", "proposed"), ("africa", ".", "rejected"), ("asia.japan", "tests/unit", "accepted")]
VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
RELATIONS = f"parts(name, path) AS (VALUES {VALUES(PARTS)}), frontiers(name, folder, status) AS (VALUES {VALUES(FRONTIERS)})"
LAYERS = ["", "/ports", "/ports/sql", "/inner/deep"]

EDGES = f"""ed AS (SELECT DISTINCT r.r_name || '/' || n.n_name || CASE WHEN n.n_nationkey % 6 = 0 THEN '/tests' ELSE '' END || '/app.py' AS src,
  q.r_name || '/' || m.n_name || ({LAYERS!r})[s_suppkey % 4 + 1] || '/s' || s_suppkey % 5 || '.py' AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation m ON s_nationkey = m.n_nationkey JOIN region q ON m.n_regionkey = q.r_regionkey WHERE l_quantity >= 49 AND (c_custkey + s_suppkey) % 5 = 0)"""


def _relations(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(PARTS, "name string, path string"), spark.createDataFrame(FRONTIERS, "name string, folder string, status string")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("folder"))
    tests = F.when(F.col("n_nationkey") % 6 == 0, "/tests").otherwise("")
    sources = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("folder", tests, F.lit("/app.py")).alias("src"))
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    name = F.concat("folder", layer, F.lit("/s"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".py"))
    targets = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", name.alias("dst"))
    uses = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    told = uses.join(sources, F.col("o_custkey") == F.col("c_custkey")).join(targets, F.col("l_suppkey") == F.col("s_suppkey")).where((F.col("c_custkey") + F.col("s_suppkey")) % 5 == 0)
    return told.select("src", "dst").distinct()


HOLDERS = """fl AS (SELECT src AS path FROM ed UNION SELECT dst FROM ed),
hd AS (SELECT fl.path, name, regexp_replace(substr(fl.path, length(parts.path) + 2), '/?[^/]*$', '') AS inn FROM fl JOIN parts ON starts_with(fl.path, parts.path || '/')),
en AS (SELECT src, dst, h.name, h.inn FROM ed JOIN hd h ON h.path = dst WHERE NOT EXISTS (SELECT 1 FROM hd g WHERE g.path = src AND g.name = h.name))"""
OPEN = "op AS (SELECT name, unnest(CASE WHEN folder = '.' THEN [''] ELSE list_transform(range(len(string_split(folder, '/')) + 1), lambda n: array_to_string(string_split(folder, '/')[1:n], '/')) END) AS folder FROM frontiers WHERE status = 'accepted')"


@query(f"""WITH {RELATIONS}, {EDGES}, {HOLDERS}, w AS (SELECT hd.path, hd.name, parts.path AS root FROM hd JOIN parts USING (name)),
e AS (SELECT a.path, bool_or(NOT starts_with(b.name, a.name || '.') AND NOT starts_with(a.name, b.name || '.')) AS error FROM w a JOIN w b ON a.path = b.path AND a.name <> b.name GROUP BY a.path)
SELECT w.path, max_by(name, {{'l': length(root), 'm': length(name), 'n': name}}) AS name, coalesce(bool_or(e.error), false) AS error FROM w LEFT JOIN e ON e.path = w.path GROUP BY w.path""")
def isolation_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest part that holds each file, and files that two unrelated parts hold."""
    edges = _edges(spark, sf_dir)
    files = edges.select(F.col("src").alias("path")).union(edges.select("dst"))
    return isolations.owners(files, _relations(spark)[0])


@query(f"""WITH {RELATIONS}, {EDGES}, {HOLDERS}, {OPEN}
SELECT src, dst, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM en WHERE name IN (SELECT name FROM op) AND NOT EXISTS (SELECT 1 FROM op WHERE op.name = en.name AND op.folder = en.inn) GROUP BY src, dst""")
def isolation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolations.violations(_edges(spark, sf_dir), *_relations(spark))


@query(f"""WITH {RELATIONS}, {EDGES}, {HOLDERS}, re AS (SELECT name, inn, count(*) AS imports FROM en WHERE NOT regexp_matches(src, '(^|/)tests/') GROUP BY ALL)
SELECT DISTINCT p.name, '.' AS folder, coalesce(imports, 0) AS imports FROM parts p LEFT JOIN re ON re.name = p.name AND inn = ''
UNION ALL SELECT name, inn, imports FROM re WHERE inn <> '' AND NOT EXISTS (SELECT 1 FROM re d WHERE d.name = re.name AND starts_with(d.inn, re.inn || '/'))""")
def isolation_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolations.proposal(_edges(spark, sf_dir), _relations(spark)[0], F.col("src").rlike("(^|/)tests/"))


@query(f"""WITH {RELATIONS}, {EDGES}, {HOLDERS} SELECT name, folder FROM frontiers f WHERE status = 'accepted' AND folder <> '.'
AND NOT EXISTS (SELECT 1 FROM en WHERE en.name = f.name AND NOT regexp_matches(src, '(^|/)tests/') AND (inn = folder OR starts_with(inn, folder || '/')))""")
def isolation_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolations.unused(_edges(spark, sf_dir), *_relations(spark), F.col("src").rlike("(^|/)tests/"))


@query(f"""WITH {RELATIONS}, {EDGES}, {HOLDERS}, {OPEN}, f AS (SELECT hd.* FROM hd WHERE name <> 'europe.france' AND NOT starts_with('europe.france', name || '.') AND name IN (SELECT name FROM op)),
l AS (SELECT path, bool_and(EXISTS (SELECT 1 FROM op WHERE op.name = f.name AND op.folder = f.inn)) AS seen FROM f GROUP BY path)
SELECT path, CASE WHEN path IN (SELECT path FROM hd WHERE name = 'europe.france') THEN 'own' WHEN seen IS NULL THEN 'open' ELSE 'visible' END AS reason
FROM fl LEFT JOIN l USING (path) WHERE path IN (SELECT path FROM hd WHERE name = 'europe.france') OR seen IS NULL OR seen""")
def isolation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that an edit in one part may read."""
    edges = _edges(spark, sf_dir)
    files = edges.select(F.col("src").alias("path")).union(edges.select("dst"))
    return isolations.context(files, *_relations(spark), "europe.france")


@query(f"""WITH {RELATIONS}, r AS (SELECT p.name, p.path || ';' || coalesce(string_agg(folder || '=' || status, ',' ORDER BY folder, status), '') AS rules FROM parts p LEFT JOIN frontiers f ON f.name = p.name AND status <> 'proposed' GROUP BY p.name, p.path),
h AS (SELECT name, sha256(rules) AS fingerprint FROM r), d AS (SELECT sha256(rules) AS fingerprint, CASE WHEN (SELECT count(*) FROM region) > length(name) THEN 'accepted' ELSE 'proposed' END AS status FROM r WHERE name IN ('asia', 'europe'))
SELECT name, fingerprint, CASE WHEN status = 'accepted' THEN 'accepted' WHEN status IS NOT NULL THEN 'proposed' ELSE 'no decision' END AS state FROM h LEFT JOIN d USING (fingerprint)""")
def isolation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an accepted decision carries the hash of each part's rules; the decisions know two of the parts."""
    parts, frontiers = _relations(spark)
    none = spark.createDataFrame([], "fingerprint string, status string")
    known = isolations.fingerprints(parts, frontiers, none).where("name in ('asia', 'europe')")
    regions = table(spark, sf_dir, "region").agg(F.count("*").alias("n"))
    status = F.when(F.col("n") > F.length("name"), "accepted").otherwise("proposed")
    decisions = known.join(F.broadcast(regions)).select("fingerprint", status.alias("status"))
    return isolations.fingerprints(parts, frontiers, decisions)


KINDS = ["(a)", "(a, b=)", "(a, b: dict[str, int])", "(a, cb=(x) => y)", "()", "(a, *rest)"]
ADDED = ["", "c=", "c", "m: Map<K, V> = {}", "c?", "*more"]
SIGNATURES = f"""sg AS (SELECT p_partkey AS name, (['python', 'js', 'rust'])[p_partkey % 3 + 1] AS lang, ({KINDS!r})[p_size % 6 + 1] AS a, ({ADDED!r})[p_partkey // 7 % 6 + 1] AS added, p_partkey % 11 = 0 AS gone, p_partkey % 13 = 0 AS swapped FROM part)"""


@query(f"""WITH {SIGNATURES} SELECT name, CASE WHEN gone THEN 'removed' ELSE 'changed' END AS change FROM sg
WHERE gone OR (swapped AND a <> '(z)') OR (NOT swapped AND added <> '' AND NOT (CASE lang WHEN 'rust' THEN false WHEN 'js' THEN added <> 'c' ELSE added NOT IN ('c', 'c?') END))""")
def contract_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names removed or changed so that callers break; the signatures are spelled from part keys."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    k = F.col("p_partkey")
    told = table(spark, sf_dir, "part").select(k.alias("name"), pick(["python", "js", "rust"], k % 3).alias("lang"), pick(KINDS, F.col("p_size") % 6).alias("a"), pick(ADDED, F.expr("p_partkey div 7 % 6")).alias("added"))
    inner = F.regexp_extract("a", r"^\((.*)\)$", 1)
    longer = F.concat(F.lit("("), F.concat_ws(", ", F.nullif(inner, F.lit("")), F.nullif("added", F.lit(""))), F.lit(")"))
    new = told.where("name % 11 <> 0").select("name", F.when(F.col("name") % 13 == 0, "(z)").otherwise(longer).alias("signature"))
    return records.contract_changes(told.select("name", F.col("a").alias("signature"), "lang"), new)


FIELDS = [("f0", "asia"), ("f3", "europe")]


@query(f"""WITH {RELATIONS}, {EDGES}, {HOLDERS}, fd(field, stays_in) AS (VALUES {VALUES(FIELDS)}),
tk AS (SELECT dst AS file, (row_number() OVER (PARTITION BY dst ORDER BY src)) AS line, 'f' || length(src) % 5 AS name, length(src || dst) % 4 = 0 AS comment FROM ed),
ot AS (SELECT DISTINCT file, line, name AS field FROM tk JOIN fd ON field = name WHERE NOT comment AND NOT EXISTS (SELECT 1 FROM hd, fd x WHERE hd.path = tk.file AND x.field = tk.name AND hd.name = x.stays_in)),
df AS (SELECT file, line, 'v' || line % 3 AS local, name AS value FROM tk), us AS (SELECT file, line, 'v' || (line + 1) % 3 AS arg, line % 7 = 0 AS own, name FROM tk),
la AS (SELECT us.file, us.line, max_by(value, df.line) AS value FROM us JOIN df ON df.file = us.file AND df.local = us.arg AND df.line < us.line WHERE NOT own GROUP BY ALL),
si AS (SELECT DISTINCT file, line, name AS field FROM us JOIN fd ON field = name WHERE own UNION SELECT file, line, value FROM la JOIN fd ON field = value)
SELECT 'outside' AS kind, * FROM ot UNION ALL SELECT 'sink', * FROM si""")
def data_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fields outside the parts they stay in, and fields that reach a logger, directly or through a local."""
    edges, (parts, _) = _edges(spark, sf_dir), _relations(spark)
    line = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    name = F.concat(F.lit("f"), (F.length("src") % 5).cast("string"))
    tokens = edges.select(F.col("dst").alias("file"), line.cast("long").alias("line"), name.alias("name"), (F.length(F.concat("src", "dst")) % 4 == 0).alias("comment"))
    fields = spark.createDataFrame(FIELDS, "field string, stays_in string")
    local = lambda c: F.concat(F.lit("v"), (c % 3).cast("string"))
    one = F.lit("f").alias("fn")
    assigns = tokens.select("file", one, "line", local(F.col("line")).alias("local"), F.col("name").alias("value"))
    sinks = tokens.select("file", one, "line", F.when(F.col("line") % 7 == 0, F.col("name")).otherwise(local(F.col("line") + 1)).alias("arg"))
    held = isolations.holders(edges.select(F.col("dst").alias("path")), parts)
    outside, found = isolations.data_outside(tokens, held, fields), isolations.data_sinks(sinks, assigns, fields)
    return outside.select(F.lit("outside").alias("kind"), "*").unionByName(found.select(F.lit("sink").alias("kind"), "*"))
