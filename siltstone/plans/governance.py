"""Queries over frontiers, references, rules, bills of materials and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.licences import expression_class
from siltstone.functions.packages import package_url
from siltstone.operators import records, text
from siltstone.operators.scoring import percent
from siltstone.plans.bindings import FINDINGS, findings, modules, modules_sql, table
from siltstone.plans.graphs import FRONTIERS, GRAPH
from siltstone.plans.records import EXPECTED, EXPRESSIONS
from siltstone.plans.registry import registry
from siltstone.plans.texts import LINES

QUERIES, ORACLE_SQL, query = registry()
ACCEPTED = "acc(isolation, dst) AS (VALUES " + ", ".join(f"({r}, {n})" for r, ns in FRONTIERS.items() for n in ns) + ")"
INTO = "inn AS (SELECT d.n_regionkey AS isolation, src, dst FROM edges JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst WHERE s.n_regionkey <> d.n_regionkey)"


def _into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs that enter another region."""
    nation, edges = table(spark, sf_dir, "nation"), modules(spark, sf_dir)[1]
    s, d = nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("own")), nation.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("isolation"))
    return edges.join(s, "src").join(d, "dst").where("own <> isolation").select("isolation", "src", "dst")


def _accepted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, n) for r, ns in FRONTIERS.items() for n in ns], "isolation int, dst int")


@query(f"WITH {GRAPH}, {ACCEPTED}, {INTO} SELECT isolation, dst FROM acc WHERE NOT EXISTS (SELECT 1 FROM inn WHERE inn.isolation = acc.isolation AND inn.dst = acc.dst)")
def unused_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark).join(_into(spark, sf_dir), ["isolation", "dst"], "left_anti")


@query(f"WITH {GRAPH}, {INTO} SELECT isolation, dst AS frontier, count(*) AS imports FROM inn GROUP BY ALL UNION ALL SELECT r_regionkey, -1, 0 FROM region")
def frontier_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every isolation's root (-1) and each folder that outside code reaches, with its import count."""
    reached = _into(spark, sf_dir).groupBy("isolation", F.col("dst").alias("frontier")).agg(F.count("*").alias("imports"))
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("isolation"), F.lit(-1).alias("frontier"), F.lit(0).cast("long").alias("imports"))
    return reached.unionByName(roots)


@query(f"""WITH {GRAPH}, r AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM trade WHERE src <> dst) WHERE k <= 4),
u AS (SELECT id FROM nodes WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges) AND id IN (SELECT src FROM r UNION SELECT dst FROM r) AND id % 7 <> 0),
a AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM u) AND dst IN (SELECT id FROM u)), b AS (SELECT src, dst FROM r WHERE src IN (SELECT id FROM u) AND dst IN (SELECT id FROM u)),
c AS (SELECT (SELECT count(*) FROM a) AS ours, (SELECT count(*) FROM b) AS theirs, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common)
SELECT ours, theirs, common, round(100.0 * common / theirs, 1) AS recall, round(100.0 * common / ours, 1) AS precision FROM c""")
def edge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of edges against a referee, over nodes that both sides see and that are no tests (id % 7)."""
    ours, theirs = modules(spark, sf_dir)[1], modules(spark, sf_dir, top=4)[1]
    seen = lambda e: e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    shared = seen(ours).intersect(seen(theirs)).where("id % 7 <> 0")
    keep = lambda e: e.join(shared.select(F.col("id").alias("src")), "src", "left_semi").join(shared.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    both = keep(ours).withColumn("o", F.lit(1)).join(keep(theirs).withColumn("t", F.lit(1)), ["src", "dst"], "full")
    counts = both.agg(F.count("o").alias("ours"), F.count("t").alias("theirs"), F.count_if(F.col("o").isNotNull() & F.col("t").isNotNull()).alias("common"))
    return counts.withColumns({"recall": percent(F.col("common"), F.col("theirs")), "precision": percent(F.col("common"), F.col("ours"))})


@query("""SELECT s_nationkey AS file, count(*) AS calls, count(o_orderkey) AS resolved, round(100.0 * count(o_orderkey) / greatest(1, count(*)), 1) AS ratio
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') o ON o_orderkey = l_orderkey GROUP BY 1""")
def resolved_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("hit"))
    calls = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(known, "l_orderkey", "left")
    out = calls.groupBy(F.col("s_nationkey").alias("file")).agg(F.count("*").alias("calls"), F.count("hit").alias("resolved"))
    return out.withColumn("ratio", percent(F.col("resolved"), F.greatest(F.lit(1), F.col("calls"))))


@query("""SELECT p_partkey AS id, p_size % 2 = 0 AS public FROM part WHERE p_size % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 48)""")
def never_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions no token names, without exports; public ones are tagged, not dropped."""
    uses = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size % 10 <> 0").join(uses, "p_partkey", "left_anti").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("public"))


RULES = [("plain-http", "http://", r"http://[a-z]"), ("licence-line", "licen", r"(?i)licensed? under|mit license"), ("assigned-token", "token", r"token *= *\"[0-9a-f]{32}"), ("table-row", "|", r"\|[^|]+\|[^|]+\|")]


@query(f"WITH {LINES} SELECT rule, count(*) AS n, count(DISTINCT id) AS files FROM (" + " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM lin WHERE contains(lower(text), '{k}') AND regexp_matches(text, '{r}')" for n, k, r in RULES) + ") GROUP BY rule")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.rule_findings(text.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), RULES)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("id").alias("files"))


@query(f"""WITH p AS (SELECT 'npm' AS ecosystem, p_brand AS name, ({EXPRESSIONS!r})[p_size % 8 + 1] AS licence, ({EXPECTED!r})[p_size % 8 + 1] AS class FROM part)
SELECT 'pkg:npm/' || name || '@1.0' AS purl, licence, class, count(*) AS n FROM p GROUP BY ALL""")
def bill_of_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, EXPRESSIONS)), F.col("p_size") % 8 + 1)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), pick.alias("licence")).groupBy("name", "licence").agg(F.count("*").alias("n"))
    return rows.select(package_url(F.lit("npm"), F.col("name"), F.lit("1.0")).alias("purl"), "licence", expression_class(F.col("licence")).alias("class"), "n")


@query(f"""WITH RECURSIVE {FINDINGS}, q AS (SELECT file, engine, cls, lead(cls) OVER (PARTITION BY file ORDER BY line, id) AS nxt FROM fnd),
f AS (SELECT DISTINCT file || ':' || cls AS src, file || ':' || nxt AS dst, engine = 'click' AS call FROM q WHERE nxt IS NOT NULL AND engine <> 'view'),
t AS (SELECT file || ':0' AS source, file || ':0' AS pos, 0 AS calls FROM (SELECT DISTINCT file FROM fnd) UNION SELECT t.source, f.dst, t.calls + f.call::INT FROM t JOIN f ON f.src = t.pos WHERE t.calls + f.call::INT <= 2)
SELECT source, pos AS sink, 'sql' AS kind, min(calls) AS calls FROM t WHERE right(pos, 2) = ':4' GROUP BY ALL""")
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data flows between the classes of a user's successive events; views clean, clicks are calls, class 4 is a sink."""
    found = findings(spark, sf_dir)
    order = Window.partitionBy("file").orderBy("line", "id")
    var = lambda c: F.concat_ws(":", "file", F.col(c).cast("string"))
    kind = F.when(F.col("engine") == "view", "clean").when(F.col("engine") == "click", "call").otherwise("assign")
    flow = found.withColumn("nxt", F.lead("cls").over(order)).where("nxt is not null").select(var("cls").alias("src"), var("nxt").alias("dst"), kind.alias("kind")).distinct()
    files = found.select("file").distinct()
    sources = files.select(F.concat("file", F.lit(":0")).alias("var"))
    sinks = files.select(F.concat("file", F.lit(":4")).alias("var"), F.lit("sql").alias("kind"))
    return records.taint_paths(sources, flow, sinks, hops=2)


@query("""WITH d AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 50 = 1 THEN 'REQ-1' ELSE 'REQ-' || c_custkey END AS id, ['REQ-' || (c_custkey * 7 % 2000), 'REQ-' || (c_custkey + 1)] AS covers FROM customer)
SELECT path, c AS id, 'no such id' AS problem FROM d, unnest(covers) AS u(c) WHERE c NOT IN (SELECT id FROM d)
UNION ALL SELECT path, id, 'id defined before' FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY path) > 1""")
def document_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ident = lambda c: F.concat(F.lit("REQ-"), c.cast("string"))
    docs = table(spark, sf_dir, "customer").select(k.alias("path"), F.when(k % 50 == 1, "REQ-1").otherwise(ident(k)).alias("id"), F.array(ident(k * 7 % 2000), ident(k + 1)).alias("covers"))
    return records.dangling(docs)


@query("""WITH r AS (SELECT o_orderkey AS vul, o_orderstatus = 'F' AS validated, o_orderpriority = '1-URGENT' AS exposed, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS evidence FROM orders)
SELECT validated, count(*) AS n, count(*) FILTER (validated AND evidence = 0) AS without_evidence, count(*) FILTER (exposed AND NOT validated) AS blocks_release FROM r GROUP BY validated""")
def register_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("evidence"))
    rows = table(spark, sf_dir, "orders").join(proof, "o_orderkey", "left").select((F.col("o_orderstatus") == "F").alias("validated"), (F.col("o_orderpriority") == "1-URGENT").alias("exposed"), F.coalesce("evidence", F.lit(0)).alias("evidence"))
    return rows.groupBy("validated").agg(F.count("*").alias("n"), F.count_if(F.col("validated") & (F.col("evidence") == 0)).alias("without_evidence"), F.count_if(F.col("exposed") & ~F.col("validated")).alias("blocks_release"))


@query("""WITH d AS (SELECT l_suppkey AS file, max_by(l_quantity, {'d': l_shipdate, 'k': l_orderkey, 'n': l_linenumber}) AS theirs, min_by(l_quantity, {'d': l_shipdate, 'k': l_orderkey, 'n': l_linenumber}) AS ours FROM lineitem GROUP BY 1)
SELECT file, ours, theirs, ours - theirs AS d FROM d WHERE abs(ours - theirs) > 1 ORDER BY abs(ours - theirs) DESC, file LIMIT 6""")
def largest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the six largest differences; the limit is the feature."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.min_by("l_quantity", order).alias("ours"), F.max_by("l_quantity", order).alias("theirs"))
    return rows.withColumn("d", F.col("ours") - F.col("theirs")).where("abs(d) > 1").orderBy(F.desc(F.abs("d")), "file").limit(6)


@query(f"""WITH RECURSIVE {modules_sql(2, acyclic=True)}, x AS (SELECT id AS root, id AS name, 0 AS depth FROM nodes UNION SELECT root, dst, depth + 1 FROM x JOIN edges ON src = name WHERE NOT (root = 0 AND dst = 7) AND dst <> root)
SELECT root, name, min(depth) AS depth FROM x GROUP BY ALL""")
def transitive_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = modules(spark, sf_dir, top=2, acyclic=True)
    one = F.lit("1").alias("version")
    requires = edges.select(F.col("src").alias("name"), one, F.col("dst").alias("dep"), F.lit("1").alias("dep_version"))
    none = nodes.where("false").select(F.col("id").alias("name"), one)
    excluded = spark.createDataFrame([(0, 7)], "root int, name int")
    return records.resolve_packages(nodes.select(F.col("id").alias("name"), one), requires, none, excluded).select("root", "name", "depth")
