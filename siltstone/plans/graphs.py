"""Graph queries over stand-in module graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.plans.bindings import CLOSURE, modules, modules_sql, table
from siltstone.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
GRAPH, DAG, SPARSE = modules_sql(3), modules_sql(3, acyclic=True), modules_sql(1)
DEGREES = """deg AS (SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS fan_in, (SELECT count(*) FROM edges WHERE src = id) AS fan_out FROM nodes)"""


@query(f"""WITH {GRAPH}, {DEGREES} SELECT id, fan_in, fan_out, CASE WHEN fan_in = 0 THEN 'root' WHEN fan_out = 0 THEN 'leaf' WHEN fan_in >= 3 AND fan_out >= 3 THEN 'hub' ELSE 'composer' END AS role FROM deg""")
def degree_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roles(*modules(spark, sf_dir))


@query(f"""WITH RECURSIVE {SPARSE}, {CLOSURE},
m AS (SELECT a.src AS id, min(a.dst) AS low FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT id, least(id, coalesce(low, id)) AS component FROM nodes LEFT JOIN m USING (id)""")
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(*modules(spark, sf_dir, top=1))


@query(f"""WITH RECURSIVE {DAG}, p AS (SELECT id, 0 AS level FROM nodes UNION SELECT e.src, p.level + 1 FROM p JOIN edges e ON e.dst = p.id)
SELECT id, max(level)::INT AS level FROM p GROUP BY id""")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(*modules(spark, sf_dir, acyclic=True))


@query(f"""WITH RECURSIVE {SPARSE}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT id, id AS o FROM nodes UNION SELECT w.id, b.dst FROM w JOIN b ON w.o = b.src)
SELECT id, min(o) AS component FROM w GROUP BY id""")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_components(*modules(spark, sf_dir, top=1))


@query(f"""WITH {GRAPH}, {DEGREES} SELECT id, fan_in, fan_out, round(fan_out / nullif(fan_in + fan_out, 0), 6) AS instability, coalesce(round(fan_out / nullif(fan_in + fan_out, 0), 6) <= 0.25, true) AS stable FROM deg""")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stability(*modules(spark, sf_dir))


@query(f"""WITH RECURSIVE {DAG}, {CLOSURE}, n AS (SELECT count(*) AS n FROM nodes), c AS (SELECT count(*) AS pairs FROM clo WHERE src <> dst)
SELECT n, pairs, round(100.0 * (pairs + n) / (n * n), 6) AS cost FROM n, c""")
def propagation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.propagation_cost(*modules(spark, sf_dir, acyclic=True))


@query(f"""WITH RECURSIVE {DAG}, {CLOSURE}, n AS (SELECT count(*) AS n FROM nodes), c AS (SELECT count(*) AS pairs FROM clo WHERE src <> dst)
SELECT n, pairs + n AS ccd, round((pairs + n) / ((n + 1) * log2(n + 1) - n), 6) AS nccd FROM n, c""")
def nccd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nccd(*modules(spark, sf_dir, acyclic=True))


@query(f"""WITH {GRAPH}, m AS (SELECT count(*) AS m FROM edges), t AS (SELECT s.n_regionkey AS cs, d.n_regionkey AS cd FROM edges JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst),
e AS (SELECT cs AS c, (cs = cd)::INT AS e FROM t UNION ALL SELECT cd, 0 FROM t), p AS (SELECT c, count(*) AS d, sum(e) AS e FROM e GROUP BY c)
SELECT round(sum(e / m - (d / (2 * m)) * (d / (2 * m))), 6) AS q FROM p, m""")
def folder_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("c"))
    return graph.modularity(modules(spark, sf_dir)[1], region)


@query(f"""WITH RECURSIVE {SPARSE}, r AS (SELECT id FROM nodes WHERE id < 3 UNION SELECT dst FROM r JOIN edges ON src = id) SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM r)""")
def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = modules(spark, sf_dir, top=1)
    return graph.unreachable(nodes, edges, nodes.where("id < 3"))


PATHS = "p AS (SELECT id, 1 AS k FROM nodes UNION ALL SELECT dst, k FROM p JOIN edges ON src = id), w AS (SELECT id, count(*) - 1 AS weight FROM p GROUP BY id)"


@query(f"WITH RECURSIVE {DAG}, {PATHS} SELECT id, weight FROM w")
def call_path_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = modules(spark, sf_dir, acyclic=True)
    return graph.path_weights(nodes, edges).withColumn("weight", F.col("weight").cast("long"))


@query(f"""WITH RECURSIVE {DAG}, {PATHS}, m AS (SELECT c_nationkey AS id, count(*) FILTER (c_acctbal > 5000) AS cognitive, count(*) FILTER (c_acctbal > 9500) AS tests FROM customer GROUP BY 1)
SELECT id, weight * cognitive AS score, CASE WHEN tests = 0 THEN 'untested' WHEN tests < 3 THEN 'touched' ELSE 'tested' END AS state FROM w JOIN m USING (id) WHERE weight * cognitive > 0 AND tests < 3""")
def test_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = modules(spark, sf_dir, acyclic=True)
    metrics = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count_if(F.col("c_acctbal") > 5000).alias("cognitive"), F.count_if(F.col("c_acctbal") > 9500).alias("tests"))
    state = F.when(F.col("tests") == 0, "untested").when(F.col("tests") < 3, "touched").otherwise("tested")
    out = graph.path_weights(nodes, edges).join(metrics, "id").select("id", (F.col("weight").cast("long") * F.col("cognitive")).alias("score"), state.alias("state"))
    return out.where("score > 0 and state <> 'tested'").orderBy(F.desc(F.col("state") == "untested"), F.desc("score"), "id")


@query(f"""WITH {GRAPH}, t AS (SELECT s.n_regionkey AS folder, src, dst FROM edges JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst WHERE s.n_regionkey = d.n_regionkey AND src % 2 = 0)
SELECT folder, count(DISTINCT src) AS tests, count(DISTINCT dst) AS covered FROM t GROUP BY folder""")
def own_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even nodes are tests; a folder (region) counts those that use its own files."""
    edges, nation = modules(spark, sf_dir)[1], table(spark, sf_dir, "nation")
    s, d = (nation.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(f"{k}_folder")) for k in ("src", "dst"))
    own = edges.where("src % 2 = 0").join(s, "src").join(d, "dst").where("src_folder = dst_folder")
    return own.groupBy(F.col("src_folder").alias("folder")).agg(F.count_distinct("src").alias("tests"), F.count_distinct("dst").alias("covered"))


@query(f"""WITH RECURSIVE {SPARSE}, r AS (SELECT id FROM nodes WHERE id IN (7, 12) UNION SELECT src FROM r JOIN edges ON dst = id) SELECT id FROM r""")
def affected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = modules(spark, sf_dir, top=1)
    return graph.affected(edges, nodes.where("id in (7, 12)"))


FRONTIERS = {0: [0, 1], 2: [8, 9, 12], 3: [3]}


@query(f"""WITH {GRAPH}, f(region, id) AS (VALUES {", ".join(f"({r}, {n})" for r, ns in FRONTIERS.items() for n in ns)})
SELECT src, dst, d.n_regionkey AS isolation FROM edges JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst
WHERE s.n_regionkey <> d.n_regionkey AND d.n_regionkey IN (SELECT region FROM f) AND NOT EXISTS (SELECT 1 FROM f WHERE region = d.n_regionkey AND f.id = dst)""")
def frontier_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs into a region with accepted frontiers that end elsewhere; a region without frontiers limits nothing."""
    edges, nation = modules(spark, sf_dir)[1], table(spark, sf_dir, "nation")
    accepted = spark.createDataFrame([(r, n) for r, ns in FRONTIERS.items() for n in ns], "isolation int, dst int")
    s, d = nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("own")), nation.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("isolation"))
    into = edges.join(s, "src").join(d, "dst").where("own <> isolation").join(accepted.select("isolation").distinct(), "isolation", "left_semi")
    return into.join(accepted, ["isolation", "dst"], "left_anti").select("src", "dst", "isolation")


@query("""SELECT o_custkey AS req, count(DISTINCT n_regionkey) AS isolations FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT n_regionkey) > 1""")
def requirement_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    told = table(spark, sf_dir, "orders").join(lines, "o_orderkey").join(home, "l_suppkey")
    return told.groupBy(F.col("o_custkey").alias("req")).agg(F.count_distinct("n_regionkey").alias("isolations")).where("isolations > 1")


@query(f"""WITH {GRAPH}, {DEGREES}, h AS (SELECT id FROM deg WHERE fan_in >= 3 AND fan_out >= 3)
SELECT DISTINCT CASE WHEN src IN (SELECT id FROM h) THEN src || ' (composer)' ELSE src::VARCHAR END AS src, CASE WHEN dst IN (SELECT id FROM h) THEN dst || ' (leaf)' ELSE dst::VARCHAR END AS dst FROM edges
UNION SELECT id || ' (composer)', id || ' (leaf)' FROM h""")
def hub_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hub_split(*modules(spark, sf_dir))


@query()
def cycle_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_cuts(*modules(spark, sf_dir))


LAYER = "case n_regionkey when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 3 else 1 end"


@query(f"""WITH {GRAPH}, ly AS (SELECT n_nationkey AS id, {LAYER} AS l FROM nation WHERE n_nationkey <> 7) SELECT src, dst FROM edges LEFT JOIN ly a ON a.id = src LEFT JOIN ly b ON b.id = dst WHERE a.l < b.l OR dst = 12""")
def upward_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs up the layers of regions, and arcs into a composition root (12); node 7 has no layer."""
    nation, (nodes, edges) = table(spark, sf_dir, "nation"), modules(spark, sf_dir)
    layers = nation.where("n_nationkey <> 7").select(F.col("n_nationkey").alias("id"), F.expr(LAYER).alias("layer"))
    return graph.upward_arcs(edges, layers, nodes.where("id = 12"))
