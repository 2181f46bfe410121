"""Aggregate, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.versions import version_key
from siltstone.operators import scoring
from siltstone.plans.bindings import FINDINGS, findings, table
from siltstone.plans.joins import TWO_YEARS, paths, two_sides
from siltstone.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query(f"WITH {FINDINGS} SELECT engine, cls, count(*) AS n FROM fnd GROUP BY ALL ORDER BY n DESC, engine, cls")
def count_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.count_by(findings(spark, sf_dir), "engine", "cls").orderBy(F.desc("n"), "engine", "cls")


@query(f"WITH {FINDINGS} SELECT file, count(*) AS refs, count(*) FILTER (cls = 0) AS project, count(*) FILTER (cls IN (1, 2)) AS standard, count(*) FILTER (cls > 2) AS other FROM fnd GROUP BY file")
def group_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cls")
    return findings(spark, sf_dir).groupBy("file").agg(F.count("*").alias("refs"), F.count_if(c == 0).alias("project"), F.count_if(c.isin(1, 2)).alias("standard"), F.count_if(c > 2).alias("other"))


@query(f"""WITH {TWO_YEARS} SELECT count(*) FILTER (ours = theirs) AS equal, count(*) FILTER (abs(ours - theirs) = 1) AS within_one, count(*) FILTER (abs(ours - theirs) > 1) AS apart
FROM a JOIN b USING (file, name)""")
def agreement_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sides(spark, sf_dir)
    return scoring.agreement(a.join(b, ["file", "name"]), "ours", "theirs")


@query(f"WITH {TWO_YEARS} SELECT file, count(*) FILTER (ours > 40) AS ours, count(*) FILTER (theirs > 40) AS theirs, count(*) FILTER (ours > 40 AND theirs > 40) AS both FROM a JOIN b USING (file, name) GROUP BY file")
def over_limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sides(spark, sf_dir)
    return scoring.over_limit(a.join(b, ["file", "name"]), "ours", "theirs", 40, "file")


@query("""WITH t AS (SELECT lang, quality = 0 AS bad, length(text) - length(regexp_replace(text, '[|#%$!]', '', 'g')) > length(text) / 50 AS found FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (bad AND found) AS tp, count(*) FILTER (NOT bad AND found) AS fp, count(*) FILTER (bad AND NOT found) AS fn, count(*) FILTER (NOT bad AND NOT found) AS tn FROM t GROUP BY lang),
r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS x, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS y FROM c)
SELECT lang, tp, fp, fn, tn, round(x, 6) AS tpr, round(y, 6) AS fpr, round(100 * (x - y), 4) AS score FROM r""")
def confusion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol rule against the quality labels."""
    told = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    signs = F.length("text") - F.length(F.translate("text", "|#%$!", ""))
    return scoring.confusion(told.select("lang", (F.col("quality") == 0).alias("bad"), (signs > F.length("text") / 50).alias("found")), "lang", "bad", "found")


@query("SELECT l_suppkey AS id, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS sets FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def sets_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("sets"))


@query(f"WITH {FINDINGS} SELECT file, cls, max_by(id, {{'line': line, 'id': id}}) AS id, max_by(engine, {{'line': line, 'id': id}}) AS engine FROM fnd GROUP BY file, cls")
def last_definition_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.last_by(findings(spark, sf_dir), ["file", "cls"], ["line", "id"], ["id", "engine"])


@query(f"""WITH {FINDINGS} SELECT CASE WHEN grouping(project) = 1 THEN 'TOTAL' ELSE project::VARCHAR END AS project, count(*) AS findings, count(*) FILTER (engine = 'error') AS errors FROM fnd GROUP BY ROLLUP (project)""")
def total_row_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_total(findings(spark, sf_dir), "project", findings=F.count("*"), errors=F.count_if(F.col("engine") == "error"))


BINS = ", ".join(f"({lo}, {hi})" for lo, hi in zip([1, *(e + 1 for e in scoring.BIN_ENDS)], [*scoring.BIN_ENDS, "NULL"], strict=True))


@query(f"""WITH m AS (SELECT (n_chars // 40)::BIGINT AS v FROM documents WHERE n_chars IS NOT NULL), b(low, high) AS (VALUES {BINS})
SELECT low::BIGINT AS low, high::BIGINT AS high, count(v) AS n FROM b LEFT JOIN m ON (v >= low OR low = 1) AND (high IS NULL OR v <= high) GROUP BY ALL""")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.histogram(table(spark, sf_dir, "documents").select(F.expr("n_chars div 40").alias("v")), "v")


@query("""SELECT l_suppkey AS id, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(quantile_cont(l_quantity, 0.5), 6) AS median,
round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS max, round(avg((l_quantity > 40)::INT), 6) AS share_over FROM lineitem GROUP BY 1""")
def metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.distribution(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "id"), "l_quantity", 40, "id")


@query("""WITH p AS (SELECT r_name, n_name, c_mktsegment, c_acctbal > 9000 AS over FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT unnest([r_name, r_name || '/' || n_name, r_name || '/' || n_name || '/' || c_mktsegment]) AS parent, over FROM p)
SELECT parent, count(*) AS n, count(*) FILTER (over) AS over FROM f GROUP BY parent HAVING count(*) FILTER (over) > 0""")
def offenders_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    told = paths(spark, sf_dir).select(F.explode(prefixes).alias("parent"), (F.col("c_acctbal") > 9000).alias("over"))
    return told.groupBy("parent").agg(F.count("*").alias("n"), F.count_if("over").alias("over")).where("over > 0")


@query(f"""WITH {FINDINGS}, r AS (SELECT engine, id, line, row_number() OVER (PARTITION BY engine ORDER BY line, id) AS rank, count(*) OVER (PARTITION BY engine) AS n FROM fnd)
SELECT engine, id, line, rank, greatest(n - 20, 0) AS more FROM r WHERE rank <= 20""")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir).select("engine", "id", "line")
    return scoring.top_per_group(found, "engine", [F.col("line"), F.col("id")], 20)


@query(f"""WITH {FINDINGS}, l AS (SELECT id, file, value, lag(value) OVER (PARTITION BY file ORDER BY line, id) AS before FROM fnd)
SELECT id, file, before, value FROM l WHERE before < 10 AND value > 50""")
def growth_between_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("file").orderBy("line", "id")
    return findings(spark, sf_dir).withColumn("before", F.lag("value").over(order)).where("before < 10 and value > 50").select("id", "file", "before", "value")


@query(f"""WITH {FINDINGS}, l AS (SELECT id, file, engine, lead(engine) OVER (PARTITION BY file ORDER BY line, id) AS next FROM fnd)
SELECT id, file FROM l WHERE engine = 'purchase' AND coalesce(next, '') <> 'view'""")
def next_statement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("file").orderBy("line", "id")
    return findings(spark, sf_dir).withColumn("next", F.lead("engine").over(order)).where("engine = 'purchase' and coalesce(next, '') <> 'view'").select("id", "file")


@query(f"WITH {FINDINGS} SELECT id, file, line FROM fnd WHERE engine = 'signup' QUALIFY row_number() OVER (PARTITION BY file, cls ORDER BY line, id) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("file", "cls").orderBy("line", "id")
    return findings(spark, sf_dir, "signup").withColumn("r", F.row_number().over(order)).where("r > 1").select("id", "file", "line")


VERSIONS = ["1.0", "1.0.1", "1.2", "1.10", "2.0", "2.0-rc1", "2.0-rc2", "v2.1", "20240101123045678.1", "latest"]


@query(f"""WITH v AS (SELECT DISTINCT p_brand AS name, ({VERSIONS!r})[p_partkey % 10 + 1] AS version FROM part),
k AS (SELECT *, list_transform(list_filter(string_split(regexp_extract(version, '^v?([0-9]+(?:\\.[0-9]+)*)', 1), '.'), lambda x: x <> ''), lambda x: x::BIGINT) AS numbers, regexp_replace(version, '^v?[0-9]+(\\.[0-9]+)*', '') AS rest FROM v)
SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY numbers, rest) AS place FROM k""")
def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, VERSIONS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    told = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), pick.alias("version")).distinct()
    return told.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(version_key(F.col("version")))))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08 AND l_quantity > 40)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'ours_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'theirs_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    a, b = lines.where("l_returnflag = 'R'").select("l_partkey").distinct(), lines.where("l_discount > 0.08").select("l_partkey").distinct()
    sets = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "ours_only": a.subtract(b), "theirs_only": b.subtract(a)}
    out = None
    for name, df in sets.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH a AS (SELECT o_custkey AS path, md5(string_agg(o_orderpriority, ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1),
b AS (SELECT o_custkey AS path, md5(string_agg(o_orderpriority, ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1)
SELECT path, CASE WHEN a.h IS NULL THEN 'right only' WHEN b.h IS NULL THEN 'left only' ELSE 'differs' END AS state FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h""")
def tree_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, cut = table(spark, sf_dir, "orders"), F.expr("timestamp_ntz'1995-06-01'")
    content = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ","))
    tree = lambda df, name: df.groupBy(F.col("o_custkey").alias("path")).agg(content.alias(name))
    both = tree(orders.where(F.col("o_orderdate") < cut), "a").join(tree(orders.where(F.col("o_orderdate") >= cut), "b"), "path", "full")
    state = F.when(F.col("a").isNull(), "right only").when(F.col("b").isNull(), "left only").otherwise("differs")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", state.alias("state"))
