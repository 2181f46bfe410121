"""Queries over documents, policies, seats and tasks of projects, and round trips of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.licences import licence_class
from siltstone.functions.strings import GLOSSARY, id_problem, lease_minutes, nearest
from siltstone.operators import records, text
from siltstone.plans.bindings import FINDINGS, findings, table
from siltstone.plans.code import listed, pick
from siltstone.plans.registry import registry
from siltstone.scratch import fresh
from siltstone.sources import files, manifests, reports, rules, sinks

QUERIES, ORACLE_SQL, query = registry()


@query("""SELECT 'REQ-' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'implemented' WHEN 'O' THEN 'automated' ELSE 'open' END AS status, CASE o_orderstatus WHEN 'F' THEN 'no code marker' ELSE 'no test marker' END AS problem FROM orders
WHERE o_orderstatus IN ('F', 'O') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END)""")
def status_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that claim code or tests for which there is no marker."""
    ident = lambda c: F.concat(F.lit("REQ-"), F.col(c).cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "implemented").when(F.col("o_orderstatus") == "O", "automated").otherwise("open")
    kind = F.when(F.col("l_returnflag") == "R", "code").when(F.col("l_returnflag") == "N", "test")
    documents = table(spark, sf_dir, "orders").select(ident("o_orderkey").alias("id"), status.alias("status"))
    return records.status_drift(documents, table(spark, sf_dir, "lineitem").select(ident("l_orderkey").alias("id"), kind.alias("kind")))


@query("""WITH d AS (SELECT 'd' || c_nationkey || '/' || c_custkey || '.md' AS path, 'd' || c_nationkey AS folder, c_custkey AS k, 'd' || c_nationkey || '/' || (c_custkey + 25) || '.md' AS target FROM customer)
SELECT d.path, (k + 25) || '.md' AS target, 'no such file' AS problem FROM d WHERE target NOT IN (SELECT path FROM d)
UNION ALL SELECT path, path, 'not in the index' FROM d WHERE k % 3 = 0 AND folder IN (SELECT folder FROM d WHERE k % 3 > 0)""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to files that are not there, and files that the index of their folder leaves out."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("see [x](./"), (k + 25).cast("string"), F.lit(".md), [y](https://x.example) and [z](#here)"))
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("folder"), k.alias("k"), F.concat(k.cast("string"), F.lit(".md")).alias("name"), body.alias("body"))
    entries = F.array_join(F.collect_list(F.concat(F.lit("- [n]("), F.col("name"), F.lit(")"))), "\n")
    index = docs.where("k % 3 > 0").groupBy("folder").agg(entries.alias("body")).select(F.concat_ws("/", "folder", F.lit("INDEX.md")).alias("path"), "body")
    return records.broken_links(docs.select(F.concat_ws("/", "folder", "name").alias("path"), "body").unionByName(index))


STEPS = ["style", "docs", "security", "review", "lint"]


@query(f"""WITH s AS (SELECT o_custkey AS task, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, ({listed(STEPS)})[o_orderkey % 5 + 1] AS step, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS exit FROM orders),
l AS (SELECT *, CASE step WHEN 'style' THEN 'required' WHEN 'docs' THEN 'advised' WHEN 'security' THEN 'required' ELSE 'advised' END AS level, CASE WHEN exit IS NULL THEN 'skip' WHEN exit = 0 THEN 'pass' ELSE 'FAIL' END AS verdict FROM s)
SELECT *  EXCLUDE (exit), NOT bool_or(level = 'required' AND verdict = 'FAIL') OVER (PARTITION BY task) AS closes FROM l""")
def policy_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered steps with verdicts; a level in the configuration comes before the layer's default."""
    k = F.col("o_orderkey")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(k))
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), pos.alias("pos"), pick(STEPS, k % 5).alias("step"), F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, 3).otherwise(0).alias("exit"))
    defaults = spark.createDataFrame([("style", "required"), ("docs", "required"), ("lint", "advised")], "step string, level string")
    return records.policy_run(steps, defaults, spark.createDataFrame([("docs", "advised"), ("security", "required")], "step string, level string"))


LEASES = ["4h", "30m", "1h30m", "soon"]


@query(f"""WITH s AS (SELECT s_suppkey AS seat, CASE WHEN s_suppkey % 3 = 0 THEN 'here' ELSE 'there' END AS host, s_suppkey % 4 > 0 AS alive, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey * 37 % 400 END AS beat, coalesce(([240, 30, 90, NULL])[s_suppkey % 4 + 1], 60) AS lease FROM supplier),
t AS (SELECT *, CASE WHEN beat IS NULL THEN 'free' WHEN host = 'here' AND NOT alive THEN 'dead' WHEN 400 - beat > lease THEN 'expired' ELSE 'live' END AS state FROM s)
SELECT seat, state, state IN ('free', 'dead') OR (state = 'expired' AND host = 'here') AS takeover FROM t""")
def seat_takeover(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    seats = table(spark, sf_dir, "supplier").select(k.alias("seat"), F.when(k % 3 == 0, "here").otherwise("there").alias("host"), (k % 4 > 0).alias("alive"), F.when(k % 10 != 0, k * 37 % 400).alias("heartbeat"), F.coalesce(lease_minutes(pick(LEASES, k % 4)), F.lit(60)).alias("lease"))
    return records.seat_takeover(seats, F.lit("here"), F.lit(400))


BOARD = ["pending/ideas", "pending/next", "going-on", "completed"]
TASKS = f"""tk AS (SELECT c_custkey AS id, 'road/' || ({listed(BOARD)})[c_custkey % 4 + 1] || '/T' || c_custkey || '.md' AS path, ({listed(BOARD)})[c_custkey % 4 + 1] AS state, 's' || c_custkey % 9 AS owner,
  'src/' || c_nationkey || CASE c_custkey % 3 WHEN 0 THEN '/**' WHEN 1 THEN '/' || c_custkey % 40 ELSE '/' || c_custkey % 40 || '/f' || c_custkey % 7 || '.py' END AS scope FROM customer)"""


@query(f"""WITH {TASKS}, a AS (SELECT id, regexp_replace(scope, '/+([*][*])?$', '') AS p FROM tk WHERE state = 'going-on'), o AS (SELECT DISTINCT x.id, y.id AS other FROM a x JOIN a y ON x.id <> y.id AND (x.p = y.p OR starts_with(x.p, y.p || '/') OR starts_with(y.p, x.p || '/'))),
n AS (SELECT id, count(*) AS k FROM o GROUP BY id)
SELECT id, state, owner, CASE WHEN substr(owner, 2)::INT < 5 THEN (['live', 'dead'])[substr(owner, 2)::INT % 2 + 1] END AS seat_state, coalesce(n.k, 0) AS "overlaps" FROM tk LEFT JOIN n USING (id)""")
def task_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by the folder they lie in, with the state of their owner's seat and how many others share their scope."""
    k, text_of = F.col("c_custkey"), lambda c: c.cast("string")
    deep = F.concat(F.lit("/"), text_of(k % 40))
    scope = F.when(k % 3 == 0, "/**").when(k % 3 == 1, deep).otherwise(F.concat(deep, F.lit("/f"), text_of(k % 7), F.lit(".py")))
    tasks = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("road/"), pick(BOARD, k % 4), F.lit("/T"), text_of(k), F.lit(".md")).alias("path"), F.concat(F.lit("s"), text_of(k % 9)).alias("owner"), F.array(F.concat(F.lit("src/"), text_of(F.col("c_nationkey")), scope)).alias("scope"))
    seats = spark.createDataFrame([(f"s{i}", ["live", "dead"][i % 2]) for i in range(5)], "seat string, state string")
    return records.task_board(tasks, seats)


@query("""WITH f AS (SELECT (['project', 'person', 'organisation', 'kit'])[o_orderkey % 4 + 1] AS layer, 'f' || o_custkey AS path, CASE WHEN o_orderkey % 9 = 0 THEN 'DISABLED' ELSE 'text ' || o_orderkey END AS content, o_orderkey FROM orders),
u AS (SELECT layer, path, min_by(content, o_orderkey) AS content FROM f GROUP BY ALL) SELECT path, layer, content FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY list_position(['project', 'person', 'organisation', 'kit'], layer)) = 1 AND content <> 'DISABLED'""")
def layered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by layer: the nearest layer wins, a disabling file removes the path."""
    order = ["project", "person", "organisation", "kit"]
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(pick(order, k % 4).alias("layer"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("path"), F.when(k % 9 == 0, "DISABLED").otherwise(F.concat(F.lit("text "), k.cast("string"))).alias("content"), k)
    one = rows.groupBy("layer", "path").agg(F.min_by("content", "o_orderkey").alias("content"))
    return records.layered(one, order).select("path", "layer", "content")


@query("""SELECT o_orderkey AS id, 'R' || o_custkey % 2500 AS req FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey % 2500 AND c_custkey % 3 > 0)""")
def orphan_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("R"), c.cast("string"))
    specs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), name(F.col("o_custkey") % 2500).alias("req"))
    return records.orphans(specs, table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(name(F.col("c_custkey")).alias("id")))


IDENTS = ["REQ-AUTH-0001", "REQ-0002", "req-0001", "XX-0001", "REQ-1", "TS-FOO-0002", "ADR-SCE-0004", "TS-DATA-9", "REQ-CORR-0005"]


@query(f"""WITH i AS (SELECT ({listed(IDENTS)})[p_partkey % 9 + 1] AS ident, count(*) AS n FROM part GROUP BY 1), p AS (SELECT *, string_split(ident, '-') AS q FROM i),
m AS (SELECT ident, n, q[-1] AS num, q[1] AS pre, list_filter(q[2:len(q) - 1], lambda d: NOT list_contains({GLOSSARY!r}, d)) AS bad FROM p)
SELECT ident, n, CASE WHEN NOT regexp_matches(ident, '^[A-Z]+(-[A-Z][A-Z0-9]*)*-[0-9]+$') THEN 'shape' WHEN pre NOT IN ('REQ', 'TS', 'ADR') THEN 'prefix' WHEN length(num) <> 4 THEN 'digits' WHEN len(bad) > 0 THEN 'domain' END AS problem,
CASE WHEN len(bad) > 0 THEN (SELECT min_by(g, {{'d': levenshtein(bad[1], g), 'g': g}}) FROM unnest({GLOSSARY!r}) AS u(g) WHERE levenshtein(bad[1], g) <= 2) END AS meant FROM m""")
def id_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed ids with the reason, and for an unknown domain the word that was meant."""
    rows = table(spark, sf_dir, "part").select(pick(IDENTS, F.col("p_partkey") % 9).alias("ident")).groupBy("ident").agg(F.count("*").alias("n"))
    parts = F.split("ident", "-")
    middle = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda d: ~d.isin(*GLOSSARY))
    return rows.select("ident", "n", id_problem(F.col("ident"), ["REQ", "TS", "ADR"]).alias("problem"), nearest(F.try_element_at(middle, F.lit(1)), GLOSSARY).alias("meant"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'a' || p_size WHEN 1 THEN 'b' || p_size ELSE 'c' END AS name FROM part""")
def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next capture that is not empty."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("a"), size)).otherwise("").alias("x"), F.when(k % 3 < 2, F.concat(F.lit("b"), size)).alias("y"), F.lit("c").alias("z"))
    return records.first_non_null(rows, ["x", "y", "z"], "name").select("id", "name")


@query("""SELECT p_size AS id, 'cwe=' || p_size % 7 || CASE WHEN p_size % 2 = 0 THEN ',level=' || p_size ELSE '' END AS kept FROM part GROUP BY p_size""")
def renamed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an allow list renamed; other keys and empty values dropped."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_size").distinct().select(size.alias("id"), F.create_map(F.lit("cweId"), (size % 7).cast("string"), F.lit("severity"), F.when(size % 2 == 0, size.cast("string")).otherwise(""), F.lit("noise"), F.lit("x")).alias("m"))
    out = records.renamed(rows, "m", {"cweId": "cwe", "severity": "level"})
    return out.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kept"))


@query(f"""WITH {FINDINGS} SELECT project, count(*) AS n FROM (SELECT project, engine || ' at ' || line AS message FROM fnd) WHERE contains(message, 'error at 1') OR contains(message, 'sign') GROUP BY project""")
def message_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose message contains a selector."""
    message = F.concat_ws(" at ", "engine", F.col("line").cast("string"))
    hit = F.contains(message, F.lit("error at 1")) | F.contains(message, F.lit("sign"))
    return findings(spark, sf_dir).where(hit).groupBy("project").agg(F.count("*").alias("n"))


CLONES = r"""nt AS (SELECT doc_id AS id, lang = 'de' AS test, md5(regexp_replace(regexp_replace(lower(text), '[\t\n\x0b\f\r ]+', ' ', 'g'), '^ | $', '', 'g')) AS hash, len(string_split(text, chr(10))) AS lines FROM documents)"""


@query(f"WITH {CLONES} SELECT hash, count(*) AS n, min(id) AS first_id, NOT bool_and(coalesce(test, false)) AS gated FROM nt WHERE lines >= 6 GROUP BY hash HAVING count(*) > 1")
def clone_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact clones of six lines and more; groups of tests alone are listed, not gated."""
    return text.clone_groups(table(spark, sf_dir, "documents"), "doc_id", "text", tests=F.coalesce(F.col("lang") == "de", F.lit(False)))


# --- sources and sinks, written and read back ----------------------------------------------------------------------


@query(f"WITH {FINDINGS} SELECT project, count(*) AS n, sum(line)::BIGINT AS lines, count(DISTINCT file) AS files FROM fnd GROUP BY project")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as JSON, one folder a project, read back with an explicit schema."""
    where = fresh(spark, "json")
    sinks.write_json(findings(spark, sf_dir).select("project", "file", "line"), where, "project")
    back = spark.read.schema("file string, line long, project long").json(where)
    return back.groupBy("project").agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.count_distinct("file").alias("files"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) + 2 AS line, [n_nationkey::VARCHAR, n_name, r_name] AS cells FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 1, ['n_nationkey', 'n_name', 'r_name']")
def markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report written in order and its table read back."""
    where = fresh(spark, "report")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    sinks.write_markdown(rows, where, "n_nationkey")
    told = spark.read.text(where, wholetext=True).select(F.lit("r.md").alias("path"), F.col("value").alias("text"))
    return rules.markdown_tables(told).select("line", "cells")


@query("""WITH p AS (SELECT DISTINCT (['npm', 'PyPI', 'crates.io'])[p_partkey % 3 + 1] AS ecosystem, 'p' || p_partkey % 40 AS name, p_size || '.' || p_partkey % 4 AS version, CASE WHEN p_partkey % 40 % 5 > 0 THEN 'MIT' END AS licence FROM part)
SELECT 'pkg:' || (CASE ecosystem WHEN 'npm' THEN 'npm' WHEN 'PyPI' THEN 'pypi' ELSE 'cargo' END) || '/' || name || '@' || version AS purl, licence FROM p""")
def bill_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CycloneDX document written as one file and its components read back."""
    where = fresh(spark, "bom")
    k = F.col("p_partkey")
    packages = table(spark, sf_dir, "part").select(pick(["npm", "PyPI", "crates.io"], k % 3).alias("ecosystem"), F.concat(F.lit("p"), (k % 40).cast("string")).alias("name"), F.concat_ws(".", F.col("p_size").cast("string"), (k % 4).cast("string")).alias("version"), F.when(k % 40 % 5 > 0, "MIT").alias("licence")).distinct()
    sinks.bill_document(sinks.cyclonedx(packages), "cyclonedx", "app").write.text(where)
    schema = "bomFormat string, specVersion string, components array<struct<purl:string,licenses:array<struct<license:struct<id:string>>>>>"
    told = reports.json_document(spark, where, schema).where("bomFormat = 'CycloneDX' and specVersion = '1.5'").select(F.explode("components").alias("c"))
    return told.select("c.purl", F.try_element_at("c.licenses", F.lit(1))["license"]["id"].alias("licence"))


LOCKS = {
    "requirements.txt": ("PyPI", "{name}=={version}\\n"),
    "go.sum": ("Go", "{name} v{version} h1:x=\\n{name} v{version}/go.mod h1:y=\\n"),
    "Cargo.lock": ("crates.io", '[[package]]\\nname = "{name}"\\nversion = "{version}"\\n\\n'),
    "yarn.lock": ("npm", '{name}@^1:\\n  version "{version}"\\n\\n'),
    "Gemfile.lock": ("RubyGems", "    {name} ({version})\\n"),
    "pnpm-lock.yaml": ("npm", "  {name}@{version}:\\n    resolution: x\\n"),
    "gradle.lockfile": ("Maven", "g.{name}:{name}:{version}=compileClasspath\\n"),
}


@query(f"""WITH k AS (SELECT c_nationkey, c_custkey, ({listed(list(LOCKS))})[c_nationkey % 7 + 1] AS kind, 'n' || c_custkey % 50 AS n, c_custkey % 9 || '.' || c_custkey % 50 AS version FROM customer),
e(kind, ecosystem) AS (VALUES {", ".join(f"('{k}', '{v[0]}')" for k, v in LOCKS.items())})
SELECT DISTINCT ecosystem, CASE WHEN kind = 'gradle.lockfile' THEN 'g.' || n || ':' || n ELSE n END AS name, version, 'app' || c_nationkey || '/' || kind AS manifest FROM k JOIN e USING (kind)""")
def lockfile_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock files of seven formats spelled from customers, one a nation, and what the parser finds in them."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", pick(list(LOCKS), F.col("c_nationkey") % 7).alias("kind"), F.concat(F.lit("n"), (k % 50).cast("string")).alias("name"), F.concat_ws(".", (k % 9).cast("string"), (k % 50).cast("string")).alias("version")).distinct()
    entry = F.coalesce(*(F.when(F.col("kind") == kind, F.replace(F.replace(F.lit(shape.replace("\\n", "\n")), F.lit("{name}"), F.col("name")), F.lit("{version}"), F.col("version"))) for kind, (_, shape) in LOCKS.items()))
    texts = rows.withColumn("entry", entry).groupBy("c_nationkey", "kind").agg(F.array_join(F.sort_array(F.collect_list("entry")), "").alias("text"))
    return manifests.inventory(texts.select(F.concat(F.lit("app"), F.col("c_nationkey").cast("string"), F.lit("/"), "kind").alias("path"), "text"))


STATED = ["Apache-2.0", "GPL-3.0", "UNKNOWN", "MPL-2.0", "MIT OR GPL-2.0-only", ""]
CLASS_OF = ["permissive", "strong", "unknown", "weak", "permissive", "unknown"]


@query(f"""SELECT (['python', 'npm', 'cargo', 'maven'])[p_partkey % 4 + 1] AS ecosystem, ({listed(CLASS_OF)})[CASE WHEN p_size % 6 = 4 THEN 0 ELSE p_size % 6 END + 1] AS class, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL""")
def installed_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of installed packages from the metadata of four ecosystems, by class."""
    k, licence = F.col("p_partkey").cast("string"), pick(STATED, F.col("p_size") % 6)
    shape = F.col("p_partkey") % 4
    path = F.when(shape == 0, F.concat(F.lit("site/p"), k, F.lit("-1.dist-info/METADATA"))).when(shape == 1, F.concat(F.lit("node_modules/p"), k, F.lit("/package.json")))
    path = path.when(shape == 2, F.concat(F.lit("registry/src/index/p"), k, F.lit("-1.0/Cargo.toml"))).otherwise(F.concat(F.lit(".m2/repository/org/x/p"), k, F.lit("/1/p-1.pom")))
    body = F.when(shape == 0, F.concat(F.lit("Name: p"), k, F.lit("\nVersion: 1\nLicense: "), licence, F.lit("\n"))).when(shape == 1, F.concat(F.lit('{"name": "p'), k, F.lit('", "version": "1", "license": "'), licence, F.lit('"}')))
    body = body.when(shape == 2, F.concat(F.lit('[package]\nlicense = "'), licence, F.lit('"\n'))).otherwise(F.concat(F.lit("<project><licenses><license><name>"), licence, F.lit("</name></license></licenses></project>")))
    found = manifests.licence_metadata(table(spark, sf_dir, "part").select(path.alias("path"), body.alias("text")))
    first = F.regexp_extract("licence", r"^(\S+)", 1)
    return found.groupBy("ecosystem", licence_class(first).alias("class")).agg(F.count_distinct("name").alias("n"))


@query("""SELECT c_nationkey AS nation, count(*) AS n, count(DISTINCT 'v' || c_custkey % 7) AS versions, count(*) FILTER (c_custkey % 5 = 0) AS managed FROM customer GROUP BY 1""")
def pom_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maven files spelled from customers, with properties, managed versions and exclusions, and what the parser finds."""
    k = F.col("c_custkey")
    dep = F.concat(F.lit("<dependency><version>${v"), (k % 7).cast("string"), F.lit("}</version><artifactId>a"), k.cast("string"), F.lit("</artifactId><groupId>g</groupId><exclusions><exclusion><artifactId>x</artifactId><groupId>g</groupId></exclusion></exclusions></dependency>"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(F.when(k % 5 != 0, dep)), "").alias("plain"), F.array_join(F.collect_list(F.when(k % 5 == 0, dep)), "").alias("fixed"))
    head = '<?xml version="1.0"?><project xmlns="m"><parent><groupId>g</groupId><artifactId>p</artifactId><version>3</version></parent><properties>' + "".join(f"<v{i}>1.{i}</v{i}>" for i in range(7)) + "</properties><!-- <dependencies/> -->"
    pom = F.concat(F.lit(head + "<dependencyManagement><dependencies>"), "fixed", F.lit("</dependencies></dependencyManagement><dependencies>"), "plain", F.lit("</dependencies></project>"))
    found = manifests.poms(rows.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/pom.xml")).alias("path"), pom.alias("text")))
    good = found.where(F.startswith("version", F.lit("1.")) & (F.element_at("exclusions", 1) == "g:x") & (F.col("parent") == "g:p"))
    return good.groupBy(F.regexp_extract("manifest", "[0-9]+", 0).cast("int").alias("nation")).agg(F.count("*").alias("n"), F.count_distinct("version").alias("versions"), F.count_if("managed").alias("managed"))


@query("""WITH e AS (SELECT DISTINCT s_nationkey % 20 AS a, s_suppkey % 23 AS b FROM supplier) SELECT DISTINCT 'src/m' || a || '.java' AS src, 'src/m' || b || '.java' AS dst FROM e WHERE a <> b AND a < 15 AND b < 15""")
def scraped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrows of a dependency listing, joined to the files that have the names."""
    arrow = F.concat(F.lit('  "m'), (F.col("s_nationkey") % 20).cast("string"), F.lit('" -> "m'), (F.col("s_suppkey") % 23).cast("string"), F.lit('";'))
    listing = table(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey") % 5).agg(F.array_join(F.collect_list(arrow), "\n").alias("t"))
    names = spark.createDataFrame([(f"m{i}", f"src/m{i}.java") for i in range(15)], "name string, path string")
    return reports.file_edges(reports.arrow_edges(listing, "t"), names)


@query("""SELECT CASE WHEN s_suppkey % 4 = 2 THEN 'new' || s_suppkey ELSE 'f' || s_suppkey END || '.py' AS path, (['A', 'M', 'A', 'D'])[s_suppkey % 4 + 1] AS change FROM supplier WHERE s_suppkey % 3 > 0
UNION ALL SELECT 'f' || s_suppkey || '.py', 'D' FROM supplier WHERE s_suppkey % 4 = 2 AND s_suppkey % 3 > 0""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths below the project from a name-status listing; a rename deletes one path and adds the other."""
    k = F.col("s_suppkey")
    folder = F.when(k % 3 > 0, "app/").otherwise("other/")
    path = lambda stem: F.concat(folder, F.lit(stem), k.cast("string"), F.lit(".py"))
    row = F.when(k % 4 == 0, F.concat(F.lit("A\t"), path("f"))).when(k % 4 == 1, F.concat(F.lit("M\t"), path("f"))).when(k % 4 == 2, F.concat(F.lit("R100\t"), path("f"), F.lit("\t"), path("new"))).otherwise(F.concat(F.lit("D\t"), path("f")))
    listing = table(spark, sf_dir, "supplier").groupBy(k % 7).agg(F.array_join(F.collect_list(row), "\n").alias("d"))
    return reports.changed_paths(listing, "d", "app/")


@query("""SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS commits, max(c) AS most FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderkey) AS c FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 = 0))""")
def commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and their paths from exported logs: rows, commits and the most paths of one."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select("l_orderkey", "l_linenumber").distinct()
    blocks = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("src/f"), F.col("l_linenumber").cast("string"), F.lit(".py"))), "\n").alias("p"))
    block = F.concat(F.lit("commit "), F.sha1(F.col("l_orderkey").cast("string")), F.lit("\n"), "p", F.lit("\n"))
    logs = blocks.groupBy(F.expr("l_orderkey div 1000")).agg(F.array_join(F.sort_array(F.collect_list(block)), "").alias("log"))
    found = reports.commit_log(logs, "log")
    per = found.groupBy("commit").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("rows"), F.count("*").alias("commits"), F.max("c").alias("most"))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 4 > 0 THEN 'v' || p_size END AS answer FROM part""")
def cached_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with the answers that a cache table knows; an unknown key is no error."""
    parts = table(spark, sf_dir, "part")
    answers = parts.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("key"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("answer"))
    return manifests.lookup(parts.select(F.col("p_partkey").alias("key")), answers)


@query(f"""WITH {FINDINGS} SELECT file, line, cls AS rule, CASE WHEN cls = 1 THEN 'cwe-89' END AS family FROM fnd WHERE engine = 'error'""")
def sarif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as one SARIF document a project, read back by the SARIF source."""
    where = fresh(spark, "sarif")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("cls").cast("string").alias("ruleId"), F.struct(F.lit("m").alias("text")).alias("message"), F.struct(F.array(F.lit("x"), F.when(F.col("cls") == 1, "cwe-89").otherwise("y")).alias("tags")).alias("properties"), F.array(place).alias("locations"))
    runs = findings(spark, sf_dir, "error").groupBy("project").agg(F.collect_list(result).alias("results")).select("project", F.to_json(F.struct(F.array(F.struct("results")).alias("runs"))).alias("value"))
    runs.repartition("project").write.partitionBy("project").text(where)
    return reports.sarif(spark, where, ["cwe-79", "cwe-89"]).select("file", F.col("line").cast("long").alias("line"), F.col("rule").cast("int").alias("rule"), "family")


@query("""WITH t AS (SELECT r_name || '/' || n_name || '/' || (['a.py', 'b.min.js', 'node_modules/c.js', 'd.ts', '.hidden/e.py', 'lib/jquery-3.1.js'])[c_custkey % 6 + 1] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT string_split(path, '/')[1] AS folder, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS lang, count(*) AS n FROM t WHERE path LIKE '%/a.py' OR path LIKE '%/d.ts' GROUP BY ALL""")
def source_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own source files per top folder and language; hidden, vendored and bundled ones are no input."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    name = pick(["a.py", "b.min.js", "node_modules/c.js", "d.ts", ".hidden/e.py", "lib/jquery-3.1.js"], F.col("c_custkey") % 6)
    own = files.own_files(rows.select(F.concat_ws("/", "r_name", "n_name", name).alias("path")))
    return files.census(own.withColumn("lang", files.language(F.col("path"))))


@query("""SELECT DISTINCT 'p' || p_size % 9 || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/src' ELSE '/src/x' END AS root FROM part WHERE p_partkey % 3 = 0 AND p_size % 9 > 3 UNION SELECT DISTINCT 'p' || p_size % 9 || '/src' FROM part WHERE p_partkey % 3 = 1 AND p_size % 9 <= 3""")
def outer_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots without those inside another one."""
    k, n = F.col("p_partkey"), F.col("p_size") % 9
    below = F.when(k % 3 == 0, "").when(k % 3 == 1, "/src").otherwise("/src/x")
    rows = table(spark, sf_dir, "part").where((k % 3 > 0) | (n > 3))
    return files.collapse_roots(rows.select(F.concat(F.lit("p"), n.cast("string"), below).alias("root")))
