"""Queries over facts of code: entries, calls, scopes, wrappers, metrics, spans.

Facts are spelled from table keys; each query's SQL spells the same facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import strings
from siltstone.functions.code import code_only, credential_like
from siltstone.operators import bands, facts, graph, scoring
from siltstone.plans.bindings import CLOSURE, FINDINGS, findings, modules, modules_sql, table
from siltstone.plans.graphs import DEGREES, GRAPH, LAYER, SPARSE
from siltstone.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


def pick(values: list, at: Column) -> Column:
    """One of a list of constants by a 0-based number."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def listed(values: list[str]) -> str:
    """A list of texts in SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- files ---------------------------------------------------------------------------------------------------------

NAMES = ["manage.py", "shop/admin.py", "shop/migrations/0001_initial.py", "shop/forgotten.py", "build.rs", "util/src/bin/tool.rs", "util/src/orphan.rs", "src/it/java/PetIT.java", "Gruntfile.js", "scripts/release.js", "src/index.ts", "src/unused.ts", "web/app.spec.ts", ".eslintrc.js", "app/PetService.java", "app/Helper.java"]
SOURCE = ["x = 1", "@Service\npublic class PetService { }", "import os"]
TREE = f"tree AS (SELECT c_custkey AS id, 'p' || c_nationkey || '/' || ({listed(NAMES)})[c_custkey % {len(NAMES)} + 1] AS path, ({listed(SOURCE)})[c_custkey % 3 + 1] AS text FROM customer)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.concat(F.lit("p"), F.col("c_nationkey").cast("string"), F.lit("/"), pick(NAMES, k % len(NAMES)))
    return table(spark, sf_dir, "customer").select(k.alias("id"), path.alias("path"), pick(SOURCE, k % 3).alias("text"))


REASONS = " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{r}'" for r, p in facts.ENTRY_FILES)


@query(f"""WITH {TREE}, e AS (SELECT CASE {REASONS} WHEN regexp_matches(path, '\\.java$') AND regexp_matches(text, '@({"|".join(facts.CONTAINER)})\\b') THEN 'container' END AS reason FROM tree)
SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM e GROUP BY 1""")
def entry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a framework, a build or a tool loads without an import, by reason."""
    reason = F.coalesce(facts.entry_reason(F.col("path"), F.col("text")), F.lit("none"))
    return tree(spark, sf_dir).select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


LITERALS = ["./p3/shop/", "p4/src/it", "plain", "p5/util/src/bin/", "p6", "/p7/scripts", "p8/none/here"]


@query(f"""WITH {TREE}, l AS (SELECT regexp_replace(t, '^[.]?/|/+$', '', 'g') AS folder FROM (SELECT unnest({listed(LITERALS)}) AS t) WHERE contains(t, '/')),
h AS (SELECT path, max_by(folder, length(folder)) AS folder FROM tree JOIN l ON starts_with(path, folder || '/') GROUP BY path) SELECT folder, count(*) AS files FROM h GROUP BY folder""")
def data_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that a string in the code names, with the distinct files below them."""
    literals = spark.createDataFrame([(x,) for x in LITERALS], "text string")
    return facts.data_folders(tree(spark, sf_dir).select("path").distinct(), literals).groupBy("folder").agg(F.count("*").alias("files"))


@query(f"""WITH {TREE}, c AS (SELECT path, regexp_matches(path, '(^|/)tests?/|(^|/)test_[^/]*$|_test\\.[a-z]+$|Tests?\\.java$') AS one,
  len(list_intersect(string_split(path, '/'), ['tests', 'test', '__tests__', 'fixtures'])) > 0 OR starts_with(string_split(path, '/')[-1], 'test_') OR contains(path, '.test.') OR contains(path, '.spec.') AS two
  FROM (SELECT CASE id % 4 WHEN 0 THEN path WHEN 1 THEN 'fixtures/' || path WHEN 2 THEN 'a/test_' || id || '.py' ELSE 'lib/tests/' || path END AS path FROM tree)) SELECT one, two, count(*) AS n FROM c GROUP BY ALL""")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two test rules side by side; they differ and both are kept."""
    k = F.col("id") % 4
    path = F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("fixtures/"), "path")).when(k == 2, F.concat(F.lit("a/test_"), F.col("id").cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("lib/tests/"), "path"))
    told = tree(spark, sf_dir).select(path.alias("path"))
    return told.select(strings.test_path(F.col("path")).alias("one"), strings.test_folder_path(F.col("path")).alias("two")).groupBy("one", "two").agg(F.count("*").alias("n"))


# --- names and calls -----------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT p_partkey AS id, (['python', 'js', 'java'])[p_partkey % 3 + 1] AS lang, 'n' || p_partkey % 700 AS name, p_size % 2 = 0 AS public, p_size % 9 = 0 OR (p_partkey % 3 = 2 AND p_size % 2 = 0) AS kept FROM part),
u AS (SELECT DISTINCT (['python', 'js', 'java'])[l_partkey % 3 + 1] AS lang, 'n' || l_partkey % 700 AS name, CASE WHEN l_quantity >= 50 THEN NULL ELSE l_partkey END AS def_id FROM lineitem WHERE l_quantity >= 49 AND l_partkey % 700 < 300)
SELECT id, CASE WHEN public THEN 'note' ELSE 'gate' END AS level FROM d WHERE NOT kept AND NOT EXISTS (SELECT 1 FROM u WHERE u.lang = d.lang AND u.name = d.name AND u.def_id IS DISTINCT FROM d.id)""")
def dead_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose name no token of their language uses outside of them; public ones are a note."""
    lang = lambda c: pick(["python", "js", "java"], F.col(c) % 3)
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 700).cast("string"))
    public = F.col("p_size") % 2 == 0
    kept = (F.col("p_size") % 9 == 0) | ((F.col("p_partkey") % 3 == 2) & public)
    definitions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), lang("p_partkey").alias("lang"), name("p_partkey").alias("name"), public.alias("public"), kept.alias("kept"))
    tokens = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 and l_partkey % 700 < 300")
    uses = tokens.select(lang("l_partkey").alias("lang"), name("l_partkey").alias("name"), F.when(F.col("l_quantity") < 50, F.col("l_partkey")).alias("def_id")).distinct()
    return facts.never_referenced(definitions, uses)


CALLS = f"""cl AS (SELECT event_id AS id, 'f' || user_id % 40 AS file, 'C' || user_id % 3 AS cls,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'self' WHEN 2 THEN 'C' || event_id % 3 WHEN 3 THEN 'm' || event_id % 7 END AS receiver, 'n' || event_id % 11 AS name,
  CASE WHEN event_id % 2 = 0 THEN 'f' || event_id % 41 END AS imported, CASE WHEN event_id % 5 = 3 AND event_id % 4 > 0 THEN 'f' || event_id % 43 END AS module FROM events WHERE event_type = 'click'),
df AS (SELECT s_suppkey AS def_id, 'f' || s_suppkey % 43 AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'C' || s_suppkey % 3 END AS cls, 'n' || s_suppkey % 11 AS name FROM supplier)"""


@query(f"""WITH {CALLS}, k AS (SELECT id, file AS f, '' AS c, name, 1 AS rank FROM cl WHERE receiver IS NULL UNION ALL SELECT id, imported, '', name, 2 FROM cl WHERE receiver IS NULL
UNION ALL SELECT id, file, cls, name, 1 FROM cl WHERE receiver = 'self' UNION ALL SELECT id, coalesce(imported, file), receiver, name, 1 FROM cl WHERE receiver <> 'self' UNION ALL SELECT id, module, '', name, 2 FROM cl WHERE receiver <> 'self'),
m AS (SELECT id, def_id, rank FROM k JOIN df ON df.file = f AND coalesce(df.cls, '') = c AND df.name = k.name) SELECT id, def_id FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, def_id) = 1""")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and the definitions they mean: own file, import, own class, named class, imported module."""
    e, k = table(spark, sf_dir, "events").where("event_type = 'click'"), F.col("event_id")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    receiver = F.when(k % 5 == 1, "self").when(k % 5 == 2, text("C", k % 3)).when(k % 5 == 3, text("m", k % 7)).when(k % 5 == 4, F.lit(None).cast("string"))
    calls = e.select(k.alias("id"), text("f", F.col("user_id") % 40).alias("file"), text("C", F.col("user_id") % 3).alias("cls"), receiver.alias("receiver"), text("n", k % 11).alias("name"), F.when(k % 2 == 0, text("f", k % 41)).alias("imported"), F.when((k % 5 == 3) & (k % 4 > 0), text("f", k % 43)).alias("module"))
    s = F.col("s_suppkey")
    definitions = table(spark, sf_dir, "supplier").select(s.alias("def_id"), text("f", s % 43).alias("file"), F.when(s % 2 == 0, text("C", s % 3)).alias("cls"), text("n", s % 11).alias("name"))
    return facts.resolve_calls(calls, definitions)


@query("""WITH m AS (SELECT p_partkey AS def_id, 'C' || p_size % 20 AS cls, 'm' || p_partkey % 97 AS name, p_size % 3 AS arity FROM part), i(type, cls) AS (VALUES ('I1', 'C1'), ('I1', 'C2'), ('I2', 'C3')),
c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'C' || o_custkey % 20 WHEN 1 THEN 'I' || o_custkey % 3 END AS type, 'm' || o_custkey % 97 AS name, o_orderkey % 3 AS arity FROM orders),
b AS (SELECT * FROM i UNION SELECT cls, cls FROM m) SELECT DISTINCT c.id, def_id, 'type' AS how FROM c JOIN b ON b.type = c.type JOIN m ON m.cls = b.cls AND m.name = c.name AND m.arity = c.arity
UNION SELECT c.id, def_id, 'name' FROM c JOIN m ON m.name = c.name AND m.arity = c.arity WHERE c.type IS NULL AND (SELECT count(*) FROM m x WHERE x.name = c.name AND x.arity = c.arity) <= 3""")
def typed_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    methods = table(spark, sf_dir, "part").select(p.alias("def_id"), text("C", F.col("p_size") % 20).alias("cls"), text("m", p % 97).alias("name"), (F.col("p_size") % 3).cast("long").alias("arity"))
    kind = F.when(o % 4 == 0, text("C", F.col("o_custkey") % 20)).when(o % 4 == 1, text("I", F.col("o_custkey") % 3))
    calls = table(spark, sf_dir, "orders").select(o.alias("id"), kind.alias("type"), text("m", F.col("o_custkey") % 97).alias("name"), (o % 3).cast("long").alias("arity"))
    implements = spark.createDataFrame([("I1", "C1"), ("I1", "C2"), ("I2", "C3")], "type string, cls string")
    return facts.typed_calls(calls, methods, implements)


ENTITY_FIELDS = [("Account", "owner", "User", False), ("Operation", "account", "Account", False), ("Label", "name", "String", False), ("Team", "members", "User", True), ("Audit", "operation", "Operation", False), ("Card", "account", "Account", False), ("Card", "holder", "User", False)]
ENTITIES = ["Account", "Operation", "Label", "Team", "Audit", "Card"]


@query(f"""WITH f(entity, field, type, many) AS (VALUES {", ".join(f"('{e}', '{n}', '{t}', {m})" for e, n, t, m in ENTITY_FIELDS)}), d AS (SELECT DISTINCT entity FROM f WHERE NOT many AND type = 'User'),
w AS (SELECT entity, NULL AS through FROM d UNION ALL SELECT entity, min(field) FROM f WHERE NOT many AND type IN (SELECT entity FROM d) AND entity NOT IN (SELECT entity FROM d) GROUP BY entity)
SELECT o_orderkey AS id, entity, through FROM orders JOIN w ON entity = ({listed(ENTITIES)})[o_custkey % 6 + 1] WHERE o_orderstatus <> 'F' AND NOT (o_custkey % 5 = 0)""")
def owned_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers that load a user-owned entity with no check in them or in the service they call."""
    handlers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("service"), pick(ENTITIES, F.col("o_custkey") % 6).alias("entity"), (F.col("o_orderstatus") == "F").alias("checked"))
    services = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("service"), (F.col("c_custkey") % 5 == 0).alias("checked"))
    return facts.unchecked_access(handlers, services, spark.createDataFrame(ENTITY_FIELDS, "entity string, field string, type string, many boolean"))


@query("""SELECT p_partkey AS id, 't' || p_size % 9 AS target FROM part WHERE p_size % 4 = 0 AND p_partkey % 7 > 0 AND p_partkey % 5 > 0 AND p_partkey % 3 + 1 > 0 AND CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN p_partkey % 3 = 0 WHEN 2 THEN true WHEN 3 THEN false ELSE false END""")
def pass_through_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of 1 to 3 parameters: handed on in order, reversed by position, reversed by keyword, cut, extended, mixed."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 3 + 1
    params = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("a"), i.cast("string")))
    way, null = k % 6, F.lit(None).cast("string")
    args = F.when(way == 0, params).when(way.isin(1, 2), F.reverse(params)).when(way == 3, F.slice(params, 2, 9)).when(way == 4, F.concat(params, F.array(F.lit("1")))).otherwise(F.concat(params, F.array(F.lit("x"))))
    names = F.when(way == 2, args).otherwise(F.transform(args, lambda a: null))
    functions = table(spark, sf_dir, "part").select(k.alias("id"), F.when(F.col("p_size") % 4 == 0, 1).otherwise(2).alias("statements"), params.alias("params"), args.alias("args"), names.alias("names"), F.concat(F.lit("t"), (F.col("p_size") % 9).cast("string")).alias("target"), (k % 7 == 0).alias("decorated"), (k % 5 == 0).alias("constructor"))
    return facts.wrappers(functions)


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS scope, CASE WHEN l_partkey % 10 = 0 THEN '_' ELSE '' END || 'n' || l_partkey % 50 AS name, (['import', 'variable', 'parameter'])[l_partkey % 3 + 1] AS kind FROM lineitem WHERE l_returnflag = 'A'),
u AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS scope, 'n' || l_partkey % 50 AS name FROM lineitem WHERE l_returnflag <> 'A')
SELECT file, scope, name, kind FROM d WHERE NOT starts_with(name, '_') AND NOT EXISTS (SELECT 1 FROM u WHERE u.file = d.file AND u.scope = d.scope AND u.name = d.name)""")
def leftover_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, variables and parameters that their scope never uses."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("n"), (F.col("l_partkey") % 50).cast("string"))
    base = [F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("scope")]
    given = lines.where("l_returnflag = 'A'").select(*base, F.concat(F.when(F.col("l_partkey") % 10 == 0, "_").otherwise(""), name).alias("name"), pick(["import", "variable", "parameter"], F.col("l_partkey") % 3).alias("kind")).distinct()
    return facts.leftovers(given, lines.where("l_returnflag <> 'A'").select(*base, name.alias("name")))


@query("""SELECT l_suppkey AS file, l_orderkey AS line FROM lineitem WHERE l_linenumber = 1 AND (l_quantity < 5 OR (l_returnflag <> 'R' AND l_linestatus <> 'F' AND l_quantity < 9))""")
def swallowed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers that drop the error: empty ones, and short ones that neither raise again nor log."""
    q = F.col("l_quantity")
    statements = F.when(q < 5, 0).when(q < 9, 1).otherwise(2)
    handlers = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), statements.alias("statements"), (F.col("l_returnflag") == "R").alias("reraises"), (F.col("l_linestatus") == "F").alias("logs"))
    return facts.swallowed(handlers)


CONSTRUCTS = [*facts.COGNITIVE, "call"]


@query(f"""WITH k AS (SELECT l_suppkey AS fn, ({listed(CONSTRUCTS)})[l_partkey % {len(CONSTRUCTS)} + 1] AS kind, l_linenumber - 1 AS nesting FROM lineitem WHERE l_quantity > 40)
SELECT fn, sum(CASE kind {" ".join(f"WHEN '{k}' THEN {a} + {b} * nesting" for k, (a, b) in facts.COGNITIVE.items())} ELSE 0 END)::BIGINT AS cognitive FROM k GROUP BY fn""")
def cognitive_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("fn"), pick(CONSTRUCTS, F.col("l_partkey") % len(CONSTRUCTS)).alias("kind"), (F.col("l_linenumber") - 1).alias("nesting"))
    return facts.cognitive(rows)


@query("""WITH f AS (SELECT 's' || o_custkey AS file, 'f' || o_orderkey AS name, o_custkey % 4 = 0 AS test, count(*) * 19 AS lines, sum(l_linenumber) AS cognitive, max(l_quantity)::BIGINT // 4 AS cyclomatic, count(DISTINCT l_returnflag) + 2 AS nesting, count(*) AS params, max(l_suppkey) * 40 % 450 AS e
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT file, name, unnest(['lines', 'cognitive', 'cyclomatic', 'nesting', 'params']) AS metric, unnest([lines, cognitive, cyclomatic, nesting, params]) AS value, unnest([CASE WHEN test THEN 120 ELSE 60 END, 15, 10, 4, 5]) AS lim FROM f)
SELECT file, name, metric, value::BIGINT AS value, lim AS "limit" FROM m WHERE value > lim UNION ALL SELECT file, '', 'file', max(e)::BIGINT, 400 FROM f GROUP BY file HAVING max(e) > 400""")
def style_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions over a limit and files that are too long; tests may have twice the lines."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.expr("cast(max(l_quantity) as bigint) div 4")
    functions = lines.groupBy("o_custkey", "o_orderkey").agg(
        (F.count("*") * 19).alias("lines"), F.sum("l_linenumber").alias("cognitive"), quantity.alias("cyclomatic"), (F.count_distinct("l_returnflag") + 2).alias("nesting"), F.count("*").alias("params"), (F.max("l_suppkey") * 40 % 450).alias("end")
    )
    named = functions.select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("file"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_custkey") % 4 == 0).alias("test"), *facts.STYLE_LIMITS, "end")
    return facts.style_findings(named)


ADVICE = [("use-removeprefix", "python", r"lstrip\(", 309), ("use-match", "python", r"elif", 310), ("use-at", "js", r"length - 1", 16), ("use-pathlib", "python", r"os\.path", 304)]
LINES = ["x = os.path.join(a)", "y.lstrip('v')", "elif z:", "a[a.length - 1]", "pass"]


@query(f"""WITH f AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'js' ELSE 'python' END AS lang, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 300 + p_size % 14 END AS version, ({listed(LINES)})[p_partkey % 5 + 1] AS text FROM part)
{" UNION ALL ".join(f"SELECT path, '{r}' AS rule FROM f WHERE lang = '{g}' AND version >= {v} AND regexp_matches(text, '{x}')" for r, g, x, v in ADVICE)}""")
def modernise_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, js = F.col("p_partkey"), F.col("p_partkey") % 3 == 0
    files = table(spark, sf_dir, "part").select(k.alias("path"), F.when(js, "js").otherwise("python").alias("lang"), F.when(js, F.col("p_size")).otherwise(300 + F.col("p_size") % 14).alias("version"), pick(LINES, k % 5).alias("text"))
    return facts.advice(files, ADVICE)


PARTS_OF_STRINGS = ["ls ", "select * from t where id = ", "/srv/files/", "<b>", "Hello {{ ", "https://", "file: "]
SINKS = ["shell", "eval", "sql", "path", "html", "template", "url", "log"]
KIND = " ".join(f"WHEN regexp_matches(literal, '{p}') THEN '{n}'" for n, p in [("sql", r"(?i)\bselect\b"), ("template", r"\{\{|\{%"), ("html", r"</?[a-zA-Z][^>]*>?"), ("url", r"^https?://"), ("path", r"^[./~]?[\w.-]*/[\w./-]*$")])
ASSEMBLED = f"""ev AS (SELECT event_id AS id, user_id AS file, user_id % 3 AS unit, event_type, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS line, 'v' || event_id % 2 AS name FROM events),
asg AS (SELECT file, line, name, min(CASE WHEN event_type = 'signup' THEN NULL ELSE id END) AS i, bool_or(event_type = 'signup') AS clears FROM ev WHERE event_type IN ('click', 'signup') GROUP BY file, line, name),
asl AS (SELECT file, line, name, CASE WHEN clears THEN NULL ELSE ({listed(PARTS_OF_STRINGS)})[i % 7 + 1] END AS literal FROM asg),
use AS (SELECT DISTINCT file, line, name, ({listed(SINKS)})[id % 8 + 1] AS sink FROM ev WHERE event_type = 'purchase')"""


@query(f"""WITH {ASSEMBLED}, d AS (SELECT use.*, max_by({{'l': a.line, 't': a.literal}}, a.line) AS d FROM use JOIN asl a ON a.file = use.file AND a.name = use.name AND a.line < use.line AND use.line - a.line <= 400 GROUP BY ALL),
k AS (SELECT *, d.t AS literal FROM d WHERE d.t IS NOT NULL), c AS (SELECT *, CASE {KIND} ELSE 'plain' END AS cls FROM k)
SELECT file, line, d.l AS def_line, CASE WHEN sink = 'shell' THEN 'CWE-78' WHEN sink = 'eval' THEN 'CWE-95' WHEN sink = cls THEN CASE cls {" ".join(f"WHEN '{s}' THEN '{c}'" for s, t, c in facts.SINKS if t != "any")} END END AS cwe FROM c
WHERE sink IN ('shell', 'eval') OR sink = cls""")
def assembled_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings assembled above and used in a sink that takes their class; a reassignment clears the name."""
    found = findings(spark, sf_dir)
    rows = found.select("id", F.regexp_extract("file", "[0-9]+", 0).cast("long").alias("file"), "line", F.col("engine"), F.concat(F.lit("v"), (F.col("id") % 2).cast("string")).alias("name")).withColumn("unit", F.col("file") % 3)
    sets = rows.where("engine in ('click', 'signup')").groupBy("file", "unit", "line", "name").agg(F.min(F.when(F.col("engine") != "signup", F.col("id"))).alias("i"), F.bool_or(F.col("engine") == "signup").alias("clears"))
    assigns = sets.withColumn("literal", F.when(~F.col("clears"), pick(PARTS_OF_STRINGS, F.col("i") % 7)))
    uses = rows.where("engine = 'purchase'").select("file", "unit", "line", "name", pick(SINKS, F.col("id") % 8).alias("sink")).distinct()
    return facts.assembled_uses(assigns, uses, reach=400)


FACTS = ["function", "function", "model", "strict_model", "RETURN", "OPEN", "DOOR", "ASSERT"]


@query(f"""WITH f AS (SELECT l_suppkey AS file, ({listed(FACTS)})[l_partkey % 8 + 1] AS kind, l_linenumber % 3 AS typed, l_linenumber % 4 AS params, l_suppkey % 9 = 0 AS test FROM lineitem WHERE l_quantity > 45)
SELECT file, count(*) FILTER (kind = 'function' AND NOT test) AS functions, count(*) FILTER (kind = 'function' AND NOT test AND typed = params) AS typed, count(*) FILTER (kind = 'function' AND NOT test AND typed = 0 AND params > 0) AS untyped,
count(*) FILTER (kind IN ('model', 'strict_model') AND NOT test) AS models, count(*) FILTER (kind = 'strict_model' AND NOT test) AS strict, count(*) FILTER (kind IN ('RETURN', 'OPEN') AND NOT test) AS gated, count(*) FILTER (kind IN ('DOOR', 'ASSERT') AND NOT test) AS advised FROM f GROUP BY file""")
def defensive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("file"), pick(FACTS, F.col("l_partkey") % 8).alias("kind"), (F.col("l_linenumber") % 3).alias("typed_params"), (F.col("l_linenumber") % 4).alias("params"), (F.col("l_suppkey") % 9 == 0).alias("test"))
    return facts.defensive(rows)


CODE = ['x = "MARK # 1" # MARK', "y = MARK + 'MARK'", "# all MARK", 'z = """a\nMARK\n""" + MARK', "plain"]


@query(f"""WITH t AS (SELECT p_partkey % 5 AS shape, count(*) AS n FROM part GROUP BY 1) SELECT ({listed(CODE)})[shape + 1] AS text, n, ([0, 1, 0, 1, 0])[shape + 1] AS marks FROM t""")
def code_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a marker stands in code, not in strings and comments; the SQL knows the answer of each text."""
    rows = table(spark, sf_dir, "part").select(pick(CODE, F.col("p_partkey") % 5).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return rows.select("text", "n", F.regexp_count(code_only(F.col("text"), F.lit("python")), F.lit("MARK")).alias("marks"))


VALUES = ["abcdefghij0123456789xy", "abc.*def", "tooshort1", "onlyletters_onlyletters", "a-b-c-d-e-f-g-h-i-j-1-2", "key=[a-z0-9]{40}"]


@query(f"SELECT ({listed(VALUES)})[p_size % 6 + 1] AS value, p_size % 6 IN (0, 4) AS credential, count(*) AS n FROM part GROUP BY ALL")
def credential_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(pick(VALUES, F.col("p_size") % 6).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("n")).select("value", credential_like(F.col("value")).alias("credential"), "n")


# --- metrics and spans ---------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_suppkey AS file, l_partkey % 40 AS line, (['lines', 'cyclomatic', 'params'])[l_linenumber % 3 + 1] AS metric, l_quantity::BIGINT AS value FROM lineitem WHERE l_returnflag <> 'R'),
n AS (SELECT l_suppkey AS file, l_partkey % 40 AS line, max(l_linenumber) AS nesting FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
f AS (SELECT file, line, coalesce(max(value) FILTER (metric = 'lines'), 0) AS lines, coalesce(max(value) FILTER (metric = 'cyclomatic'), 1) AS cyclomatic, coalesce(max(value) FILTER (metric = 'params'), 0) AS params FROM r GROUP BY ALL)
SELECT f.*, greatest(2, coalesce(nesting, 2)) AS nesting FROM f LEFT JOIN n USING (file, line)""")
def metric_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of functions as they arrive, one row a function, and the greatest nested value folded into it."""
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 40).alias("line")]
    rows = lines.where("l_returnflag <> 'R'").select(*keys, pick(["lines", "cyclomatic", "params"], F.col("l_linenumber") % 3).alias("metric"), F.col("l_quantity").cast("long").alias("value"))
    functions = scoring.upsert_metrics(rows, ["file", "line"], "metric", "value", {"lines": 0, "cyclomatic": 1, "params": 0})
    nested = lines.where("l_returnflag = 'R'").select(*keys, F.col("l_linenumber").alias("nesting"))
    return scoring.fold_max(functions.withColumn("nesting", F.lit(2)), nested, ["file", "line"], "nesting")


@query(f"""WITH {FINDINGS}, d AS (SELECT l_suppkey AS file, max(l_quantity) FILTER (l_returnflag = 'R') AS ours, max(l_quantity) FILTER (l_returnflag = 'A') AS theirs FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT file, ours, theirs, ours - theirs AS d FROM d WHERE ours IS NOT NULL AND theirs IS NOT NULL ORDER BY abs(ours - theirs) DESC, file""")
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All differences, the largest first."""
    of = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("file")).agg(of("R").alias("ours"), of("A").alias("theirs")).where("ours is not null and theirs is not null")
    return scoring.worst_first(rows, "ours", "theirs", "file")


@query(f"WITH {FINDINGS} SELECT CASE WHEN grouping(project) = 1 THEN 'TOTAL' ELSE project::VARCHAR END AS project, count(*) FILTER (engine = 'error') || ' of ' || count(*) AS cell FROM fnd GROUP BY ROLLUP (project)")
def total_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_shares(findings(spark, sf_dir), "project", F.col("engine") == "error")


LIMITS = {"0": 90, "1": 60, "3": 30}


@query(f"""WITH {FINDINGS}, l(metric, lim) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in LIMITS.items())}) SELECT id, cls::VARCHAR AS metric, value, lim AS "limit" FROM fnd JOIN l ON metric = cls::VARCHAR WHERE value > lim""")
def limits_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir).select("id", F.col("cls").cast("string").alias("metric"), "value")
    return scoring.over_limits(rows, "metric", "value", LIMITS)


GREEDY = """o AS (SELECT id, file, {key} AS k, line FROM fnd WHERE engine = 'error'), t AS (SELECT id, file, {key} AS k, line FROM fnd WHERE engine = 'purchase'),
l AS (SELECT o.id, o.file, o.k, o.line, row_number() OVER (PARTITION BY o.file, o.k ORDER BY o.id) AS n, (SELECT list(t.id ORDER BY t.id) FROM t WHERE t.file = o.file AND t.k = o.k AND abs(t.line - o.line) <= {width}) AS near FROM o),
g AS (SELECT file, k, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS left_id, NULL::BIGINT AS right_id FROM (SELECT DISTINCT file, k FROM o) UNION ALL
  SELECT file, k, n, CASE WHEN m IS NULL THEN taken ELSE list_append(taken, m) END, id, m FROM (SELECT l.file, l.k, l.n, g.taken, l.id, list_filter(l.near, lambda x: NOT list_contains(g.taken, x))[1] AS m FROM g JOIN l ON l.file = g.file AND l.k = g.k AND l.n = g.n + 1))
SELECT left_id, right_id, abs(a.line - b.line) AS distance FROM g JOIN fnd a ON a.id = left_id JOIN fnd b ON b.id = right_id"""


@query(f"WITH RECURSIVE {FINDINGS}, " + GREEDY.format(key="cls", width=720))
def greedy_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of a file and class in order of id, at most 12 hours apart."""
    return bands.greedy_pairs(findings(spark, sf_dir, "error"), findings(spark, sf_dir, "purchase"), ["file", "cls"], "line", 720, "id", "id")


@query(f"WITH RECURSIVE {FINDINGS}, " + GREEDY.format(key="0", width=360))
def greedy_pairing_any_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.greedy_pairs(findings(spark, sf_dir, "error"), findings(spark, sf_dir, "purchase"), ["file"], "line", 360, "id", "id")


SPAN_SQL = """sp AS (SELECT id, file, line AS s, line + 900 AS e, CASE WHEN id % 3 > 0 THEN 'c' || cls END AS name FROM fnd WHERE engine = 'view'), pt AS (SELECT id, file, line, 'c' || cls AS name FROM fnd WHERE engine = 'error'),
l AS (SELECT pt.id, pt.file, row_number() OVER (PARTITION BY pt.file ORDER BY pt.id) AS n, (SELECT list(sp.id ORDER BY (sp.name IS NOT NULL) DESC, s DESC, sp.id) FROM sp WHERE sp.file = pt.file AND pt.line BETWEEN s AND e AND (sp.name IS NULL OR sp.name = pt.name)) AS fit FROM pt),
g AS (SELECT file, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS id, NULL::BIGINT AS span_id FROM (SELECT DISTINCT file FROM pt) UNION ALL
  SELECT file, n, CASE WHEN m IS NULL THEN taken ELSE list_append(taken, m) END, id, m FROM (SELECT l.file, l.n, g.taken, l.id, list_filter(l.fit, lambda x: NOT list_contains(g.taken, x))[1] AS m FROM g JOIN l ON l.file = g.file AND l.n = g.n + 1))
SELECT id, span_id FROM g WHERE span_id IS NOT NULL"""


@query(f"WITH RECURSIVE {FINDINGS}, {SPAN_SQL}")
def span_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and the view spans around them, one to one: an equal name first, then the latest start."""
    name = F.concat(F.lit("c"), F.col("cls").cast("string"))
    spans = findings(spark, sf_dir, "view").select("file", "id", F.col("line").alias("start"), (F.col("line") + 900).alias("end"), F.when(F.col("id") % 3 > 0, name).alias("name"))
    return bands.contained_pairs(findings(spark, sf_dir, "error").select("file", "id", "line", name.alias("name")), spans, "file")


# --- graphs --------------------------------------------------------------------------------------------------------

FACADES = "fac AS (SELECT id FROM nodes WHERE id % 4 = 1)"


@query(f"""WITH RECURSIVE {GRAPH}, {FACADES}, p AS (SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM fac) UNION SELECT p.src, e.dst FROM p JOIN edges e ON e.src = p.dst WHERE p.dst IN (SELECT id FROM fac))
SELECT DISTINCT src, dst FROM p WHERE dst NOT IN (SELECT id FROM fac) AND src <> dst""")
def facade_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = modules(spark, sf_dir)
    return graph.collapsed(edges, nodes.where("id % 4 = 1"))


@query(f"""WITH RECURSIVE {SPARSE}, {CLOSURE}, m AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT component, count(*) AS n, 1::BIGINT AS cuts, true AS acyclic FROM m GROUP BY component""")
def cycle_cut_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic components, how many arcs were cut in each, and whether no cycle is left; each node has one arc out, so one cut is enough."""
    nodes, edges = modules(spark, sf_dir, top=1)
    parts = graph.strong_components(nodes, edges)
    cuts = graph.cycle_cuts(nodes, edges)
    left = graph.strong_components(nodes, edges.join(cuts, ["src", "dst"], "left_anti")).select("id", F.col("component").alias("after"))
    sizes = parts.join(left, "id").groupBy("component").agg(F.count("*").alias("n"), F.bool_and(F.col("id") == F.col("after")).alias("acyclic")).where("n > 1")
    counted = cuts.join(parts, cuts.src == parts.id).groupBy("component").agg(F.count("*").alias("cuts"))
    return sizes.join(counted, "component").select("component", "n", "cuts", "acyclic")


DAG2 = modules_sql(3, acyclic=True).replace("nodes AS", "n2 AS").replace("trade AS", "trade2 AS").replace("edges AS", "e2 AS").replace("FROM trade\n", "FROM trade2\n")


@query(f"""WITH RECURSIVE {SPARSE}, {DAG2}, ly AS (SELECT n_nationkey AS id, {LAYER} AS l FROM nation), up AS (SELECT src, dst FROM edges JOIN ly a ON a.id = src JOIN ly b ON b.id = dst WHERE a.l < b.l AND src % 2 = 0),
lo AS (SELECT * FROM edges EXCEPT SELECT * FROM up), clo AS (SELECT src, dst FROM lo UNION SELECT c.src, e.dst FROM clo c JOIN lo e ON c.dst = e.src),
cy AS (SELECT DISTINCT least(a.src, (SELECT min(x.dst) FROM clo x JOIN clo y ON x.src = y.dst AND x.dst = y.src WHERE x.src = a.src)) AS c FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst),
hb AS (SELECT id FROM n2 WHERE (SELECT count(*) FROM e2 WHERE dst = id) >= 3 AND (SELECT count(*) FROM e2 WHERE src = id) >= 3 AND id <> 20),
n AS (SELECT (SELECT count(*) FROM cy) AS cycle_cuts, (SELECT count(*) FROM up) AS upward_cuts, (SELECT count(*) FROM hb) AS splits) SELECT *, cycle_cuts + upward_cuts + splits AS distance FROM n""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of a graph in two parts: one with an arc out of each node (cycles, upward arcs) and an acyclic one (hubs, ids + 100)."""
    nodes, edges = modules(spark, sf_dir, top=1)
    more_nodes, more = modules(spark, sf_dir, acyclic=True)
    layers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.expr(LAYER).alias("l"))
    a, b = (layers.select(F.col("id").alias(x), F.col("l").alias(f"l_{x}")) for x in ("src", "dst"))
    upward = edges.join(a, "src").join(b, "dst").where("l_src < l_dst and src % 2 = 0")
    every = edges.unionByName(more.select((F.col("src") + 100).alias("src"), (F.col("dst") + 100).alias("dst")))
    return graph.edit_distance(nodes.unionByName(more_nodes.select((F.col("id") + 100).alias("id"))), every, upward, entry="id = 120")


@query(f"""WITH {GRAPH}, p AS (SELECT n_nationkey AS id, [r_name, r_name || '/' || left(n_name, 1), r_name || '/' || left(n_name, 1) || '/' || n_name] AS f FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT id, k AS depth, f[k] AS c FROM p, unnest([1, 2, 3]) AS u(k)), m AS (SELECT count(*) AS m FROM edges), t AS (SELECT s.depth, s.c AS cs, d.c AS cd FROM edges JOIN c s ON s.id = src JOIN c d ON d.id = dst AND d.depth = s.depth),
e AS (SELECT depth, cs AS c, (cs = cd)::INT AS e FROM t UNION ALL SELECT depth, cd, 0 FROM t), g AS (SELECT depth, c, count(*) AS d, sum(e) AS e FROM e GROUP BY depth, c)
SELECT depth, round(sum(e / m - (d / (2 * m)) * (d / (2 * m))), 6) AS q FROM g, m GROUP BY depth""")
def modularity_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = F.array("r_name", F.substring("n_name", 1, 1), "n_name")
    folders = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("c")))
    community = place.select(F.col("n_nationkey").alias("id"), F.explode(folders).alias("f")).select("id", "f.*")
    return graph.modularity(modules(spark, sf_dir)[1], community, "depth")


@query(f"""WITH {GRAPH}, {DEGREES}, s AS (SELECT id, coalesce(round(fan_out / nullif(fan_in + fan_out, 0), 6) <= 0.25, true) AS stable FROM deg)
SELECT count(*) FILTER (stable) AS free, count(*) FILTER (NOT stable) AS counted FROM edges JOIN s ON s.id = dst""")
def reuse_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reuse_arcs(*modules(spark, sf_dir))


@query(f"""WITH RECURSIVE {SPARSE}, r AS (SELECT id FROM nodes WHERE id % 5 = 0 UNION SELECT dst FROM r JOIN edges ON src = id) SELECT id FROM nodes WHERE id % 3 = 1 AND id NOT IN (SELECT id FROM r)""")
def unguarded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed nodes (id % 3 = 1) that no test (id % 5 = 0) reaches."""
    nodes, edges = modules(spark, sf_dir, top=1)
    return graph.unguarded(edges, nodes.where("id % 3 = 1"), nodes.where("id % 5 = 0"))
