"""Operators over facts that parsers deliver: functions, calls, scopes, entities, entry files.

Facts are tables; parsing is not done here. Nothing is guessed: what fits no rule stays out and can be counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File conventions that frameworks load by name, as (reason, regular expression).
ENTRY_FILES = [
    ("main", r"(^|/)(__main__|main|manage|setup|conftest)\.py$|(^|/)(main|index|server)\.[jt]sx?$|(^|/)[Mm]ain\.(rs|java)$"),
    ("test", r"(^|/)(tests?|__tests__|it)/|(^|/)test_[^/]*\.py$|\.(test|spec)\.[jt]sx?$|(Test|Tests|IT)\.java$"),
    ("django", r"(^|/)(apps|admin|urls|wsgi|asgi)\.py$|(^|/)migrations/[0-9]{4}_[^/]*\.py$|(^|/)management/commands/[^/]+\.py$|(^|/)templatetags/[^/]+\.py$"),
    ("cargo", r"(^|/)build\.rs$|(^|/)(src/lib|src/bin/[^/]+)\.rs$|(^|/)(benches|examples)/[^/]+\.rs$"),
    ("tool", r"(^|/)(Gruntfile|gulpfile|service-worker)\.js$|(^|/)[^/]*\.config\.[cm]?[jt]s$|(^|/)scripts/[^/]+$|(^|/)\.[^/]+$"),
]
# Annotations that a container instantiates by itself.
CONTAINER = ["RestController", "Controller", "Service", "Component", "Configuration", "Entity", "Repository"]


def entry_reason(path: Column, text: Column | None = None) -> Column:
    """Why a file is loaded without being imported: a convention of its path or an annotation in its text, else null."""
    found = [F.when(path.rlike(pattern), reason) for reason, pattern in ENTRY_FILES]
    if text is not None:
        found.append(F.when(path.rlike(r"\.java$") & text.rlike("@(" + "|".join(CONTAINER) + r")\b"), "container"))
    return F.coalesce(*found)


def data_folders(files: DataFrame, literals: DataFrame) -> DataFrame:
    """(path, folder): files below a folder that a string in the code names; they are data, not modules.

    ``literals(text)`` are string literals; a literal is a folder if it has a slash and files lie below it. Files meet
    them by an equi-join on the folders above each file.
    """
    named = literals.select(F.regexp_replace("text", "^[.]?/|/+$", "").alias("folder"), "text").where(F.contains("text", F.lit("/")) & (F.col("folder") != "")).select("folder").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = files.select("path", F.explode(above).alias("folder")).join(named, "folder")
    return hits.groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def never_referenced(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Definitions (id, lang, name, public, kept) whose name no token (lang, name, def_id) of the language uses elsewhere.

    ``kept`` marks what a framework or a type reaches (exports, annotations, overrides, trait implementations,
    non-private Java); a token inside the definition itself (``def_id``) is no use. Public ones are tagged ``note``.
    """
    own = definitions.select(F.col("id").alias("d_id"), "lang", "name")
    used = own.join(uses.select("lang", "name", "def_id"), ["lang", "name"]).where(~F.col("def_id").eqNullSafe(F.col("d_id"))).select(F.col("d_id").alias("id")).distinct()
    dead = definitions.where(~F.col("kept")).join(used, "id", "left_anti")
    return dead.select("id", F.when(F.col("public"), "note").otherwise("gate").alias("level"))


def resolve_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (id, file, cls, receiver, name) with the definition (def_id, file, cls, name) that they mean.

    ``imports`` come as columns of the call: ``imported`` (file of the imported name), ``module`` (file of the imported
    module that is the receiver). In order of preference: without a receiver the same file, then the imported file;
    ``this`` and ``self`` the caller's own class; a receiver that is a class of the same or the imported file; a
    receiver that is a module. A receiver that fits none stays out.
    """
    d = definitions.select("def_id", F.col("file").alias("d_file"), F.col("cls").alias("d_cls"), F.col("name").alias("d_name"))
    base = calls.select("id", "file", "cls", "receiver", "name", "imported", "module")
    free, own = F.col("receiver").isNull(), F.col("receiver").isin("this", "self", "Self")
    ways = [
        base.where(free).select("id", F.col("file").alias("d_file"), F.lit(None).cast("string").alias("d_cls"), F.col("name").alias("d_name"), F.lit(1).alias("rank")),
        base.where(free & F.col("imported").isNotNull()).select("id", F.col("imported").alias("d_file"), F.lit(None).cast("string").alias("d_cls"), F.col("name").alias("d_name"), F.lit(2).alias("rank")),
        base.where(own).select("id", F.col("file").alias("d_file"), F.col("cls").alias("d_cls"), F.col("name").alias("d_name"), F.lit(1).alias("rank")),
        base.where(~free & ~own).select("id", F.coalesce("imported", "file").alias("d_file"), F.col("receiver").alias("d_cls"), F.col("name").alias("d_name"), F.lit(1).alias("rank")),
        base.where(~free & ~own & F.col("module").isNotNull()).select("id", F.col("module").alias("d_file"), F.lit(None).cast("string").alias("d_cls"), F.col("name").alias("d_name"), F.lit(2).alias("rank")),
    ]
    # null classes meet as empty text, so that the join stays an equi-join
    keyed = reduce(DataFrame.unionByName, ways).withColumn("d_cls", F.coalesce("d_cls", F.lit("")))
    found = keyed.join(d.withColumn("d_cls", F.coalesce("d_cls", F.lit(""))), ["d_file", "d_cls", "d_name"])
    return found.groupBy("id").agg(F.min(F.struct("rank", "def_id"))["def_id"].alias("def_id"))


def typed_calls(calls: DataFrame, methods: DataFrame, implements: DataFrame, most: int = 3) -> DataFrame:
    """(id, def_id, how): targets of calls (id, type, name, arity) among methods (def_id, cls, name, arity).

    A known receiver type picks its class and, for an interface, every implementation (``implements(cls, type)``); an
    unknown type (null) falls back to name and arity if at most ``most`` methods have them.
    """
    by_class = implements.select("type", "cls").unionByName(methods.select(F.col("cls").alias("type"), "cls")).distinct()
    known = calls.where("type is not null").join(by_class, "type").join(methods, ["cls", "name", "arity"]).select("id", "def_id", F.lit("type").alias("how"))
    few = methods.groupBy("name", "arity").agg(F.count("*").alias("n")).where(F.col("n") <= most).drop("n")
    loose = calls.where("type is null").join(few, ["name", "arity"]).join(methods, ["name", "arity"]).select("id", "def_id", F.lit("name").alias("how"))
    return known.unionByName(loose).distinct()


def owned_entities(fields: DataFrame, user: str = "User") -> DataFrame:
    """(entity, through): entities that a user owns, directly (``through`` null) or over one single-valued field.

    ``fields(entity, field, type, many)``; collections own nothing.
    """
    single = fields.where(~F.col("many"))
    direct = single.where(F.col("type") == user).select("entity").distinct()
    hop = single.join(direct.withColumnRenamed("entity", "type"), "type").groupBy("entity").agg(F.min("field").alias("through"))
    return direct.withColumn("through", F.lit(None).cast("string")).unionByName(hop.join(direct, "entity", "left_anti"))


def unchecked_access(handlers: DataFrame, services: DataFrame, fields: DataFrame, logins: bool = True, user: str = "User") -> DataFrame:
    """(id, entity, through): handlers (id, service, entity, checked) that load a user-owned entity without a check.

    A check in the handler or in the service (``services(service, checked)``) that it calls silences it. A project
    without logins has no findings.
    """
    loads = handlers.where(~F.col("checked") & F.lit(logins)).join(services.where("checked").select("service"), "service", "left_anti")
    return loads.join(owned_entities(fields, user), "entity").select("id", "entity", "through")


def wrappers(functions: DataFrame) -> DataFrame:
    """(id, target): functions whose only statement hands their own parameters, all and in order, to one call.

    ``functions(id, statements, params, args, names, target, decorated, constructor)``: ``args`` are the argument texts
    and ``names`` the keywords they are passed under (null by position; by keyword the order doesn't matter).
    Decorated functions and factories over a constructor are no wrappers, nor is a function without parameters.
    """
    keyed = F.size(F.filter("names", lambda n: n.isNotNull())) == F.size("args")
    same = (F.col("args") == F.col("params")) | (keyed & (F.col("names") == F.col("args")) & (F.sort_array("args") == F.sort_array("params")))
    plain = (F.col("statements") == 1) & ~F.col("decorated") & ~F.col("constructor") & (F.size("params") > 0)
    return functions.where(plain & F.col("target").isNotNull() & same).select("id", "target")


def leftovers(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """(file, scope, name, kind): imports, variables and parameters that nothing in their scope uses.

    ``definitions(file, scope, name, kind)`` and ``uses(file, scope, name)``. Names with a leading underscore are left
    alone on purpose; in a file that only re-exports (``kind = 'import'`` and used by other files) uses carry that
    file's name too, as any use does.
    """
    meant = definitions.where(~F.startswith("name", F.lit("_")))
    return meant.join(uses.select("file", "scope", "name").distinct(), ["file", "scope", "name"], "left_anti").select("file", "scope", "name", "kind").distinct()


def swallowed(handlers: DataFrame) -> DataFrame:
    """(file, line): exception handlers (file, line, statements, reraises, logs) that drop the error."""
    return handlers.where((F.col("statements") == 0) | (~F.col("reraises") & ~F.col("logs") & (F.col("statements") <= 1))).select("file", "line")


# What a construct adds to the cognitive complexity; the second number is whether nesting adds to it.
COGNITIVE = {"if": (1, 1), "for": (1, 1), "while": (1, 1), "except": (1, 1), "ternary": (1, 1), "elif": (1, 0), "else": (1, 0), "boolean": (1, 0), "recursion": (1, 0), "comprehension": (1, 1), "comprehension_for": (1, 0), "comprehension_if": (1, 0)}


def cognitive(constructs: DataFrame) -> DataFrame:
    """(fn, cognitive): the sum over a function's constructs (fn, kind, nesting); an ``if`` in an ``else`` nests, an ``elif`` doesn't."""
    table = lambda k: F.create_map(*(F.lit(x) for name, v in COGNITIVE.items() for x in (name, v[k])))
    cost = F.coalesce(F.try_element_at(table(0), "kind"), F.lit(0)) + F.coalesce(F.try_element_at(table(1), "kind"), F.lit(0)) * F.col("nesting")
    return constructs.groupBy("fn").agg(F.sum(cost).alias("cognitive"))


# The limits of the style metrics; tests may have twice the lines.
STYLE_LIMITS = {"lines": 60, "cognitive": 15, "cyclomatic": 10, "nesting": 4, "params": 5}


def style_findings(functions: DataFrame, limits: dict[str, int] = STYLE_LIMITS, file_lines: int = 400) -> DataFrame:
    """(file, name, metric, value, limit): metrics over their limit, and files of more than ``file_lines`` lines.

    ``functions(file, name, test, <metrics>, end)``: one pass unpivots the metrics of each function.
    """
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value"), (F.when(F.col("test"), 2 * n).otherwise(n) if m == "lines" else F.lit(n)).alias("limit")) for m, n in limits.items()))
    each = functions.select("file", "name", F.explode(cells).alias("c")).select("file", "name", "c.*").where("value > limit")
    whole = functions.groupBy("file").agg(F.max("end").cast("long").alias("value")).where(F.col("value") > file_lines)
    return each.unionByName(whole.select("file", F.lit("").alias("name"), F.lit("file").alias("metric"), "value", F.lit(file_lines).alias("limit")))


def advice(files: DataFrame, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """(path, rule): modernising advice (rule, lang, regex, least version) that the detected runtime allows.

    ``files(path, lang, version, text)``; advice is never gated. The rules are parameters, tested in one pass.
    """
    hits = [F.when((F.col("lang") == lang) & (F.col("version") >= least) & F.col("text").rlike(pattern), rule) for rule, lang, pattern, least in rules]
    return files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("rule"))


# What the literal of an assembled string shows, and the class of sinks that take it.
LITERALS = [
    ("sql", r"(?i)\b(select|insert into|update|delete from)\b.*\b(from|into|set|where|values)\b|(?i)\bselect\b"),
    ("template", r"\{\{|\{%"),
    ("html", r"</?[a-zA-Z][^>]*>?"),
    ("url", r"^https?://"),
    ("path", r"^[./~]?[\w.-]*/[\w./-]*$"),
]
# Sink kinds and their weakness; a kind with the literal class "any" takes every assembled string.
SINKS = [("shell", "any", "CWE-78"), ("eval", "any", "CWE-95"), ("sql", "sql", "CWE-89"), ("path", "path", "CWE-22"), ("html", "html", "CWE-79"), ("template", "template", "CWE-1336"), ("url", "url", "CWE-918")]


def literal_class(text: Column) -> Column:
    """The class of an assembled string's literal part: sql, template, html, url, path, else ``plain``."""
    return F.coalesce(*(F.when(text.rlike(pattern), name) for name, pattern in LITERALS), F.lit("plain"))


def assembled_uses(assigns: DataFrame, uses: DataFrame, reach: int = 40) -> DataFrame:
    """(file, line, def_line, cwe): strings assembled above and used in a sink within ``reach`` lines.

    ``assigns(file, unit, line, name, literal)``: ``literal`` is null where nothing is assembled (a plain
    reassignment clears the name). ``uses(file, unit, line, name, sink)``. The last assignment above a use counts; the
    class of its literal must be the sink's, unless the sink takes any. The join has equal keys and cells of lines.
    """
    cell = lambda c: F.floor(c / F.lit(reach))
    defs = assigns.select("file", "unit", "name", F.col("line").alias("def_line"), "literal").withColumn("cell", F.explode(F.array(cell(F.col("def_line")), cell(F.col("def_line")) + 1)))
    near = uses.withColumn("cell", cell(F.col("line"))).join(defs, ["file", "unit", "name", "cell"]).where((F.col("def_line") < F.col("line")) & (F.col("line") - F.col("def_line") <= reach))
    last = near.groupBy("file", "unit", "line", "name", "sink").agg(F.max_by(F.struct("def_line", "literal"), "def_line").alias("d"))
    kind = literal_class(F.col("d.literal"))
    cwe = F.coalesce(*(F.when((F.col("sink") == s) & (F.lit(takes == "any") | (kind == takes)), code) for s, takes, code in SINKS))
    return last.where(F.col("d.literal").isNotNull()).select("file", "line", F.col("d.def_line").alias("def_line"), cwe.alias("cwe")).where("cwe is not null")


# How each defensive fact is treated.
DEFENSIVE = {"RETURN": "gate", "OPEN": "gate", "DOOR": "advice", "ASSERT": "advice"}


def defensive(facts: DataFrame) -> DataFrame:
    """(file, functions, typed, untyped, models, strict, gated, advised): guard counts of each file's facts.

    ``facts(file, kind, typed_params, params, test)`` with kinds ``function``, ``model``, ``strict_model`` and the four
    spots. Spots in tests don't count.
    """
    kind, own = F.col("kind"), ~F.col("test")
    gate, advise = (([k for k, v in DEFENSIVE.items() if v == level]) for level in ("gate", "advice"))
    fn = (kind == "function") & own
    return facts.groupBy("file").agg(
        F.count_if(fn).alias("functions"),
        F.count_if(fn & (F.col("typed_params") == F.col("params"))).alias("typed"),
        F.count_if(fn & (F.col("typed_params") == 0) & (F.col("params") > 0)).alias("untyped"),
        F.count_if(kind.isin("model", "strict_model") & own).alias("models"),
        F.count_if((kind == "strict_model") & own).alias("strict"),
        F.count_if(kind.isin(*gate) & own).alias("gated"),
        F.count_if(kind.isin(*advise) & own).alias("advised"),
    )


def last_before(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Rows with the value of the row before them in their group."""
    return rows.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
