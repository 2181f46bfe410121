"""Reports of other engines as finding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.scratch import cut

SARIF = "runs array<struct<results:array<struct<ruleId:string,message:struct<text:string>,properties:struct<tags:array<string>>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row a file, with the schema given: nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_items(texts: DataFrame, column: str, item: str, key: str | None = None) -> DataFrame:
    """Items of JSON outputs: an array, or the array under ``key``; text that is no JSON gives none."""
    kind = f"array<{item}>"
    parsed = F.from_json(column, f"struct<`{key}`:{kind}>")[key] if key else F.from_json(column, kind)
    return texts.select(F.explode(F.coalesce(parsed, F.array().cast(kind))).alias("item"))


def compiler_messages(spark: SparkSession, path: str, lints: list[str]) -> DataFrame:
    """JSON Lines of compiler messages: (file, line, lint) for the lints that are known."""
    schema = "reason string, message struct<code:struct<code:string>,spans:array<struct<file_name:string,line_start:int>>>"
    rows = spark.read.schema(schema).json(path).where("reason = 'compiler-message'")
    first = F.try_element_at("message.spans", F.lit(1))
    return rows.select(first["file_name"].alias("file"), first["line_start"].alias("line"), F.col("message.code.code").alias("lint")).where(F.col("lint").isin(lints))


def sarif(spark: SparkSession, path: str, families: list[str] = ()) -> DataFrame:
    """SARIF results by their first location: (file, line, rule, message, family).

    ``family`` is the first tag that is one of ``families``, null otherwise.
    """
    results = json_document(spark, path, SARIF).select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    known = F.filter(F.coalesce("r.properties.tags", F.array().cast("array<string>")), lambda t: t.isin(list(families)) if families else F.lit(False))
    return results.select(
        place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), F.col("r.ruleId").alias("rule"), F.col("r.message.text").alias("message"), F.try_element_at(known, F.lit(1)).alias("family")
    )


def truth_csv(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Headerless truth rows (name, category, real); rows whose name lacks the prefix are skipped."""
    rows = spark.read.schema("name string, category string, real string, extra string").csv(path)
    return rows.where(F.startswith("name", F.lit(prefix))).select("name", "category", (F.col("real") == "true").alias("real"))


def clone_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ragged clone rows ``lines,tokens,n,line,file,line,file,...``: (lines, tokens, n, where)."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.col("value").rlike("^[0-9]+,[0-9]+,[0-9]+,"))
    where = F.transform(F.sequence(F.lit(3), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(F.get(parts, i + 1).alias("file"), F.get(parts, i).cast("int").alias("line")))
    return rows.select(parts[0].cast("int").alias("lines"), parts[1].cast("int").alias("tokens"), parts[2].cast("int").alias("n"), where.alias("where"))


def metric_csv(spark: SparkSession, path: str, over: int = 10) -> DataFrame:
    """Function metrics with more than nine columns and a complexity over the limit: (file, function, line, ccn)."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.size(parts) > 9)
    told = rows.select(F.regexp_replace(parts[6], '"', "").alias("file"), F.regexp_replace(parts[7], '"', "").alias("function"), F.try_to_number(parts[9], F.lit("999999")).cast("int").alias("line"), parts[1].try_cast("int").alias("ccn"))
    return told.where(F.col("ccn") > over)


def scraped(texts: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """Findings out of text reports: one row a match, the groups named in order."""
    groups = [F.regexp_extract_all(column, F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]
    zipped = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, names, strict=True)))
    return texts.select(F.explode(zipped).alias("m")).select("m.*").distinct()


def arrow_edges(texts: DataFrame, column: str) -> DataFrame:
    """Edges ``a -> b`` of dependency listings and of graph files (quoted names allowed)."""
    return scraped(texts, column, r'"?([\w./:$-]+)"?\s*->\s*"?([\w./:$-]+)"?', ["src", "dst"])


def file_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dst) between names as edges between files (name, path); a name without a file drops its edges."""
    a, b = (files.select(F.col("name").alias(side), F.col("path").alias(f"{side}_path")) for side in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).where("src <> dst").distinct()


def nested_spaces(texts: DataFrame, column: str, depth: int = 64) -> DataFrame:
    """Functions of a metrics report nested in ``spaces``: (name, kind, start_line).

    Each level is one explode of JSON text, since a schema can't be recursive. Levels end as soon as one is empty; a
    report that goes on below ``depth`` raises.
    """
    node = "struct<name:string,kind:string,start_line:int,spaces:array<string>>"
    level, out = cut(texts.select(F.from_json(column, node).alias("n"))), None
    for _ in range(depth):
        rows = level.select("n.name", "n.kind", "n.start_line")
        out = rows if out is None else out.unionByName(rows)
        level = cut(level.select(F.explode("n.spaces").alias("s")).select(F.from_json("s", node).alias("n")))
        if level.isEmpty():
            return out
    raise ValueError(f"a report is nested deeper than {depth}")


def changed_paths(diff: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Changed paths (path, change) of name-status listings of a version comparison, below ``prefix`` and without it.

    One line a file: ``A``, ``M``, ``D`` or ``T`` and the path; of a rename (``R100``) or copy the new path is added
    and, for a rename, the old one deleted.
    """
    rows = diff.select(F.explode(F.split(column, "\n")).alias("row")).select(F.split("row", "\t").alias("f")).where(F.size("f") >= 2)
    kind = F.substring(F.element_at("f", 1), 1, 1)
    pair = F.when(kind == "R", F.array(F.struct(F.element_at("f", 2).alias("path"), F.lit("D").alias("change")), F.struct(F.try_element_at("f", F.lit(3)).alias("path"), F.lit("A").alias("change"))))
    pair = pair.when(kind == "C", F.array(F.struct(F.try_element_at("f", F.lit(3)).alias("path"), F.lit("A").alias("change")))).otherwise(F.array(F.struct(F.element_at("f", 2).alias("path"), kind.alias("change"))))
    told = rows.select(F.explode(pair).alias("p")).select("p.*").where(F.startswith("path", F.lit(prefix)))
    return told.select(F.substring("path", len(prefix) + 1, 10_000).alias("path"), "change").distinct()


def commit_log(log: DataFrame, column: str) -> DataFrame:
    """Commits (seq, commit, path) of an exported log: blocks ``commit <hash>`` with one path a line, oldest first.

    ``log`` has one row an export; ``seq`` counts the commits of a row in order.
    """
    blocks = log.select(F.posexplode(F.filter(F.split(column, "(?m)^commit "), lambda b: b != "")).alias("seq", "block"))
    lines = F.split("block", "\n")
    paths = F.filter(F.slice(lines, 2, F.size(lines)), lambda p: F.trim(p) != "")
    return blocks.select((F.col("seq") + 1).cast("long").alias("seq"), F.trim(lines[0]).alias("commit"), F.explode(paths).alias("path"))
