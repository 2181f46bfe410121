"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no project source, file names of well-known bundled code, languages by suffix.
SKIPPED = ["node_modules", "vendor", "third_party", "dist", "build", "target", "out", "venv", "site-packages", "bower_components", "__pycache__", "docs"]
BUNDLED = r"(?i)(\.min\.|\.bundle\.|[-.]pack\.)[a-z]+$|/(jquery|bootstrap|angular|react|vue|lodash|d3|moment)([-.][0-9.]*)?\.js$"
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "rs": "rust", "abap": "abap", "go": "go", "rb": "ruby"}


def collapse_roots(roots: DataFrame) -> DataFrame:
    """Roots (column ``root``) without those inside another root, which would be read twice.

    A root meets the folders above it by an equi-join, so roots are never held against all others.
    """
    parts = F.split("root", "/")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    whole = roots.distinct()
    inside = whole.select("root", F.explode(above).alias("outer")).join(whole.select(F.col("root").alias("outer")), "outer").select("root")
    return whole.join(inside, "root", "left_anti")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, lang, text) of the project's own source files below ``folder``; lang is null for other suffixes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//)?", ""), "^" + base.replace(".", "\\.") + "/", "")
    rows = raw.select(path.alias("path"), F.col("content"))
    return own_files(rows).select("path", language(F.col("path")).alias("lang"), F.decode("content", "UTF-8").alias("text"))


def language(path):
    suffix = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.lower(suffix))


def own_files(rows: DataFrame) -> DataFrame:
    """Rows whose ``path`` is not hidden, not in a skipped folder and not a bundled library."""
    p = F.col("path")
    return rows.where(~p.rlike(r"(^|/)\.[^/]") & ~p.rlike("(^|/)(" + "|".join(SKIPPED) + ")/") & ~F.concat(F.lit("/"), p).rlike(BUNDLED))


def census(files: DataFrame) -> DataFrame:
    """Files per top folder and language."""
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    return files.where("lang is not null").groupBy(top.alias("folder"), "lang").agg(F.count("*").alias("n"))


def skip_marked(lines: DataFrame, marker: str, first: int = 30) -> DataFrame:
    """Lines (id, line, text) of files that don't carry the skip marker in their first lines."""
    marked = lines.where((F.col("line") <= first) & F.contains("text", F.lit(marker))).select("id").distinct()
    return lines.join(marked, "id", "left_anti")
