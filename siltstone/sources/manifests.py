"""Package inventories: one row (ecosystem, name, version, manifest) for each pinned package of lock files.

Files arrive as (path, text). Formats with line structure are read by regular expressions, JSON ones with explicit
schemas, all inside Spark. Unknown files give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("path").rlike(f"(^|/){pattern}$"))


def _matches(files: DataFrame, pattern: str, ecosystem: str, regex: str) -> DataFrame:
    """Rows of a two-group regular expression (name, version) over whole files."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(regex), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(regex), F.lit(2)).alias("version"))
    rows = _named(files, pattern).select("path", F.explode(pairs).alias("p"))
    return rows.select(F.lit(ecosystem).alias("ecosystem"), "p.name", "p.version", F.col("path").alias("manifest"))


def _entries(files: DataFrame, pattern: str, ecosystem: str, schema: str, entries: Column, name: Column, version: Column) -> DataFrame:
    rows = _named(files, pattern).select("path", F.from_json("text", schema).alias("j")).select("path", F.explode(entries).alias("key", "value"))
    return rows.select(F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), F.col("path").alias("manifest"))


def inventory(files: DataFrame) -> DataFrame:
    """All packages of all manifests, distinct; rows without name or version are left out."""
    value, key = F.col("value"), F.col("key")
    package = "struct<version:string>"
    parts = [
        _matches(files, r"[^/]*requirements[^/]*\.txt", "PyPI", r"(?m)^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)"),
        _entries(files, r"package-lock\.json", "npm", f"packages map<string,{package}>", F.col("j.packages"), F.regexp_replace(key, "^.*node_modules/", ""), value["version"]),
        _matches(files, r"yarn\.lock", "npm", r'(?m)^"?((?:@[^@/\n]+/)?[^@"\n]+)@[^\n]*:\n\s+version:?\s+"?([^"\n]+)"?'),
        _entries(files, r"Pipfile\.lock", "PyPI", f"`default` map<string,{package}>", F.col("j.default"), key, F.regexp_replace(value["version"], "^==", "")),
        _matches(files, r"Gemfile\.lock", "RubyGems", r"(?m)^    ([A-Za-z0-9_.-]+) \(([0-9][^)\s]*)\)"),
        _named(files, r"composer\.lock")
        .select("path", F.explode(F.from_json("text", "packages array<struct<name:string,version:string>>")["packages"]).alias("p"))
        .select(F.lit("Packagist").alias("ecosystem"), "p.name", F.regexp_replace("p.version", "^v", "").alias("version"), F.col("path").alias("manifest")),
        _matches(files, r"go\.sum", "Go", r"(?m)^(\S+) v([0-9][^\s/]*) h1:"),
        _matches(files, r"Cargo\.lock", "crates.io", r'\[\[package\]\]\s+name = "([^"]+)"\s+version = "([^"]+)"'),
        _matches(files, r"(?:uv|poetry|pdm)\.lock", "PyPI", r'\[\[package\]\]\s+name = "([^"]+)"\s+version = "([^"]+)"'),
        _matches(files, r"pnpm-lock\.yaml", "npm", r"(?m)^  '?/?((?:@[^@/\s']+/)?[^@/\s']+)@([0-9][^():\s']*)(?:\([^\n]*\))?'?:\s*$"),
        _matches(files, r"gradle\.lockfile", "Maven", r"(?m)^([\w.-]+:[\w.-]+):([^=\s]+)="),
        _matches(files, r"libs\.versions\.toml", "Maven", r'module = "([^":]+:[^":]+)"[^\n]*version = "([^"]+)"'),
        _referenced(files),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where("name <> '' and version <> ''").distinct()


def _referenced(files: DataFrame) -> DataFrame:
    """Entries of Gradle catalogues whose version is a reference to the ``[versions]`` table of the same file."""
    own = _named(files, r"libs\.versions\.toml").select("path", "text")
    pairs = lambda regex: F.arrays_zip(F.regexp_extract_all("text", F.lit(regex), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(regex), F.lit(2)).alias("value"))
    numbers = own.select("path", F.explode(pairs(r'(?m)^([\w-]+)\s*=\s*"([^"]+)"\s*$')).alias("p")).select("path", F.col("p.name").alias("ref"), F.col("p.value").alias("version"))
    uses = own.select("path", F.explode(pairs(r'module = "([^":]+:[^":]+)"[^\n]*version[.]ref = "([^"]+)"')).alias("p")).select("path", F.col("p.name").alias("name"), F.col("p.value").alias("ref"))
    return uses.join(numbers, ["path", "ref"]).select(F.lit("Maven").alias("ecosystem"), "name", "version", F.col("path").alias("manifest"))


DEPENDENCY = "struct<groupId:string,artifactId:string,version:string,exclusions:struct<exclusion:array<struct<groupId:string,artifactId:string>>>>"
POM = f"""groupId string, artifactId string, version string, parent struct<groupId:string,artifactId:string,version:string>,
dependencyManagement struct<dependencies:struct<dependency:array<{DEPENDENCY}>>>, dependencies struct<dependency:array<{DEPENDENCY}>>"""


def _xml(files: DataFrame) -> DataFrame:
    """Maven files as (path, project, properties): their XML read by Spark, the properties as a map."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)<!--.*?-->", ""), r"<project\b[^>]*>", "<project>")
    fields = F.regexp_extract(plain, r"(?s)<properties>(.*?)</properties>", 1)
    keys, values = (F.regexp_extract_all(fields, F.lit(r"<([\w.-]+)>\s*([^<]*?)\s*</"), F.lit(i)) for i in (1, 2))
    pairs = F.map_from_entries(F.arrays_zip(keys.alias("k"), values.alias("v")))
    body = F.regexp_extract(plain, r"(?s)(<project>.*</project>)", 1)
    return _named(files, r"pom\.xml").select("path", F.from_xml(body, POM).alias("project"), pairs.alias("properties"))


def poms(files: DataFrame) -> DataFrame:
    """Dependencies of Maven files: (name, version, managed, exclusions, parent, parent_version, manifest).

    Tags may come in any order. ``${property}`` versions are filled in, ``${project.version}`` too; one that can't be
    is the empty version, as is one that is left to the parent. Dependencies are those of the project itself, not of
    profiles or plugins.
    """
    told = _xml(files)
    own = F.coalesce("project.version", "project.parent.version")
    known = F.map_concat(F.col("properties"), F.create_map(F.lit("project.version"), own))
    place = [F.concat_ws(":", "project.parent.groupId", "project.parent.artifactId").alias("parent"), F.col("project.parent.version").alias("parent_version")]
    none = F.array().cast(f"array<{DEPENDENCY}>")
    listed = lambda at, managed: F.transform(F.coalesce(at, none), lambda d: F.struct(d.alias("d"), F.lit(managed).alias("managed"), *place))
    both = told.select("path", known.alias("known"), listed("project.dependencies.dependency", False).alias("plain"), listed("project.dependencyManagement.dependencies.dependency", True).alias("fixed"))
    # Exploded from columns of their own, or each dependency would hold the whole project. A filter on a column, or the
    # one that Spark infers from the explosion of a bare one, would be pushed below and read each file again: so the
    # parent comes out of the array too, and what is exploded is an expression.
    rows = both.select("path", "known", F.explode(F.concat("plain", "fixed")).alias("e")).select("path", "known", "e.*")
    ref = F.regexp_extract(F.coalesce("d.version", F.lit("")), r"^\$\{([^}]+)\}$", 1)
    version = F.when(ref != "", F.coalesce(F.try_element_at("known", ref), F.lit(""))).otherwise(F.coalesce(F.trim("d.version"), F.lit("")))
    left_out = F.transform(F.coalesce("d.exclusions.exclusion", F.array().cast("array<struct<groupId:string,artifactId:string>>")), lambda e: F.concat_ws(":", e["groupId"], e["artifactId"]))
    return rows.select(F.concat_ws(":", F.trim("d.groupId"), F.trim("d.artifactId")).alias("name"), version.alias("version"), "managed", left_out.alias("exclusions"), F.nullif("parent", F.lit("")).alias("parent"), "parent_version", F.col("path").alias("manifest"))


def managed_versions(deps: DataFrame, managed: DataFrame) -> DataFrame:
    """Dependencies (name, version, ...) with a managed version (name, version) replacing their own."""
    other = managed.select("name", F.col("version").alias("__managed"))
    return deps.join(other, "name", "left").withColumn("version", F.coalesce("__managed", "version")).drop("__managed")


def missing_installs(declared: DataFrame, installed: DataFrame) -> DataFrame:
    """Declared names that nothing installs."""
    return declared.select("name").distinct().join(installed.select("name"), "name", "left_anti")


def licence_metadata(files: DataFrame) -> DataFrame:
    """Installed packages with the licence their metadata states: (ecosystem, name, version, licence).

    Files (path, text) of dist-info folders, ``node_modules``, the Cargo registry and the Maven repository; only what
    lies on disk. A stated expression comes before a licence text, that before a classifier; ``UNKNOWN`` and blank are
    null. The name and version of a Maven file come from its place.
    """
    path, text = F.col("path"), F.col("text")
    field = lambda name: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{name}:[ ]*(.*)$", 1)), F.lit(""))
    known = lambda c: F.when(~F.upper(c).isin("UNKNOWN", ""), c)
    dist = files.where(path.rlike(r"\.dist-info/METADATA$")).select(
        F.lit("python").alias("ecosystem"), field("Name").alias("name"), field("Version").alias("version"), F.coalesce(known(field("License-Expression")), known(field("License")), known(F.trim(F.regexp_extract(text, r"(?m)^Classifier: License :: (?:OSI Approved :: )?(.*)$", 1)))).alias("licence")
    )
    node = files.where(path.rlike(r"(^|/)node_modules/((@[^/]+/)?[^/]+)/package\.json$")).select(F.from_json(text, "name string, version string, license string").alias("j"))
    node = node.select(F.lit("npm").alias("ecosystem"), "j.name", "j.version", known(F.col("j.license")).alias("licence"))
    entry = lambda name: F.nullif(F.regexp_extract(text, rf'(?m)^{name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    place = r"(^|/)registry/src/[^/]+/(.+)-([0-9][^/]*)/Cargo\.toml$"
    cargo = files.where(path.rlike(place)).select(F.lit("cargo").alias("ecosystem"), F.regexp_extract(path, place, 2).alias("name"), F.regexp_extract(path, place, 3).alias("version"), known(entry("license")).alias("licence"))
    place = r"(^|/)repository/(.+)/([^/]+)/([^/]+)/[^/]+\.pom$"
    maven = files.where(path.rlike(place)).select(
        F.lit("maven").alias("ecosystem"), F.concat_ws(":", F.replace(F.regexp_extract(path, place, 2), F.lit("/"), F.lit(".")), F.regexp_extract(path, place, 3)).alias("name"), F.regexp_extract(path, place, 4).alias("version"),
        known(F.trim(F.regexp_extract(text, r"(?s)<license>.*?<name>([^<]*)</name>", 1))).alias("licence"),
    )
    return reduce(DataFrame.unionByName, [dist, node, cargo, maven])


LOOKUP_BATCH = 1000


def lookup(keys: DataFrame, answers: DataFrame, fetch=None, batch: int = LOOKUP_BATCH) -> DataFrame:
    """Keys (key) with their answers (key, answer): known ones from the table, the rest from ``fetch`` in batches.

    A resolved key never changes, so ``answers`` is the cache; without ``fetch`` unknown keys have a null answer, which
    is no error. ``fetch`` takes a list of at most ``batch`` keys in a task and returns as many texts or None.
    """
    known = answers.select("key", "answer")
    wanted = keys.select("key").distinct()
    if fetch is None:
        return wanted.join(known, "key", "left")
    kind = wanted.schema["key"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for frame in frames:
            asked = frame["key"].tolist()
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                yield pd.DataFrame({"key": part, "answer": list(fetch(part))})

    rest = wanted.join(known, "key", "left_anti").mapInPandas(run, f"key {kind}, answer string")
    return wanted.join(known, "key").unionByName(rest)
