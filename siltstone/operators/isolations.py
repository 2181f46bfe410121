"""Isolations of a source tree: parts of it with declared frontiers, judged against the edges between files.

Relations: ``parts(name, path)`` (folders; dotted names, a part's name extends its parent's), ``frontiers(name, folder,
status)`` (``.`` is the part's top level), ``edges(src, dst)`` between file paths. Files meet parts by an equi-join on
the folders above them, so nothing is matched file by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folders_above(path: Column) -> Column:
    """The folders that hold a path, from the top, without the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def holders(files: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, name, inner): every part that holds a file, with the file's folder below the part's ("" at its top)."""
    up = files.select("path").distinct().withColumn("folder", F.explode(folders_above(F.col("path"))))
    found = up.join(parts.select("name", F.col("path").alias("folder")), "folder")
    below = F.substring(F.col("path"), F.length("folder") + 2, F.length("path"))
    return found.select("path", "name", F.regexp_replace(below, "/?[^/]*$", "").alias("inner"))


def owners(files: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, name, error): the deepest part that holds each file; ``error`` where two unrelated parts hold it.

    Parts are related if one's name extends the other's. Files outside all parts are left out.
    """
    held = holders(files, parts).join(parts.select("name", F.col("path").alias("root")), "name")
    deepest = F.max_by(F.col("name"), F.struct(F.length("root"), F.length("name"), F.col("name")))
    names = F.collect_set("name")
    strange = F.exists("names", lambda a: F.exists("names", lambda b: (a < b) & ~F.startswith(b, F.concat(a, F.lit("."))) & ~F.startswith(a, F.concat(b, F.lit(".")))))
    return held.groupBy("path").agg(deepest.alias("name"), names.alias("names")).select("path", "name", strange.alias("error"))


def entering(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst, name, inner): each edge with every part that it enters (holds ``dst`` and not ``src``)."""
    held = holders(edges.select(F.col("dst").alias("path")).unionByName(edges.select(F.col("src").alias("path"))), parts)
    into = edges.select("src", "dst").distinct().join(held.select(F.col("path").alias("dst"), "name", "inner"), "dst")
    return into.join(held.select(F.col("path").alias("src"), "name"), ["src", "name"], "left_anti").select("src", "dst", "name", "inner")


def _open_folders(frontiers: DataFrame) -> DataFrame:
    """(name, folders): what the accepted frontiers of a part open: each of them and the folders on the way down."""
    down = F.transform(F.sequence(F.lit(0), F.size(F.split("folder", "/"))), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"))
    opened = F.when(F.col("folder") == ".", F.array(F.lit(""))).otherwise(down)
    return frontiers.where("status = 'accepted'").groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list(opened))).alias("folders"))


def violations(edges: DataFrame, parts: DataFrame, frontiers: DataFrame) -> DataFrame:
    """(src, dst, names): edges that go deeper into a part than its accepted frontiers, for any part they enter.

    A part without an accepted frontier limits nothing; proposed and rejected ones are not in force.
    """
    deep = entering(edges, parts).join(_open_folders(frontiers), "name").where(~F.array_contains("folders", F.col("inner")))
    return deep.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


def proposal(edges: DataFrame, parts: DataFrame, tests: Column) -> DataFrame:
    """(name, folder, imports): ``.`` for every part, and the deepest folders that code outside it reaches.

    ``imports`` are the edges that end right there; edges from tests (a condition on ``src``) are exempt. A folder on
    the way to a deeper one that is reached needs no frontier of its own.
    """
    reached = entering(edges.where(~tests), parts).groupBy("name", "inner").agg(F.count("*").alias("imports"))
    every = parts.select("name").distinct().withColumn("inner", F.lit("")).join(reached, ["name", "inner"], "left").select("name", F.lit(".").alias("folder"), F.coalesce("imports", F.lit(0)).alias("imports"))
    inner = reached.where("inner <> ''")
    way = inner.select("name", F.explode(folders_above(F.col("inner"))).alias("inner")).distinct()
    return every.unionByName(inner.join(way, ["name", "inner"], "left_anti").select("name", F.col("inner").alias("folder"), "imports"))


def unused(edges: DataFrame, parts: DataFrame, frontiers: DataFrame, tests: Column) -> DataFrame:
    """(name, folder): accepted frontiers below the top level that nothing outside the part reaches, tests aside."""
    reached = entering(edges.where(~tests), parts).where("inner <> ''")
    deep = F.concat(folders_above(F.col("inner")), F.array("inner"))
    used = reached.select("name", F.explode(deep).alias("folder")).distinct()
    return frontiers.where("status = 'accepted' and folder <> '.'").select("name", "folder").join(used, ["name", "folder"], "left_anti")


def context(files: DataFrame, parts: DataFrame, frontiers: DataFrame, name: str) -> DataFrame:
    """(path, reason): the files that an edit in part ``name`` may read.

    ``own``: the part's files; ``visible``: files that accepted frontiers of other parts open; ``open``: files that
    only parts without accepted frontiers hold, or none. Parts around ``name`` are no border for it.
    """
    held = holders(files, parts)
    own = held.where(F.col("name") == name).select("path")
    foreign = held.where(~(F.lit(name) == F.col("name")) & ~F.startswith(F.lit(name), F.concat("name", F.lit("."))))
    limited = foreign.join(_open_folders(frontiers), "name").groupBy("path").agg(F.bool_and(F.array_contains("folders", F.col("inner"))).alias("seen"))
    rest = files.select("path").distinct().join(own.withColumn("own", F.lit(True)), "path", "left").join(limited, "path", "left")
    reason = F.when(F.col("own"), "own").when(F.col("seen").isNull(), "open").when(F.col("seen"), "visible")
    return rest.select("path", reason.alias("reason")).where("reason is not null")


def fingerprints(parts: DataFrame, frontiers: DataFrame, decisions: DataFrame) -> DataFrame:
    """(name, fingerprint, state): the hash of each part's rules and whether an accepted decision carries it.

    The hash covers path and decided frontiers in canonical order, so comments and order change nothing.
    ``decisions(fingerprint, status)``; states are ``accepted``, ``proposed`` and ``no decision``.
    """
    lines = F.transform(F.sort_array(F.collect_list(F.struct("folder", "status"))), lambda f: F.concat_ws("=", f["folder"], f["status"]))
    rules = parts.join(frontiers.where("status <> 'proposed'"), "name", "left").groupBy("name", "path").agg(lines.alias("lines"))
    hashed = rules.groupBy("name").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(";", "path", F.array_join(F.filter("lines", lambda x: x != ""), ",")))), "|"), 256).alias("fingerprint"))
    known = decisions.groupBy("fingerprint").agg(F.bool_or(F.col("status") == "accepted").alias("accepted"))
    state = F.when(F.col("accepted"), "accepted").when(F.col("accepted").isNotNull(), "proposed").otherwise("no decision")
    return hashed.join(known, "fingerprint", "left").select("name", "fingerprint", state.alias("state"))


def data_outside(tokens: DataFrame, held: DataFrame, fields: DataFrame) -> DataFrame:
    """(file, line, field): uses of a declared field (field, stays_in) in files outside the parts it stays in.

    ``tokens(file, line, name, comment)``: a comment never counts. ``held(path, name)`` as ``holders`` gives it.
    """
    uses = tokens.where(~F.col("comment")).join(fields.withColumnRenamed("field", "name"), "name").select("file", "line", F.col("name").alias("field"), "stays_in")
    inside = held.select(F.col("path").alias("file"), F.col("name").alias("stays_in"))
    allowed = uses.join(inside, ["file", "stays_in"], "left_semi").select("file", "line", "field")
    return uses.select("file", "line", "field").distinct().join(allowed, ["file", "line", "field"], "left_anti")


def data_sinks(sinks: DataFrame, assigns: DataFrame, fields: DataFrame) -> DataFrame:
    """(file, line, field): logger and print arguments that are a field, or a local of the same function set from one.

    ``sinks(file, fn, line, arg)``, ``assigns(file, fn, line, local, value)``. A local counts from the last
    assignment above the use; one of another function never counts.
    """
    names = fields.select("field").distinct()
    direct = sinks.join(names, F.col("arg") == F.col("field")).select("file", "line", "field")
    defs = assigns.select("file", "fn", F.col("line").alias("def_line"), F.col("local").alias("arg"), "value")
    through = sinks.join(defs, ["file", "fn", "arg"]).where("def_line < line")
    last = through.groupBy("file", "fn", "line", "arg").agg(F.max_by("value", "def_line").alias("value"))
    return direct.unionByName(last.join(names, F.col("value") == F.col("field")).select("file", "line", "field")).distinct()
