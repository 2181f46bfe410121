"""Operators over packages, taint flows, declarations, documents, seats and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.code import compatible
from siltstone.functions.severity import label, rank
from siltstone.functions.versions import version_key
from siltstone.scratch import Gathered, cut, drop


def resolve_packages(wanted: DataFrame, requires: DataFrame, managed: DataFrame, excluded: DataFrame, rounds: int = 100) -> DataFrame:
    """Transitive packages (root, name, version, depth) of ``wanted`` (name, version).

    ``requires`` (name, version, dep, dep_version) are the edges; a managed version (name, version) replaces a
    transitive one; an excluded name (root, name) drops its subtree; packages without edges are no error. The least
    depth wins, then the larger version. Raises if packages still turn up after ``rounds`` rounds.
    """
    fix = managed.select(F.col("name").alias("dep"), F.col("version").alias("fixed"))
    front = cut(wanted.select(F.col("name").alias("root"), "name", "version", F.lit(0).alias("depth")).distinct())
    seen, requires, fix = Gathered(front), cut(requires), cut(fix)
    for depth in range(1, rounds + 1):
        step = front.select("root", "name", "version").join(requires, ["name", "version"]).join(fix, "dep", "left")
        found = step.select("root", F.col("dep").alias("name"), F.coalesce("fixed", "dep_version").alias("version"), F.lit(depth).alias("depth")).distinct()
        front = cut(found.join(excluded, ["root", "name"], "left_anti").join(seen.all(), ["root", "name", "version"], "left_anti"))
        if front.isEmpty():
            break
        seen.add(front)
    else:
        raise RuntimeError(f"packages did not settle in {rounds} rounds")
    first = Window.partitionBy("root", "name").orderBy("depth", F.desc(version_key(F.col("version"))), F.desc("version"))
    return seen.all().withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def known_advisories(packages: DataFrame, affected: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding for each vulnerable (name, version, manifest): ids, worst severity, the version that fixes all.

    ``affected(id, name, introduced, fixed)`` are half-open ranges (null ``introduced``: from the first version, null
    ``fixed``: no fix yet); ``advisories(id, score)``. Packages meet ranges by name, the range is tested on the pairs.
    """
    own = version_key(F.col("version"))
    inside = (F.col("introduced").isNull() | (version_key(F.col("introduced")) <= own)) & (F.col("fixed").isNull() | (own < version_key(F.col("fixed"))))
    hits = packages.join(affected, "name").where(inside).join(advisories, "id")
    severity = F.max_by(label(F.col("score")), rank(label(F.col("score"))))
    fix = F.when(F.bool_and(F.col("fixed").isNotNull()), F.max_by("fixed", version_key(F.col("fixed"))))
    return hits.groupBy("name", "version", "manifest").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"), severity.alias("severity"), fix.alias("fix"))


def taint_paths(sources: DataFrame, flow: DataFrame, sinks: DataFrame, hops: int = 2, rounds: int = 200) -> DataFrame:
    """(source, sink, kind, calls): sinks that unclean data reaches.

    ``sources(var)``, ``flow(src, dst, kind)`` with kinds ``assign``, ``call`` and ``clean``, ``sinks(var, kind)``.
    Clean edges stop data, at most ``hops`` call edges lie on a path; the fewest calls are reported. A variable that is
    reached again with no fewer calls is not followed again. Raises if data still moves after ``rounds`` rounds.
    """
    edges = cut(flow.where("kind <> 'clean'").select("src", "dst", (F.col("kind") == "call").cast("int").alias("call")).distinct())
    best = front = cut(sources.select(F.col("var").alias("source"), F.col("var").alias("at"), F.lit(0).alias("calls")).distinct())
    for _ in range(rounds):
        step = front.join(edges, front.at == edges.src).select("source", F.col("dst").alias("at"), (F.col("calls") + F.col("call")).alias("calls")).where(F.col("calls") <= hops)
        least = step.groupBy("source", "at").agg(F.min("calls").alias("calls"))
        known = best.select("source", "at", F.col("calls").alias("known"))
        front = cut(least.join(known, ["source", "at"], "left").where("known is null or calls < known").select("source", "at", "calls"))
        if front.isEmpty():
            break
        new = cut(best.unionByName(front).groupBy("source", "at").agg(F.min("calls").alias("calls")))
        if best is not front:
            drop(best)
        best = new
    else:
        raise RuntimeError(f"data still moves after {rounds} rounds")
    return best.join(sinks, best.at == sinks.var).groupBy("source", F.col("var").alias("sink"), "kind").agg(F.min("calls").alias("calls"))


MOST_DECLARED = 500


def implied_files(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path) with their isolation: the declaration (name, pattern, depth) that matches deepest.

    Patterns are regular expressions. Up to ``MOST_DECLARED`` declarations (counted) are tested as one expression over
    the files, which don't move; more raise, as folders are then the way to declare them (see ``isolations``).
    """
    rows = declared.orderBy(F.desc("depth"), F.desc("name")).limit(MOST_DECLARED + 1).collect()
    if len(rows) > MOST_DECLARED:
        raise ValueError(f"more than {MOST_DECLARED} patterns: declare folders instead")
    if not rows:
        return files.select("path", F.lit(None).cast("string").alias("name")).where("false")
    name = F.coalesce(*(F.when(F.col("path").rlike(r["pattern"]), r["name"]) for r in rows))
    return files.select("path").distinct().withColumn("name", name).where("name is not null")


def name_resolution(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (id, file, name, imported) with the definition (def_id, file, name) they mean.

    The same file comes first, then the imported file; a name that fits neither stays out, nothing is guessed.
    """
    own = calls.join(definitions.select("def_id", "file", "name"), ["file", "name"]).select("id", "def_id", F.lit(1).alias("rank"))
    other = definitions.select("def_id", F.col("file").alias("imported"), "name")
    via = calls.join(other, ["imported", "name"]).select("id", "def_id", F.lit(2).alias("rank"))
    best = own.unionByName(via).groupBy("id").agg(F.min(F.struct("rank", "def_id")).alias("m"))
    return best.select("id", F.col("m.def_id").alias("def_id"))


def dangling(documents: DataFrame) -> DataFrame:
    """References (path, covers) of documents to ids that no document has, and repeated ids, as (path, id, problem)."""
    ids = documents.where("id is not null").select("id")
    covers = documents.select("path", F.explode("covers").alias("id")).join(ids.distinct(), "id", "left_anti").select("path", "id", F.lit("no such id").alias("problem"))
    order = Window.partitionBy("id").orderBy("path")
    again = documents.where("id is not null").withColumn("n", F.row_number().over(order)).where("n > 1").select("path", "id", F.lit("id defined before").alias("problem"))
    return covers.unionByName(again)


def broken_links(documents: DataFrame) -> DataFrame:
    """(path, target, problem): relative links of Markdown bodies (path, body) to files that are not there, and
    documents that the index of their own folder (``INDEX.md``) doesn't name."""
    here = F.regexp_replace("path", "/?[^/]*$", "")
    targets = F.transform(F.regexp_extract_all("body", F.lit(r"\]\(([^)#\s]+)"), F.lit(1)), lambda t: F.regexp_replace(t, r"^\./", ""))
    links = documents.select("path", here.alias("folder"), F.explode(F.array_distinct(targets)).alias("target")).where(~F.col("target").rlike("^[a-z]+:"))
    links = links.withColumn("file", F.when(F.col("folder") == "", F.col("target")).otherwise(F.concat_ws("/", "folder", "target")))
    gone = links.join(documents.select(F.col("path").alias("file")), "file", "left_anti").select("path", "target", F.lit("no such file").alias("problem"))
    indexed = links.where(F.col("path").rlike("(^|/)INDEX[.]md$")).select(F.col("file").alias("path"))
    folders = documents.where(F.col("path").rlike("(^|/)INDEX[.]md$")).select(here.alias("folder"))
    own = documents.where(~F.col("path").rlike("(^|/)INDEX[.]md$")).select("path", here.alias("folder")).join(folders, "folder", "left_semi")
    return gone.unionByName(own.join(indexed, "path", "left_anti").select("path", F.col("path").alias("target"), F.lit("not in the index").alias("problem")))


def status_drift(documents: DataFrame, markers: DataFrame) -> DataFrame:
    """(id, status, problem): documents (id, status) whose status claims what no marker (id, kind) shows.

    ``implemented`` asks for a marker of kind ``code``, ``automated`` for one of kind ``test``.
    """
    claims = documents.where(F.col("status").isin("implemented", "automated")).withColumn("kind", F.when(F.col("status") == "implemented", "code").otherwise("test"))
    open_ones = claims.join(markers.select("id", "kind").distinct(), ["id", "kind"], "left_anti")
    return open_ones.select("id", "status", F.concat(F.lit("no "), F.col("kind"), F.lit(" marker")).alias("problem"))


def contract_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change): names of ``old`` (name, signature, lang) that ``new`` (name, signature) removes or breaks.

    Whether callers still fit is decided by ``functions.code.compatible``; without ``lang`` Python's rules hold.
    """
    lang = F.col("lang") if "lang" in old.columns else F.lit("python")
    both = old.select("name", F.col("signature").alias("a"), lang.alias("lang")).join(new.select("name", F.col("signature").alias("b")), "name", "left")
    change = F.when(F.col("b").isNull(), "removed").when((F.col("a") != F.col("b")) & ~compatible(F.col("a"), F.col("b"), F.col("lang")), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def policy_run(steps: DataFrame, defaults: DataFrame, config: DataFrame) -> DataFrame:
    """(task, pos, step, level, verdict, closes) in order: each step's verdict and whether the task may close.

    ``steps(task, pos, step, exit)``: a null exit is a step without a command, which is skipped. Levels (step, level:
    ``required`` or ``advised``) come from the configuration, else the layer's default, else ``advised``.
    """
    levels = defaults.select("step", F.col("level").alias("layer")).join(config.select("step", F.col("level").alias("own")), "step", "full")
    told = steps.join(levels, "step", "left").withColumn("level", F.coalesce("own", "layer", F.lit("advised")))
    verdict = F.when(F.col("exit").isNull(), "skip").when(F.col("exit") == 0, "pass").otherwise("FAIL")
    told = told.withColumn("verdict", verdict)
    closes = told.groupBy("task").agg((~F.bool_or((F.col("level") == "required") & (F.col("verdict") == "FAIL"))).alias("closes"))
    return told.join(closes, "task").select("task", "pos", "step", "level", "verdict", "closes")


def seat_takeover(seats: DataFrame, here: Column, now: Column, force: bool = False) -> DataFrame:
    """(seat, state, takeover): state of seats (seat, host, alive, heartbeat, lease) in minutes, and whether one may be
    taken: a dead seat of this host at once, an expired one of another host only with ``force``."""
    age = now - F.col("heartbeat")
    local = F.col("host") == here
    state = F.when(F.col("heartbeat").isNull(), "free").when(local & ~F.col("alive"), "dead").when(age > F.col("lease"), "expired").otherwise("live")
    takeover = (state == "free") | (state == "dead") | ((state == "expired") & (local | F.lit(force)))
    return seats.select("seat", state.alias("state"), takeover.alias("takeover"))


def scope_overlaps(scopes: DataFrame) -> DataFrame:
    """(a, b): tasks (id, path) with folders or files in common: equal, or one above the other.

    A scope is a path prefix; ``/**`` at its end is the same. Each path meets the paths above it by an equi-join on the
    exploded prefixes, so tasks are never held against all others.
    """
    path = F.regexp_replace("path", r"/+(\*\*)?$", "")
    own = scopes.select("id", path.alias("path")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = own.select(F.col("id").alias("x"), F.explode(above).alias("path"))
    pairs = up.join(own.select(F.col("id").alias("y"), "path"), "path").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def task_board(tasks: DataFrame, seats: DataFrame) -> DataFrame:
    """(id, state, owner, seat_state, overlaps): tasks (id, path, owner, scope) by the folder they lie in.

    ``overlaps`` counts the other tasks that are going on and share a part of the scope (path prefixes).
    """
    state = F.regexp_extract("path", r"(pending/ideas|pending/next|going-on|completed)/", 1)
    told = tasks.withColumn("state", state)
    active = told.where("state = 'going-on'").select("id", F.explode("scope").alias("path"))
    pairs = scope_overlaps(active)
    both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("overlaps"))
    known = seats.select(F.col("seat").alias("owner"), F.col("state").alias("seat_state"))
    return told.join(known, "owner", "left").join(both, "id", "left").select("id", "state", "owner", "seat_state", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def orphans(specs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Specs (id, req) whose requirement is not there."""
    return specs.join(requirements.select(F.col("id").alias("req")), "req", "left_anti").select("id", "req")


def first_non_null(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """The next group of a match that is not null or empty."""
    return df.withColumn(out, F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns)))


def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """A map column with the keys of an allow list renamed and all others, and empty values, dropped."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    kept = F.map_filter(column, lambda k, v: k.isin(*names) & v.isNotNull() & (F.length(v) > 0))
    return df.withColumn(column, F.transform_keys(kept, lambda k, v: F.element_at(table, k)))


def tagged(findings: DataFrame, tracked: DataFrame, accepted: DataFrame, strict: bool = False) -> DataFrame:
    """Findings (path, line, ...) with ``tag`` and ``live``.

    Tags, first that fits: ``[accepted: reason]`` from ``accepted(path, line, reason)``, ``[untracked, git-ignored]``
    for files that are not in ``tracked(path)``, ``[test]``, ``[docs]``. A finding without tag is live; ``strict``
    makes those of tests and untracked files live too.
    """
    known = findings.join(tracked.select("path").distinct().withColumn("__t", F.lit(True)), "path", "left").join(accepted.select("path", "line", "reason"), ["path", "line"], "left")
    tag = (
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("[accepted: "), F.col("reason"), F.lit("]")))
        .when(F.col("__t").isNull(), "[untracked, git-ignored]")
        .when(F.col("path").rlike("(^|/)tests?/"), "[test]")
        .when(F.col("path").rlike("(^|/)docs/"), "[docs]")
        .otherwise("")
    )
    told = known.withColumn("tag", tag).drop("__t", "reason")
    live = (F.col("tag") == "") | (F.lit(strict) & F.col("tag").isin("[test]", "[untracked, git-ignored]"))
    return told.withColumn("live", live)


def layered(files: DataFrame, order: list[str]) -> DataFrame:
    """(path, layer, content): of files (layer, path, content) the first layer of ``order`` wins; an empty file whose
    content is ``DISABLED`` removes the path from all layers below it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    best = files.where(place > 0).groupBy("path").agg(F.min_by(F.struct("layer", "content"), place).alias("w"))
    return best.where("trim(w.content) <> 'DISABLED'").select("path", "w.layer", "w.content")
