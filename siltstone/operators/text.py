"""Operators over source text: lines, line rules, clones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import cut


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Numbered lines from 1: id, line, text."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "text")).select("id", (F.col("pos") + 1).cast("long").alias("line"), "text")


def rule_findings(table: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One finding for each line and matching rule (name, keyword, regex).

    The keyword is tested first, as a plain substring, so that the regular expression runs on few lines. All rules
    are evaluated in one pass over the lines.
    """
    hits = [F.when(F.contains(F.lower("text"), F.lit(key.lower())) & F.col("text").rlike(pattern), F.lit(name)) for name, key, pattern in rules]
    return table.withColumn("rule", F.explode(F.array_compact(F.array(*hits))))


def clone_groups(docs: DataFrame, id_col: str, text_col: str, min_lines: int = 6, tests: Column | None = None) -> DataFrame:
    """Groups of two and more rows with one normal form (lower case, white space collapsed): hash, n, first id, gated.

    Rows of fewer than ``min_lines`` lines are no clones; a group whose rows are all ``tests`` is listed, not gated.
    """
    normal = F.trim(F.regexp_replace(F.lower(text_col), r"\s+", " "))
    rows = docs.where(F.size(F.split(text_col, "\n")) >= min_lines).select(F.col(id_col).alias("id"), F.md5(normal).alias("hash"), (F.lit(False) if tests is None else tests).alias("test"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), (~F.bool_and("test")).alias("gated")).where("n > 1")


def winnowed(docs: DataFrame, id_col: str, text_col: str, k: int = 5, window: int = 4) -> DataFrame:
    """(id, print): the least ``k``-word hash of every ``window`` consecutive ones, distinct per row."""
    words = F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.substring(F.md5(F.array_join(F.slice("w", i + 1, k), " ")), 1, 15))
    least = F.transform(F.sequence(F.lit(0), F.greatest(F.size("g") - window, F.lit(0))), lambda i: F.array_min(F.slice("g", i + 1, window)))
    split = docs.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") >= k).select("id", grams.alias("g"))
    return split.select("id", F.explode(F.array_distinct(least)).alias("print"))


def near_clones(docs: DataFrame, id_col: str, text_col: str, percent: int = 60, k: int = 5, window: int = 4) -> DataFrame:
    """Pairs (a, b, shared, similarity) of rows that share fingerprints: shared over the smaller set, in percent.

    Rows with equal text are one group (see ``clone_groups``) of which the least id is compared; rows with equal
    fingerprint sets are one class, and classes are compared. The smaller class of a pair must share a known part of
    its prints, so one of its rarest is among them: of the prints that other sets have, all but ``need - 1`` are looked up
    among the prints of larger classes, the rarest first. Frequent prints are looked up only where a set has no rarer
    ones; no pair is lost.
    """
    # dealt by a set number: partitions that adaptive execution joins by size would make few tasks of much hashing
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(text_col).alias("h")).repartition(parts, "h")
    firsts = dealt.groupBy("h").agg(F.min_by(F.struct("id", "text"), "id").alias("r")).select("r.*")
    prints = winnowed(firsts, "id", "text", k, window)
    sets = prints.groupBy("id").agg(F.sort_array(F.collect_list("print")).alias("prints"))
    members = cut(sets.select("id", F.sha2(F.array_join("prints", ","), 256).alias("class"), "prints"))
    classes = members.groupBy("class").agg(F.any_value("prints").alias("prints"), F.count("*").alias("rows")).withColumn("n", F.size("prints").cast("long"))
    each = classes.select("class", "n", F.explode("prints").alias("print"), "rows")
    spread = each.groupBy("print").agg(F.count("*").alias("sets"), F.sum("rows").alias("of")).where("of > 1")
    held = cut(each.join(spread, "print").select("class", "n", "print", "sets", "rows"))
    need = F.ceil(F.lit((percent - 0.05) / 100) * F.col("n") - 1e-9)
    rare = F.slice(F.sort_array(F.collect_list(F.struct("sets", "print"))), 1, F.greatest(F.count("*") - F.first("need") + 1, F.lit(0)).cast("int"))
    first = held.withColumn("need", need).groupBy("class").agg(F.first("n").alias("n"), rare.alias("rare")).select(F.col("class").alias("x"), F.col("n").alias("nx"), F.explode("rare.print").alias("print"))
    other = held.select(F.col("class").alias("y"), F.col("n").alias("ny"), "print")
    pairs = first.join(other, "print").where("nx < ny or nx = ny and x <= y").select("x", "y", "nx").distinct()
    whole = lambda name, prints: classes.select(F.col("class").alias(name), F.col("prints").alias(prints), F.col("rows").alias(f"{name}_rows"))
    both = pairs.join(whole("x", "px"), "x").join(whole("y", "py"), "y").where("x <> y or x_rows > 1")
    alike = both.select("x", "y", "nx", F.size(F.array_intersect("px", "py")).cast("long").alias("shared")).withColumn("similarity", F.round(100.0 * F.col("shared") / F.col("nx"), 1)).where(F.col("similarity") >= percent)
    one, two = members.select(F.col("id").alias("i"), F.col("class").alias("x")), members.select(F.col("id").alias("j"), F.col("class").alias("y"))
    out = alike.join(one, "x").join(two, "y").where("x <> y or i < j")
    return out.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "shared", "similarity")


def ranked_clones(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Near clones by size x similarity, the largest first; ``sizes(id, lines)``, the smaller side counts."""
    a, b = (sizes.select(F.col("id").alias(x), F.col("lines").alias(f"lines_{x}")) for x in ("a", "b"))
    weight = F.least("lines_a", "lines_b") * F.col("similarity")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "similarity", F.least("lines_a", "lines_b").alias("lines"), F.round(weight, 1).alias("weight")).orderBy(F.desc("weight"), "a", "b")
