"""Joins on closeness: band, interval, nearest and as-of joins over (file, line) relations.

Band and interval joins get an equi-join key from cutting the line axis into cells, so that Spark plans a hash or
sort-merge join on (keys, cell) with the exact condition as a residual, never a nested loop.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.scratch import cut, drop


def _cell(line: Column, width: int) -> Column:
    return F.floor(line / F.lit(max(1, width))).cast("long")


def _near(left: DataFrame, right: DataFrame, keys: Sequence[str], line: str, width: int, how: str) -> DataFrame:
    """Left semi or anti join on equal keys and lines at most ``width`` apart."""
    other = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col(line).alias("__r_line")).distinct()
    other = other.withColumn("__r_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _cell(F.col("__r_line"), width) + d)))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__r_{k}"))
    near = same & (F.col("__l_cell") == F.col("__r_cell")) & (F.abs(F.col(line) - F.col("__r_line")) <= width)
    return left.withColumn("__l_cell", _cell(F.col(line), width)).join(other, near, how).drop("__l_cell")


def band_semi(left: DataFrame, right: DataFrame, keys: Sequence[str], line: str, width: int) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` in reach."""
    return _near(left, right, keys, line, width, "left_semi")


def band_anti(left: DataFrame, right: DataFrame, keys: Sequence[str], line: str, width: int) -> DataFrame:
    """Rows of ``left`` without one."""
    return _near(left, right, keys, line, width, "left_anti")


def greedy_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], line: str, width: int, left_id: str, right_id: str) -> DataFrame:
    """One-to-one pairs in order of ``left_id``: each takes the first free right row (by ``right_id``) in reach.

    Order decides the result, so each group is worked through in Python. The line axis is cut into cells of ``width``;
    no pair can cross an empty cell, so a run of cells without a gap is a group, and a long file falls into many. Only
    the distinct cells of a file are ordered, not its rows.
    """
    both = left.select(*keys, F.col(line).alias("line"), F.col(left_id).alias("id"), F.lit(0).alias("side")).unionByName(right.select(*keys, F.col(line).alias("line"), F.col(right_id).alias("id"), F.lit(1).alias("side")))
    both = both.withColumn("cell", _cell(F.col("line"), width + 1))
    order = Window.partitionBy(*keys).orderBy("cell")
    cells = both.select(*keys, "cell").distinct().withColumn("gap", F.coalesce(F.col("cell") - F.lag("cell").over(order) > 1, F.lit(False)))
    cells = cells.withColumn("part", F.sum(F.col("gap").cast("int")).over(order)).drop("gap")
    both = both.join(cells, [*keys, "cell"])

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = group[group.side == 0].sort_values("id"), group[group.side == 1].sort_values("id")
        free, rows = list(zip(theirs["id"], theirs["line"], strict=True)), []
        for own, at in zip(ours["id"], ours["line"], strict=True):
            taken = next((k for k, (_, there) in enumerate(free) if abs(there - at) <= width), None)
            if taken is not None:
                other, there = free.pop(taken)
                rows.append((own, other, abs(there - at)))
        return pd.DataFrame(rows, columns=["left_id", "right_id", "distance"])

    return both.groupBy(*keys, "part").applyInPandas(pair, "left_id long, right_id long, distance long")


def _intervals(points: DataFrame, spans: DataFrame, key: str, line: str, start: str, end: str, above: int, cell: int) -> DataFrame:
    """Points with every span (columns ``s_*``) whose interval, widened ``above`` lines up, holds them."""
    wide = spans.select(*(F.col(c).alias(f"s_{c}") for c in spans.columns))
    wide = wide.withColumn("__cell", F.explode(F.sequence(_cell(F.col(f"s_{start}") - above, cell), _cell(F.col(f"s_{end}"), cell))))
    at = points.withColumn("__at", _cell(F.col(line), cell))
    held = (F.col(key) == F.col(f"s_{key}")) & (F.col("__at") == F.col("__cell")) & (F.col(line) >= F.col(f"s_{start}") - above) & (F.col(line) <= F.col(f"s_{end}"))
    return at.join(wide, held).drop("__at", "__cell")


def innermost(points: DataFrame, spans: DataFrame, key: str, point_id: str, line: str, start: str, end: str, cell: int = 1024) -> DataFrame:
    """Each point with the latest-starting span around it (ties: the earlier end); points outside all spans go."""
    found = _intervals(points, spans, key, line, start, end, 0, cell)
    first = Window.partitionBy(point_id).orderBy(F.desc(f"s_{start}"), f"s_{end}")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def nearest_start(points: DataFrame, spans: DataFrame, key: str, point_id: str, line: str, start: str, end: str, above: int = 8, cell: int = 1024) -> DataFrame:
    """Each point with the span, widened ``above`` lines up, whose start is nearest (ties: the earlier start)."""
    found = _intervals(points, spans, key, line, start, end, above, cell).withColumn("distance", F.abs(F.col(line) - F.col(f"s_{start}")))
    first = Window.partitionBy(point_id).orderBy("distance", f"s_{start}", f"s_{end}")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def contained_pairs(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """One-to-one pairs (id, span_id): points (key, id, line, name), in order of id, each with a free span around it.

    A span (key, id, start, end, name) fits with an equal name or with none; among those that fit an equal name comes
    first, then the latest start, then the least id. Spans that overlap, and the points in them, are worked through
    together in Python, as order decides; groups are cut where a span starts after all earlier ones have ended.
    """
    marks = points.select(key, "id", F.col("line").alias("at"), F.lit(None).cast("long").alias("end"), "name", F.lit(1).alias("side"))
    whole = spans.select(key, "id", F.col("start").alias("at"), F.col("end").cast("long").alias("end"), "name", F.lit(0).alias("side")).unionByName(marks)
    order = Window.partitionBy(key).orderBy("at", "side", "id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.withColumn("fresh", (F.col("side") == 0) & (F.coalesce(before, F.col("at") - 1) < F.col("at")))
    whole = whole.withColumn("part", F.sum(F.col("fresh").cast("int")).over(order))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        free = [(i, a, e, n) for i, a, e, n, s in zip(group["id"], group["at"], group["end"], group["name"], group["side"], strict=True) if s == 0]
        rows = []
        for own, at, name in sorted((i, a, n) for i, a, n, s in zip(group["id"], group["at"], group["name"], group["side"], strict=True) if s == 1):
            fit = [f for f in free if f[1] <= at <= f[2] and (f[3] is None or f[3] == name)]
            if fit:
                taken = max(fit, key=lambda f: (f[3] is not None, f[1], -f[0]))
                free.remove(taken)
                rows.append((own, taken[0]))
        return pd.DataFrame(rows, columns=["id", "span_id"])

    return whole.groupBy(key, "part").applyInPandas(pair, "id long, span_id long")


def asof_at_or_above(points: DataFrame, marks: DataFrame, key: str, line: str, value: str, cell: int = 4096) -> DataFrame:
    """Each point with the value of the last mark at or above it (as-of join), null where there is none.

    The line axis is cut into cells: within a cell one window over points and marks finds the last mark; points
    before their cell's first mark take the last mark of the cells above, found on a table with one row a cell. So a
    key with very many rows is many tasks.
    """
    kind = marks.schema[value].dataType
    both = points.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(kind)}).unionByName(
        marks.where(F.col(value).isNotNull()).select(key, line, F.col(value).alias("__value"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    both = both.withColumn("__cell", _cell(F.col(line), cell))
    upto = Window.partitionBy(key, "__cell").orderBy(line, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__own", F.last("__value", ignorenulls=True).over(upto)).where("__side = 1")
    tails = both.groupBy(key, "__cell").agg(F.max(F.when(F.col("__side") == 0, F.struct(F.col(line), F.col("__value")))).alias("__tail"))
    above = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("__carry", F.last("__tail", ignorenulls=True).over(above)["__value"]).drop("__tail")
    return own.join(carried, [key, "__cell"]).withColumn(value, F.coalesce("__own", "__carry")).drop("__side", "__value", "__cell", "__own", "__carry")


# Longs that a set fits into, holders in a block, and how many of them meet another block at a time.
WORDS, BLOCK, SLICE = 16, 1024, 64


def shared_members(held: DataFrame, least: int) -> DataFrame:
    """(a, b, shared): all pairs a < b of holders that have ``least`` (1 or more) of their things in common.

    ``held(g, f)``: holder ``f`` has thing ``g``; repeated rows count once, nulls are in no pair. Up to 64 * ``WORDS``
    different things (counted) a holder's set is the bits of a few longs: blocks of holders meet and pairs are counted
    as they stream past, so holders are shuffled once for each block, pairs never. With more things holders meet on
    each thing. The table of blocks (or rows) stays in the shared folder for the result to read.
    """
    spark, held = held.sparkSession, cut(held.where("g is not null and f is not null").distinct())
    things = held.select("g").distinct().limit(64 * WORDS + 1)
    rows = sorted(r["g"] for r in things.collect())
    if len(rows) > 64 * WORDS:
        x, y = held.select("g", F.col("f").alias("a")), held.select("g", F.col("f").alias("b"))
        return x.join(y, "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    words = range(max(1, math.ceil(len(rows) / 64)))
    number = spark.createDataFrame([(g, i) for i, g in enumerate(rows)], things.select("g", F.lit(0).alias("n")).schema)
    bit = lambda w: F.when(F.col("n").between(64 * w, 64 * w + 63), F.expr("shiftleft(1L, n % 64)")).otherwise(F.lit(0).cast("long"))
    sets = cut(held.join(F.broadcast(number), "g").groupBy("f").agg(*(F.bit_or(bit(w)).alias(f"m{w}") for w in words)))
    drop(held)
    # Ranges are sampled, so the blocks are written: both sides of the join must see the same ones.
    own = sets.repartitionByRange(max(1, math.ceil(sets.count() / BLOCK)), "f").withColumn("block", F.spark_partition_id())
    blocks = cut(own.groupBy("block").agg(F.collect_list(F.struct("f", *(f"m{w}" for w in words))).alias("rows")))
    drop(sets)
    n = 1 + (blocks.agg(F.max("block")).first()[0] or 0)
    parts = F.transform(F.sequence(F.lit(0), (F.size("rows") - 1).cast("int"), F.lit(SLICE)), lambda at: F.slice("rows", at + 1, SLICE))
    tasks = math.ceil(n * (n + 1) / 16)
    left = blocks.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(n - 1))).alias("j"), "rows").select("i", "j", F.explode(parts).alias("xs")).repartition(tasks, "i", "j")
    right = blocks.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("ys")).repartition(tasks, "i", "j")
    pairs = left.join(right, ["i", "j"]).select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).where("x.f < y.f")
    shared = sum((F.bit_count(F.col(f"x.m{w}").bitwiseAND(F.col(f"y.m{w}"))) for w in words[1:]), F.bit_count(F.col("x.m0").bitwiseAND(F.col("y.m0"))))
    return pairs.select(F.col("x.f").alias("a"), F.col("y.f").alias("b"), shared.cast("long").alias("shared")).where(F.col("shared") >= least)
