"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens flows down a tree of columns (domain, language, source). At each node it is dealt to the
children in proportion to their weights; a child can take at most what its subtree holds in ``max_epochs`` epochs,
and what it can't take goes to its siblings. Only what a whole family can't take has been left with the family's
own siblings one level up. At the leaf the budget buys whole epochs and, of one further epoch in seeded order, the
longest prefix that fits.

The tree lives in tables with one row a node; budgets are integers, so results don't depend on summation order.
The prefix is found without sorting a leaf: documents fall into hash ranges of about ``RANGE_ROWS`` rows, ranges
are summed, and only the range in which the budget ends is ordered. Documents meet their leaf's plan by a broadcast of
one row a leaf, so they are never moved by leaf, however much one leaf holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, shared_out
from siltstone.scratch import cut

RANGE_ROWS = 1024
PLAN_ROWS = 100_000


def _weight(path: list[str], weights: dict[tuple[str, ...], int]) -> Column:
    own = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not own:
        return F.lit(1).cast("long")
    table = F.create_map(*(F.lit(x) for k, v in own.items() for x in ("\x1f".join(k), int(v))))
    return F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *path)), F.lit(1)).cast("long")


def _dealt(nodes: DataFrame, parent: list[str], path: list[str], weights: dict[tuple[str, ...], int]) -> DataFrame:
    """Fill the siblings below each parent: nodes with ``cap`` and the parent's ``budget`` get their own ``budget``."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("cap") / F.col("w"), path[-1])
    upto, since = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("w", _weight(path, weights))
    live = n.where("w > 0").withColumns({"s": F.coalesce(F.sum("cap").over(upto), F.lit(0)), "ws": F.sum("w").over(since), "k": F.row_number().over(order)})
    live = live.withColumn("open", F.expr("cap * ws > w * (budget - s)"))
    live = live.withColumn("at", F.min(F.when(F.col("open"), F.struct("k", "s", "ws"))).over(family))
    share = F.when(F.col("at").isNull() | (F.col("k") < F.col("at.k")), F.col("cap")).otherwise(F.expr("w * (budget - at.s) div at.ws"))
    dealt = live.withColumn("budget", share).select(*nodes.columns)
    return dealt.unionByName(n.where("w <= 0").withColumn("budget", F.lit(0).cast("long")).select(*nodes.columns))


def budgets(leaves: DataFrame, path: list[str], weights: dict[tuple[str, ...], int], total: Column, max_epochs: int) -> DataFrame:
    """Leaf rows (``path``, ``tokens``) with their ``budget``; ``total`` may refer to ``all_tokens``, the sum over leaves."""
    caps = leaves.withColumn("cap", F.col("tokens") * F.lit(int(max_epochs)))
    given = caps.agg(F.sum("tokens").alias("all_tokens")).select(total.cast("long").alias("budget"))
    level = None
    for depth in range(1, len(path) + 1):
        here, above = path[:depth], path[: depth - 1]
        nodes = caps.groupBy(*here).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(F.broadcast(given)) if level is None else nodes.join(level.select(*above, "budget"), above)
        level = _dealt(nodes.select(*here, "cap", "budget"), above, here, weights)
    return leaves.join(level.select(*path, "budget"), path)


def mix(
    docs: DataFrame,
    path: dict[str, Column],
    weights: dict[tuple[str, ...], int],
    total: int | Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_epochs: int = 2,
    seed: str = "0",
) -> DataFrame:
    """Select documents so that the sources reach their weights within a token budget.

    ``path`` names the tree's levels and their expressions over ``docs``; ``weights`` maps node paths (tuples of
    level values) to integer weights (1 where none is given, 0 leaves a subtree out; their sums times the tokens
    must stay below 9e18). ``total`` is the budget in tokens (words), or an expression over ``all_tokens``.

    Returns one row for each selected occurrence: ``id_col``, the levels, ``epoch`` (0-based) and ``tokens``. No
    leaf exceeds its budget; a leaf misses it by less than its next document in order, a family by rounding.

    Edge cases: a null level value is the node ``(none)``; documents without words are never selected; an empty table
    gives no rows; a very long text counts with all its words. Rows with equal ids are different documents with equal
    rank (fewer tokens first), and those with equal tokens too are counted as one row, so an id that many rows share is
    no burden; null ids rank by the text ``null``. Other columns are ignored, whatever their names.
    """
    levels = list(path)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    table = docs.select(
        F.col(id_col).alias("_id"),
        key.alias("_key"),
        *(F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in path.items()),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("tokens"),
    )
    table = cut(table.where("tokens > 0"), "tokens")
    leaves = table.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    total = F.lit(int(total)) if isinstance(total, int) else total
    plan = budgets(leaves, levels, weights, total, max_epochs).withColumns({"epochs": F.expr("cast(budget div tokens as int)"), "rest": F.expr("budget % tokens")})
    plan = cut(plan.where("budget > 0").select(*levels, "epochs", "rest", "n", F.expr(f"cast(ceil(n / {RANGE_ROWS}) as long)").alias("ranges")), "plan")

    rank = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.col("_key")))
    part = F.expr("cast(conv(substr(_rank, 1, 8), 16, 10) as long) * ranges div 4294967296")
    drawn = _planned(table, plan, levels).withColumn("_rank", rank).withColumn("_range", part)
    sums = drawn.where("rest > 0").groupBy(*levels, "_range", "rest").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy(*levels).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).where("before <= rest and before + sum > rest")
    plan = cut(plan.join(ends.select(*levels, F.col("_range").alias("end"), "before"), levels, "left"), "plan")

    drawn = _planned(table, plan, levels).withColumn("_rank", rank).withColumn("_range", part)
    whole = F.col("epochs") + F.coalesce((F.col("_range") < F.col("end")).cast("int"), F.lit(0))
    full = drawn.withColumn("_times", whole).where("_times > 0").select("_id", *levels, F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"), "tokens")

    # rows of one rank and size are alike in all that is returned: they are counted, and as many as fit are made again
    like = drawn.where("_range = end").groupBy("_id", *levels, "epochs", "_rank", "_range", "tokens", "rest", "before").agg(F.count("*").alias("like"))
    upto = Window.partitionBy(*levels, "_range").orderBy("_rank", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("tokens") * F.col("like")).over(upto), F.lit(0))
    like = like.withColumn("_room", room).withColumn("_times", F.expr("least(like, _room div tokens)")).where("_times > 0")
    prefix = like.select("_id", *levels, F.col("epochs").alias("epoch"), "tokens", F.explode(F.expr("sequence(1, cast(_times as int))")).alias("_k")).drop("_k")
    return full.unionByName(prefix).withColumnRenamed("_id", id_col)


def _planned(table: DataFrame, plan: DataFrame, levels: list[str]) -> DataFrame:
    """Rows with their leaf's plan. The plan is broadcast up to ``PLAN_ROWS`` leaves (counted), else hot leaves are dealt out."""
    if plan.count() <= PLAN_ROWS:
        return table.join(F.broadcast(plan), levels)
    return shared_out(table, plan, levels, "n", ["_key"])
