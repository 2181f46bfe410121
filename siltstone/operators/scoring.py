"""Counts and scores over findings and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The upper ends of the histogram's bins; the last one is open.
BIN_ENDS = [5, 10, 20, 30, 40, 60, 100, 200]


def percent(part: Column, whole: Column) -> Column:
    """A percentage with one decimal; null on an empty base."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), 1)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, category: str, real: str, found: str) -> DataFrame:
    """TP, FP, FN, TN per category with rates (0 on an empty base) and the score (TPR - FPR) x 100."""
    cells = {"tp": F.col(real) & F.col(found), "fp": ~F.col(real) & F.col(found), "fn": F.col(real) & ~F.col(found), "tn": ~F.col(real) & ~F.col(found)}
    out = df.groupBy(category).agg(*(F.count_if(c).alias(n) for n, c in cells.items()))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    out = out.withColumns({"tpr": F.round(rate("tp", "fn"), 6), "fpr": F.round(rate("fp", "tn"), 6)})
    return out.withColumn("score", F.round(100 * (rate("tp", "fn") - rate("fp", "tn")), 4))


def agreement(df: DataFrame, ours: str, theirs: str, *keys: str) -> DataFrame:
    """How often two values of one metric are equal, one apart, further apart."""
    away = F.abs(F.col(ours) - F.col(theirs))
    return df.groupBy(*keys).agg(F.count_if(away == 0).alias("equal"), F.count_if(away == 1).alias("within_one"), F.count_if(away > 1).alias("apart"))


def over_limit(df: DataFrame, ours: str, theirs: str, limit: float, *keys: str) -> DataFrame:
    a, b = F.col(ours) > limit, F.col(theirs) > limit
    return df.groupBy(*keys).agg(F.count_if(a).alias("ours"), F.count_if(b).alias("theirs"), F.count_if(a & b).alias("both"))


def histogram(df: DataFrame, metric: str, ends: Sequence[int] = tuple(BIN_ENDS)) -> DataFrame:
    """Counts per bin ``low``-``high``; bins without rows are there with 0. Values below 1 fall into the first bin."""
    spark = df.sparkSession
    lows = [1, *(e + 1 for e in ends)]
    bins = spark.createDataFrame([(i, low, ends[i] if i < len(ends) else None) for i, low in enumerate(lows)], "bin int, low long, high long")
    at = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        at = F.when(F.col(metric) <= ends[i], i).otherwise(at)
    counts = df.where(F.col(metric).isNotNull()).select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(counts), "bin", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(df: DataFrame, metric: str, limit: float, *keys: str) -> DataFrame:
    """n, mean, sample deviation, median, p90, p95 (linear interpolation), maximum and share over the limit."""
    c = F.col(metric).cast("double")
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"),
        F.round(F.avg(c), 6).alias("mean"),
        F.round(F.stddev_samp(c), 6).alias("sd"),
        F.round(F.percentile(c, 0.5), 6).alias("median"),
        F.round(F.percentile(c, 0.9), 6).alias("p90"),
        F.round(F.percentile(c, 0.95), 6).alias("p95"),
        F.max(c).alias("max"),
        F.round(F.avg((c > limit).cast("double")), 6).alias("share_over"),
    )


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``more``, the number left out.

    The input is read twice on purpose: the rank limit is applied before the shuffle and the sizes are combined before
    it, so of a hot group only ``n`` rows and one count leave each task. One window for both would move all its rows.
    """
    ranked = Window.partitionBy(group).orderBy(*order)
    whole = df.groupBy(group).agg(F.count("*").alias("__all"))
    first = df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)
    return first.join(whole, group).withColumn("more", F.greatest(F.col("__all") - n, F.lit(0))).drop("__all")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last definition of each key wins."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, *(F.col(f"__last.{c}").alias(c) for c in columns))


def with_total(df: DataFrame, key: str, **sums: Column) -> DataFrame:
    """One row a key and a ``TOTAL`` row."""
    out = df.rollup(key).agg(F.grouping(key).alias("__g"), *(c.alias(n) for n, c in sums.items()))
    return out.withColumn(key, F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col(key).cast("string"))).drop("__g")


def with_shares(df: DataFrame, key: str, part: Column, total: str = "TOTAL") -> DataFrame:
    """One row a key and a total row, with ``cell`` reading ``n of m``: rows that meet ``part`` of all rows."""
    out = with_total(df, key, n=F.count_if(part), m=F.count("*"))
    return out.select(F.when(F.col(key) == "TOTAL", total).otherwise(F.col(key)).alias(key), F.concat_ws(" of ", F.col("n").cast("string"), F.col("m").cast("string")).alias("cell"))


def fold_max(parents: DataFrame, nested: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Parents with ``value`` raised to the greatest of their nested rows; nested rows without a parent are dropped."""
    top = nested.groupBy(*keys).agg(F.max(value).alias("__top"))
    return parents.join(top, list(keys), "left").withColumn(value, F.greatest(F.col(value), F.coalesce("__top", F.col(value)))).drop("__top")


def upsert_metrics(rows: DataFrame, keys: Sequence[str], metric: str, value: str, defaults: dict[str, int]) -> DataFrame:
    """One row a key with a column for each metric of ``defaults``; a metric that never arrives has its default.

    Several values of one metric leave the greatest.
    """
    return rows.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col(metric) == m, F.col(value))), F.lit(d)).alias(m) for m, d in defaults.items()))


def over_limits(df: DataFrame, metric: str, value: str, limits: dict[str, int]) -> DataFrame:
    """Rows whose value is over the limit of their metric; a metric without a limit is never over."""
    table = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    return df.withColumn("limit", F.try_element_at(table, F.col(metric))).where(F.col(value) > F.col("limit"))


def worst_first(df: DataFrame, ours: str, theirs: str, *ties: str) -> DataFrame:
    """All rows by the size of their difference, the largest first."""
    return df.withColumn("d", F.col(ours) - F.col(theirs)).orderBy(F.desc(F.abs("d")), *ties)
