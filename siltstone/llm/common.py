"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


BATCH_ROWS = 2000
HOT_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole documents hold at most ``BATCH_ROWS`` rows, unless the session asks for fewer.

    Spark reads the setting when a plan runs, which is after the operator has returned it, so the session keeps it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A ``mapInArrow`` function that gives freed memory back when its task ends; idle workers stay small."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


@contextlib.contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that run within are planned as shuffles unless a broadcast is asked for, so small and large inputs take one
    way and the needs of a large one can be told from a small one. Adaptive execution may still read a small side at once."""
    planned, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, own = spark.conf.get(planned), spark.conf.get(adaptive, None)
    spark.conf.set(planned, "-1")
    if own is None:
        spark.conf.set(adaptive, before)
    try:
        yield
    finally:
        spark.conf.set(planned, before)
        if own is None:
            spark.conf.unset(adaptive)


def shared_out(rows: DataFrame, table: DataFrame, keys: list[str], count: str, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, ``count`` rows of ``rows`` have it), hot keys dealt to many tasks.

    A key is hot if it holds more than a quarter of a partition's even share and ``HOT_ROWS``; there are at most
    ``4 * partitions`` such keys at any size, so their list is broadcast. Rows of a hot key are dealt by a hash of
    ``spread`` and the key's one row is repeated as often. Nothing is dropped. ``table`` should be a written table.
    """
    spark = rows.sparkSession
    total = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    limit = max(HOT_ROWS, total // (4 * shuffle_partitions(spark)))
    hot = F.broadcast(table.where(F.col(count) > limit).select(*keys, F.expr(f"cast(ceil({count} / {limit}) as int)").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("__salts")
    copied = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts", count)
    return dealt.join(copied.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row (a lambda variable, so that no rule inlines it again)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_list(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    parts = F.split(F.coalesce(text, F.lit("")), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def trimmed(text: Column) -> Column:
    """A text without blanks at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def word_count(line: Column) -> Column:
    """Words of a text without blanks at its ends, 0 for an empty one: its single blanks and one; only texts with other
    blanks are cut up."""
    plain = (F.instr(line, "  ") == 0) & (F.translate(line, BLANKS[1:], "") == line)
    return F.when(line == "", 0).when(plain, F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).otherwise(F.size(F.split(line, NOT_WORD)))
