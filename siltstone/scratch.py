"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where none is named and Spark runs in one
process (tests) a temporary folder stands in; on a cluster that raises, as executors could not read it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder as a URI without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            named = known.get()
        elif spark.sparkContext.master.startswith("local"):
            named = "file://" + tempfile.mkdtemp(prefix="siltstone-")
            spark.conf.set("spark.checkpoint.dir", named)
        else:
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    return (named if urlparse(named).scheme else "file://" + os.path.abspath(named)).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once and read back: its plan is the scan of a table. ``drop`` deletes the table.

    Shuffle files of the job that writes it are freed when it ends.
    """
    spark = df.sparkSession
    where = fresh(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(where)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(where)
    out.written_to = where
    return out


class Gathered:
    """Rows that rounds of a loop find, as one table: a union of written tables, written anew after every ``EVERY``."""

    EVERY = 8

    def __init__(self, first: DataFrame):
        self.tables = [first]

    def add(self, more: DataFrame) -> None:
        self.tables.append(more)
        if len(self.tables) > self.EVERY:
            self.tables = [cut(self.all())]

    def all(self) -> DataFrame:
        out = self.tables[0]
        for table in self.tables[1:]:
            out = out.unionByName(table)
        return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` made, once nothing reads them any more; None and other tables are passed over."""
    for table in tables:
        where = getattr(table, "written_to", None) if table is not None else None
        if isinstance(where, str):
            delete(table.sparkSession, where)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
