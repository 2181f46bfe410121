"""Stand-in relations over the driver's tables, and the same relations as SQL.

The analyses work on findings, metrics, graphs and documents of software projects. The tables here have other
content but the same shapes; each binding names what it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FINDING_TYPES = ("error", "purchase", "click", "view", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str, engine: str | None = None) -> DataFrame:
    """Events as findings: user = file, minute of the year = line, type = engine, property = class."""
    events = table(spark, sf_dir, "events")
    if engine:
        events = events.where(F.col("event_type") == engine)
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"),
        F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01', ts)").alias("line"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5).alias("cls"),
        (F.col("user_id") % 3).alias("project"),
        F.col("event_type").alias("engine"),
        "value",
    )


FINDINGS = """fnd AS (SELECT event_id AS id, 'u' || user_id AS file, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS line,
  regexp_extract(props, '[0-9]+')::INT % 5 AS cls, user_id % 3 AS project, event_type AS engine, value FROM events)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): shipments from supplier nations to customer nations; stands for references between modules."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    suppliers, customers = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    told = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return told.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"))


def modules(spark: SparkSession, sf_dir: str, top: int = 3, acyclic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (nations) and edges: each node's ``top`` most used others; ``acyclic`` keeps arcs to larger ids."""
    arcs = trade(spark, sf_dir).where("src < dst" if acyclic else "src <> dst")
    order = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    edges = arcs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("src", "dst")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), edges


def modules_sql(top: int = 3, acyclic: bool = False) -> str:
    return f"""nodes AS (SELECT n_nationkey AS id FROM nation),
trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
edges AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM trade
  WHERE {"src < dst" if acyclic else "src <> dst"}) WHERE r <= {top})"""


CLOSURE = "clo AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM clo c JOIN edges e ON c.dst = e.src)"
