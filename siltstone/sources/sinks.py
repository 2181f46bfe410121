"""Results as files: JSON per project, Markdown tables, bills of materials, report index, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.packages import package_url


def write_json(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """One column ``value`` with the rows of a Markdown table (nulls as ``-``, pipes escaped), without header."""
    return df.select(_cells(df.columns).alias("value"))


def _cells(columns: list[str]) -> Column:
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"\|", r"\\|") for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def write_markdown(df: DataFrame, path: str, *order: Column | str) -> None:
    """A small result as one text file in the order given (as ``df`` comes without one), header and rule first.

    Rows carry their number into one sorted partition, so the order rests on a sort and not on how a union is read.
    """
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "n long, value string")
    ordered = df.orderBy(*order) if order else df
    numbered = ordered.withColumn("__n", F.monotonically_increasing_id() + 2)
    rows = numbered.select(F.col("__n").alias("n"), _cells(df.columns).alias("value"))
    head.unionByName(rows).repartition(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def cyclonedx(packages: DataFrame) -> DataFrame:
    """CycloneDX 1.5 components, one JSON line each, of (ecosystem, name, version, licence)."""
    part = F.struct(F.lit("library").alias("type"), "name", "version", package_url(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"), F.when(F.col("licence").isNotNull(), F.array(F.struct(F.struct(F.col("licence").alias("id")).alias("license")))).alias("licenses"))
    return packages.select(F.to_json(part).alias("value"))


def spdx(packages: DataFrame) -> DataFrame:
    """SPDX 2.3 packages, one JSON line each."""
    ident = F.concat(F.lit("SPDXRef-"), F.regexp_replace(F.concat_ws("-", "ecosystem", "name", "version"), "[^A-Za-z0-9.-]", "-"))
    part = F.struct(ident.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.coalesce("licence", F.lit("NOASSERTION")).alias("licenseDeclared"), F.lit("NOASSERTION").alias("downloadLocation"))
    return packages.select(F.to_json(part).alias("value"))


def bill_document(components: DataFrame, kind: str, name: str, version: str = "1") -> DataFrame:
    """A whole bill of materials as one JSON text: the lines of ``cyclonedx`` or ``spdx`` in their document.

    One row, so for the bill of one project; the lines are sorted, so equal bills are equal texts.
    """
    parts = components.agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("parts"))
    if kind == "cyclonedx":
        head = f'{{"bomFormat":"CycloneDX","specVersion":"1.5","version":{version},"metadata":{{"component":{{"type":"application","name":"{name}"}}}},"components":['
    else:
        head = f'{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"{name}","documentNamespace":"urn:{name}:{version}","packages":['
    return parts.select(F.concat(F.lit(head), "parts", F.lit("]}")).alias("value"))


def write_report(df: DataFrame, index: DataFrame, folder: str, name: str, title: str, *order: Column | str) -> DataFrame:
    """Write a report and return the index (path, title) with its row, added once however often it is written."""
    write_markdown(df, f"{folder}/{name}", *order)
    row = df.sparkSession.createDataFrame([(name, title)], "path string, title string")
    return upsert(index, row, "path")


def upsert(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The index with the new rows in place of those with the same key."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows)


def gate(findings: DataFrame, tag: str = "tag") -> tuple[bool, int]:
    """Whether any finding is live (has no tag), and how many are."""
    live = findings.agg(F.count_if(F.coalesce(tag, F.lit("")) == "").alias("n")).first()["n"]
    return live > 0, live
