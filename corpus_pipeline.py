"""Training-corpus pipeline: each stage reads what the one before kept and returns the columns of ``documents``; the last
one returns the mixture (doc_id, domain, lang, source, epoch, tokens).

Stages: language ID, line dedup, MinHash near-dedup, benchmark decontamination, mixing sources to target weights.

Edge cases, for every stage: an empty table gives an empty table; null, empty and very long texts and null or repeated
ids are handled as the stage's operator says; extra columns are carried along and columns with an operator's names
keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import read
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.langid import fit_profiles, identify
from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.minhash import near_duplicates
from siltstone.llm.mixing import mix
from siltstone.llm.queries import DOMAIN, WEIGHTS
from siltstone.scratch import cut, delete, fresh

LANGUAGES = sorted({path[1] for path in WEIGHTS if len(path) == 2})
MIN_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the mixture has a weight for, with ``lang`` as predicted.

    Profiles come from the labelled rows. A document goes if it has no letters (null and empty texts among them), if
    its language is none of ``LANGUAGES``, or if it is far from every profile (``MIN_LANGUAGE_SCORE``). The prediction
    replaces ``lang``, so rows without a label or with a wrong one are mixed as what they are. Without any labelled row
    there is no profile and all documents go.
    """
    told = identify(docs, fit_profiles(docs), lang_out="__lang", score_out="__score")
    kept = told.where(F.col("__lang").isin(LANGUAGES) & (F.col("__score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("__lang")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; a document goes if none of its lines stay. Documents without lines stay."""
    named = docs.columns
    plain = docs.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(named) if c not in ("doc_id", "text")), "doc_id", "text")
    found = dedup_lines(plain).where("n_lines = 0 or n_removed < n_lines")
    out = found.select(*(F.col(c if c in ("doc_id", "text") else f"__{k}").alias(c) for k, c in enumerate(named)), F.col("n_removed").alias("__gone"))
    if "n_chars" in named:
        out = out.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*named)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) the document with the least id stays.

    Rows without an id stay. The ids that go are a written table, so that Spark knows its size.
    """
    gone = cut(near_duplicates(docs, shingle_words=5, percent=80).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark, copied or edited, go. Of rows that share an id all go, or none."""
    hit = cut(contaminated(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__hit")).distinct(), "hit")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences of documents (epochs) that meet the target weights."""
    path = {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, path, WEIGHTS, F.expr("all_tokens * 6 div 10"), max_epochs=3, seed="mix-1")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

ORACLE_SQL = None  # alignment scores and profile distances can't be expressed in SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder, one table at a time."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        where = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(where), where
    return STAGES[-1][1](spark, docs, sf_dir)
