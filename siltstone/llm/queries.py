"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import read
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.htmltext import extract
from siltstone.llm.langid import fit_profiles, identify
from siltstone.llm.licenses import scan_licenses
from siltstone.llm.line_dedup import ORACLE as LINE_SQL
from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.minhash import near_duplicates
from siltstone.llm.mixing import mix
from siltstone.llm.quality import ORACLE as QUALITY_SQL
from siltstone.llm.quality import quality
from siltstone.llm.substring_dedup import remove_repeats
from siltstone.llm.warczip import read_packages, write_packages
from siltstone.scratch import fresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
marked AS (
  SELECT words.doc_id, words.i, word,
         count(later.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN later USING (doc_id, i)),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle_words=3, percent=85, bands=25, rows=5)


ORACLE_SQL["op7_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS o FROM documents UNION SELECT r.id, e.y FROM r JOIN e ON r.o = e.x),
c AS (SELECT id, min(o) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.id = w.doc_id
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).drop("clean_text")


ORACLE_SQL["op3_quality_rules"] = QUALITY_SQL


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    share = F.crc32(F.col("doc_id").cast("string")) % 3
    profiles = fit_profiles(docs.where(share != 1))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", F.coalesce(share == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


@query
def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh(spark, "warc")
    packages = write_packages(read(spark, sf_dir, "pages"), uri, min_revisit_bytes=0)
    return read_packages(spark, packages, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op10_warc_zip"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x, max(page_id) OVER (PARTITION BY sha1(b)) AS last FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM h
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op4_line_dedup"] = LINE_SQL


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "coverage", "matched_words", "start_word", "end_word", "start_byte", "end_byte")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


DOMAIN = "case cast(try_cast(substr(source, 4) as int) % 3 as int) when 0 then 'web' when 1 then 'books' when 2 then 'forums' end"
WEIGHTS = {("web",): 5, ("books",): 3, ("forums",): 2, **{(d, x): w for d in ("web", "books", "forums") for x, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 1))}}


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    return mix(read(spark, sf_dir, "documents"), path, WEIGHTS, F.expr("all_tokens * 6 div 10"), max_epochs=3, seed="mix-1")


def _fill(name: str, parent: str, here: str, weight: str) -> str:
    """SQL of one level: siblings below each parent filled in order of capacity over weight."""
    up = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_n AS (SELECT {here}, sum(cap)::BIGINT AS cap, {weight} AS w FROM leaf GROUP BY {here}),
{name}_b AS (SELECT n.*, p.budget FROM {name}_n n {f"JOIN {name}_p p USING ({parent})" if parent else f"CROSS JOIN {name}_p p"}),
{name}_o AS (SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}_b WINDOW o AS ({up} ORDER BY cap / w, {here.split(", ")[-1]})),
{name}_a AS (SELECT *, min(CASE WHEN cap * ws > w * (budget - s) THEN k END) OVER ({up}) AS at FROM {name}_o),
{name} AS (SELECT a.{here.replace(", ", ", a.")}, (CASE WHEN a.at IS NULL OR a.k < a.at THEN a.cap ELSE a.w * (a.budget - t.s) // t.ws END)::BIGINT AS budget
           FROM {name}_a a LEFT JOIN {name}_a t ON t.k = a.at {"".join(f" AND t.{c} = a.{c}" for c in parent.split(", ") if c)})"""


ORACLE_SQL["op9_source_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, CASE TRY_CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' ELSE '(none)' END AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 3 * sum(tokens)::BIGINT AS cap FROM d WHERE tokens > 0 GROUP BY ALL),
l1_p AS (SELECT (sum(tokens) * 6 // 10)::BIGINT AS budget FROM leaf),
{_fill("l1", "", "domain", "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 ELSE 1 END")},
l2_p AS (SELECT * FROM l1),
{_fill("l2", "domain", "domain, lang", "CASE WHEN domain = '(none)' THEN 1 WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END")},
l3_p AS (SELECT * FROM l2),
{_fill("l3", "domain, lang", "domain, lang, source", "1")},
e AS (SELECT d.*, budget // leaf.tokens AS epochs, budget % leaf.tokens AS rest FROM d JOIN leaf USING (domain, lang, source) JOIN l3 USING (domain, lang, source) WHERE d.tokens > 0),
f AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null')), tokens
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
SELECT doc_id, domain, lang, source, epochs::INT AS epoch, tokens FROM f WHERE upto <= rest
UNION ALL
SELECT doc_id, domain, lang, source, k::INT AS epoch, tokens FROM e, unnest(range(epochs::BIGINT)) AS u(k)
"""
