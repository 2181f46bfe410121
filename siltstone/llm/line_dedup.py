"""Removal of repeated runs of lines, by winnowing over line hashes.

Only DataFrame and SQL expressions. The lines of a document (trimmed, blank ones left out) are hashed once, and their
hashes in runs of ``gram_lines``; of every ``window`` consecutive run hashes the least is a fingerprint, so two
documents that share ``gram_lines + window - 1`` lines (the *guaranteed length*) have a fingerprint in common.
Fingerprints found in one place are dropped. The positions of the others are joined on the fingerprint and the matches
extended by up to ``window - 1`` lines both ways, to every stretch of guaranteed length around the fingerprint; of
equal stretches the first in the corpus stays. Shorter runs that hold ``long_words`` words and more are fingerprints
and stretches of their own, so a long passage on one line or two is found too. Later stretches that overlap or touch in
a document form its maximal repeated runs, whose lines go.

Fingerprints are written once and read by both the count and the join; each table is deleted when the next is written.

Skew: a line run that is everywhere is one key in two aggregations (combined before the shuffle) and in two joins
against a table with one row a key; hot keys of the joins are counted and dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BLANKS, let, shared_out, trimmed, word_count
from siltstone.scratch import cut, drop

GRAM_LINES = 2
WINDOW = 2
LONG_WORDS = 50
_NULL_ID = 9223372036854775807


def _hashed(text: Column, long_words: int | None) -> Column:
    """The solid lines of a text as two 64-bit hashes and their number of words (0 where it isn't asked for)."""
    solid = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda line: line != "")
    words = (lambda line: F.lit(0)) if long_words is None else word_count
    return F.transform(solid, lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), words(line).alias("w")))


def _stretch(lines: Column, start: Column, count: int) -> Column:
    """A run of lines as (start, len, h1, h2)."""
    side = lambda name: F.xxhash64(F.lit(count), *(F.get(lines, start + k)[name] for k in range(count)))
    return F.struct(start.alias("start"), F.lit(count).alias("len"), side("a").alias("h1"), side("b").alias("h2"))


def _long_runs(lines: Column, count: int, long_words: int) -> Column:
    """The runs of ``count`` lines with ``long_words`` words, in the shape of ``_fingerprints``."""

    def enough(i: Column) -> Column:
        return sum((F.get(lines, i + k)["w"] for k in range(count)), F.lit(0)) >= long_words

    def told(i: Column) -> Column:
        stretch = _stretch(lines, i, count)
        return F.struct(F.xxhash64(F.lit(-1), stretch["h1"]).alias("h"), F.array(stretch).alias("stretches"))

    return F.when(F.size(lines) >= count, F.transform(F.filter(F.sequence(F.lit(0), F.size(lines) - count), enough), told))


def _fingerprints(lines: Column, gram_lines: int, window: int, long_words: int | None) -> Column:
    """Array of (h, stretches) of a document; stretches: (start, len, h1, h2) of each run around it that counts."""
    length = gram_lines + window - 1
    n = F.size(lines)

    def chosen(runs: Column) -> Column:
        # the least hash of each window, the rightmost of equals
        least = F.transform(F.sequence(F.lit(0), F.size(runs) - window), lambda i: F.array_min(F.slice(runs, i + 1, window)))
        return F.array_distinct(least)

    gram = lambda i: F.xxhash64(F.lit(gram_lines), *(F.get(lines, i + k)["a"] for k in range(gram_lines)))
    runs = F.transform(F.sequence(F.lit(0), n - gram_lines), lambda i: F.struct(gram(i).alias("h"), (-i).alias("back")))
    around = lambda p: F.transform(F.sequence(F.greatest(F.lit(0), p - window + 1), F.least(p, n - length)), lambda s: _stretch(lines, s, length))
    found = F.transform(let(runs, chosen), lambda x: F.struct(x["h"].alias("h"), around(-x["back"]).alias("stretches")))
    kinds = [F.when(n >= length, found)]
    if long_words is not None:
        kinds += [_long_runs(lines, count, long_words) for count in range(1, length)]
    return F.flatten(F.array_compact(F.array(*kinds)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_lines: int = GRAM_LINES, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted from ``text_col``.

    A run of ``gram_lines + window - 1`` non-blank lines, or of fewer lines with at least ``long_words`` words together
    (None: only by lines), repeats if the same trimmed lines start earlier: in a document with a smaller id, or in the
    same document above. All runs are judged on the input. Blank lines count for nothing and stay. All rows and columns
    stay; ``n_lines`` (non-blank lines), ``n_removed`` and ``removed_lines`` (0-based numbers among all lines) are added
    and replace columns of that name.

    Edge cases: a null text stays null and has no lines; texts shorter than any run stay as they are. Rows with a null
    id come last. Rows with equal id and text are one document with one answer; rows with equal id and different
    texts are different documents in a fixed order (by hash). Line equality is by 128-bit hash. Ids are integers.
    """
    text = F.col(text_col).cast("string")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("__nid"), F.xxhash64(text).alias("__th")]
    prints = docs.select(*key, F.explode(let(_hashed(text, long_words), lambda lines: _fingerprints(lines, gram_lines, window, long_words))).alias("f")).select("__nid", "__th", "f.h", "f.stretches")
    prints = cut(prints.select("__nid", "__th", "h", "stretches", F.element_at("stretches", 1)["start"].alias("at")), "prints")

    place = F.struct("__nid", "__th", "at")
    repeated = cut(prints.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low < high").select("h", "n"))
    found = shared_out(prints, repeated, ["h"], "n", ["__nid", "at"])
    stretches = cut(found.select("__nid", "__th", F.explode("stretches").alias("s")).select("__nid", "__th", "s.*"), "stretches")
    drop(prints, repeated)
    first = cut(stretches.groupBy("h1", "h2").agg(F.min(F.struct("__nid", "__th", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = shared_out(stretches, first, ["h1", "h2"], "n", ["__nid", "start"]).where("struct(__nid, __th, start) > first")
    later = cut(again.groupBy("__nid", "__th").agg(F.collect_set(F.struct("start", "len")).alias("__starts")), "later")
    drop(stretches, first)

    wide = docs.select("*", *key).join(later.hint("merge"), ["__nid", "__th"], "left")
    solid = lambda line: F.translate(line, BLANKS, "") != ""

    def result(lines: Column) -> Column:
        def told(full: Column) -> Column:
            gone = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.transform(F.sequence(s["start"], s["start"] + s["len"] - 1), lambda c: F.get(full, c)))))
            return let(F.sort_array(gone), lambda g: F.struct(F.size(full).cast("long").alias("n"), g.alias("gone"), kept(g).alias("text")))

        def kept(gone: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

        whole = F.struct(F.size(F.filter(lines, solid)).cast("long").alias("n"), F.array().cast("array<int>").alias("gone"), F.lit(None).cast("string").alias("text"))
        numbers = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: solid(F.get(lines, i)))
        return F.when(F.col("__starts").isNull(), whole).otherwise(let(numbers, told))

    wide = wide.withColumn("__r", let(F.split(F.coalesce(text, F.lit("")), "\n"), result))
    out = wide.withColumns(
        {
            text_col: F.when(F.col("__starts").isNull(), text).otherwise(F.col("__r.text")),
            "n_lines": F.col("__r.n"),
            "n_removed": F.size("__r.gone").cast("long"),
            "removed_lines": F.col("__r.gone"),
        }
    )
    return out.drop("__nid", "__th", "__starts", "__r")


ORACLE = r"""
WITH d AS (SELECT doc_id, text AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS solid FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE solid <> ''),
r AS (SELECT doc_id, p, solid || chr(10) || lead(solid) OVER w || chr(10) || lead(solid, 2) OVER w AS k3, CASE WHEN n >= 50 THEN solid END AS k1,
      CASE WHEN n + lead(n) OVER w >= 50 THEN solid || chr(10) || lead(solid) OVER w END AS k2
      FROM (SELECT *, len(regexp_extract_all(solid, '[^\x20\x09-\x0D]+')) AS n FROM s) WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p, 3 AS size FROM r WHERE k3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k3 ORDER BY doc_id, p) > 1
  UNION ALL SELECT doc_id, p, 2 FROM r WHERE k2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k2 ORDER BY doc_id, p) > 1
  UNION ALL SELECT doc_id, p, 1 FROM r WHERE k1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k1 ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM (SELECT doc_id, p + o AS p FROM later, unnest(range(size)) AS u(o)) x JOIN s USING (doc_id, p)),
k AS (
  SELECT l.doc_id, count(*) FILTER (solid <> '') AS n_lines, count(gone.i) AS n_removed,
         string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS kept
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
