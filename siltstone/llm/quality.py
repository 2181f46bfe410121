"""Line-first quality rules: judge every line, remove the failed ones, reject documents that lose too much.

Only DataFrame and SQL expressions, all inside one row: no shuffle, no Python on the executors. The base
statistics and the verdict are computed in the scan stage, so the operator is one map over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BLANKS, WORD, let, trimmed, word_count, word_list

# What a line rule looks for (Java and RE2 read these alike).
SYMBOLS = "#*$%&|<>"
ENDS, CLOSERS = ".!?…。！？:;", "\"'”’»)]"
LINE_END = r"[.!?…。！？:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SENTENCE_MARK = r"[.!?…。！？]"
SEPARATORS = "|»›•·→"
SEPARATOR = r"[|»›•·→]"
SHOUTED_MARK = r"[!?]{2,}"
BOILERPLATE = r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookies? (policy|settings)|accept cookies|sign (in|up) |log ?in|subscribe to|newsletter|click here|read more|share (this|on)|follow us|skip to content|enable javascript|lorem ipsum|powered by|back to top|copyright ©|^licensed under|^released under"
# Every phrase of the rule above holds one of these in lower case.
STEMS = ["reserved", "terms of", "privacy", "cookies", "sign ", "log", "subscribe", "newsletter", "click here", "read more", "share ", "follow us", "skip to", "javascript", "lorem", "powered by", "back to top", "copyright", "licensed", "released", "cookie "]
MAX_LOST_PERCENT = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """True for a line that a rule rejects.

    Punctuation: no sentence end at its end and, if it has 10 words or more, none inside either; or symbols on more
    than a quarter of the words; or doubled exclamation or question marks on more than a quarter of the words; or at
    least five words without a lower-case letter. Navigation: separators between items, at least two and one in five
    words. Boilerplate: a line of at most 25 words with a known phrase.

    Words and marks are counted by string functions; a regular expression runs only where a cheaper test leaves it open.
    """

    def judged(facts: Column) -> Column:
        bare, words = facts["bare"], facts["words"]
        without = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
        end = F.right(F.rtrim(bare, F.lit(CLOSERS)), F.lit(1))
        unended = ((end == "") | (F.instr(F.lit(ENDS), end) == 0)) & ((words < 10) | ~bare.rlike(SENTENCE_MARK))
        symbols = 4 * without(SYMBOLS) > words
        shouted = (without("!?") >= 2) & (4 * _count(bare, SHOUTED_MARK) > words)
        capitals = (words >= 5) & ~bare.rlike(r"\p{Ll}") & bare.rlike(r"\p{Lu}")
        menu = (without(SEPARATORS) >= 2) & (5 * without(SEPARATORS) >= words)
        stock = (words <= 25) & let(F.lower(bare), stemmed) & line.rlike(BOILERPLATE)
        return unended | symbols | shouted | capitals | menu | stock

    def stemmed(low: Column) -> Column:
        out = F.lit(False)
        for s in STEMS:
            out = out | F.contains(low, F.lit(s))
        return out

    bare = let(trimmed(line), lambda b: F.struct(b.alias("bare"), word_count(b).alias("words")))
    return let(bare, judged)


def _solid(text: Column) -> Column:
    """Code points of a text that are in words."""
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the text has twice or more (windows by 64-bit hash)."""
    size = F.size(words)
    hashes = F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def twice(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["p"]))

    def covered(places: Column) -> Column:
        own = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(placed), twice), covered))

    return let(hashes, counted)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Statistics, cleaned text and verdict of each document.

    Returns ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``lost_chars`` (word characters of the lines that a rule rejects), ``base_failed``, ``kept`` and ``clean_text``
    (the surviving lines). A document is kept if its base statistics pass and it loses at most
    ``max_lost_percent`` of its word characters.

    Edge cases: null, empty and blank texts have no words, fail the base rule and clean to the empty text. Ids are
    carried, never used, so repeated and null ids are allowed. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))

    def facts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    def lines(found: Column) -> Column:
        good = lambda line: ~line_fails(line)
        kept = lambda clean: F.struct(F.concat_ws("\n", clean).alias("clean_text"), F.aggregate(clean, F.lit(0).cast("long"), lambda n, line: n + _solid(line)).alias("clean_chars"))
        return F.struct((F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"), let(F.filter(found, good), kept).alias("clean"))

    worded = F.filter(F.split("_text", "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    table = base.select(
        F.col("_id"),
        _solid(F.col("_text")).alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(word_list(F.col("_text")), facts).alias("w"),
        let(worded, lines).alias("l"),
    )
    table = table.select(
        F.col("_id").alias(id_col),
        "w.n_words",
        "word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        (F.col("word_chars") - F.col("l.clean.clean_chars")).alias("lost_chars"),
        F.col("l.clean.clean_text").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    table = table.withColumn("base_failed", failed)
    return table.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars")))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_q(WORD)}) AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_q(WORD)})) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
reps AS (SELECT doc_id, sum(g) AS n FROM (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS g FROM twice) GROUP BY doc_id),
line AS (
  SELECT doc_id, l, len(regexp_extract_all(l, {_q(WORD)})) AS nw, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS solid
  FROM w, unnest(ls) AS u(l)),
lost AS (
  SELECT doc_id, sum(solid) AS n FROM line
  WHERE (NOT regexp_matches(l, {_q(LINE_END)}) AND (nw < 10 OR NOT regexp_matches(l, {_q(SENTENCE_MARK)})))
     OR 4 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > nw
     OR 4 * len(regexp_extract_all(l, {_q(SHOUTED_MARK)})) > nw
     OR (nw >= 5 AND regexp_matches(l, '\p{{Lu}}') AND NOT regexp_matches(l, '\p{{Ll}}'))
     OR (len(regexp_extract_all(l, {_q(SEPARATOR)})) >= 2 AND 5 * len(regexp_extract_all(l, {_q(SEPARATOR)})) >= nw)
     OR (nw <= 25 AND regexp_matches(l, {_q(BOILERPLATE)}))
  GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN reps USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM f
"""
