"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the ranked list of the most frequent character n-grams (orders 1 to 3, letters and word boundaries,
lower case). A document goes to the language whose profile has the least out-of-place distance to its own.

Fitting counts the n-grams of every training text: tasks emit one row for each language and n-gram, Spark sums
them, and only ``languages * profile`` rows reach the driver. Prediction is one map over the input. Code points
are packed three to a 64-bit integer, so counting is sorting of integers and no text is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, lean, release
from siltstone.llm.words import PIECE_BYTES

PROFILE = 400
DOCUMENT_GRAMS = 300
UNKNOWN = "und"
_kinds = np.zeros(0x110000, dtype=np.uint8)  # 0: not seen yet, 1: letter, 2: other


def _letters(points: np.ndarray) -> np.ndarray:
    kinds = _kinds[points]
    if (kinds == 0).any():
        for c in np.unique(points[kinds == 0]).tolist():
            _kinds[c] = 1 if chr(c).isalpha() else 2
        kinds = _kinds[points]
    return kinds == 1


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if 2 * size >= PIECE_BYTES or i == len(texts) - 1:
            yield a, i + 1
            a, size = i + 1, 0


def gram_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct n-gram codes and their counts; empty arrays for a text without letters."""
    for a, b in _pieces(texts):
        low = [(t or "").lower() for t in texts[a:b]]
        points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in low])
        letter = _letters(points)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first blank after a letter stays as the word boundary
        codes = np.where(letter, points, 32)[keep].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        two = (codes[:-1] << 21) | codes[1:]
        three = (two[:-1] << 21) | codes[2:]
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if s == e:
                yield codes[:0], codes[:0]
                continue
            one = codes[s:e]
            grams = np.concatenate([one[one != 32], two[s : e - 1], three[s : max(s, e - 2)]])
            grams.sort()
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            yield grams[first], np.diff(np.concatenate([first, [len(grams)]]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within the task."""
    totals: dict[str, list] = {}
    held = 0

    def merge():
        for lang, parts in totals.items():
            grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            totals[lang] = [(grams, counts)]

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, (grams, counts) in zip(langs, gram_counts(batch.column(1).to_pylist()), strict=True):
            totals.setdefault(lang, []).append((grams, counts))
            held += len(grams)
            if held > 2_000_000:
                merge()
                held = 0
    merge()
    for lang, [(grams, counts)] in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])


def fit_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", profile: int = PROFILE) -> dict[str, list[int]]:
    """Language to its ``profile`` most frequent n-gram codes, in rank order (ties by code).

    Rows with a null language or text are ignored; an empty table gives no profile. ``labelled`` has one row for
    each training text and may have other columns. All texts are counted.
    """
    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = known.mapInArrow(lean(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= profile)
    found: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "r").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


class RankOrder:
    """Out-of-place distances of documents to fitted profiles."""

    def __init__(self, profiles: dict[str, list[int]], document_grams: int = DOCUMENT_GRAMS):
        self.langs, self.top = sorted(profiles), document_grams
        self.worst = max((len(p) for p in profiles.values()), default=1)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p] or [0], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, max(1, len(self.langs))), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.int64)), j] = np.arange(len(profiles[lang]))

    def score(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """Best language (ties by name) and its closeness: 1 at rank-for-rank agreement, 0 with no n-gram in common."""
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        order = np.lexsort((grams, -counts)) if len(grams) <= self.top else self._leading(grams, counts)
        own = grams[order]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.worst, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.worst)).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.worst * len(own))

    def _leading(self, grams, counts):
        least = np.partition(counts, len(counts) - self.top)[len(counts) - self.top]
        some = np.flatnonzero(counts >= least)
        return some[np.lexsort((grams[some], -counts[some]))][: self.top]


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", document_grams: int = DOCUMENT_GRAMS) -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1); only ``text_col`` is read for it.

    Null texts and texts without letters get ``und`` and 0. All rows and columns stay; columns already named like
    the two outputs are replaced.
    """
    bounded_batches(docs.sparkSession)
    model = RankOrder(profiles, document_grams)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [model.score(g, c) for g, c in gram_counts([t if isinstance(t, str) else None for t in texts.tolist()])]
        release()
        return pd.DataFrame(found, columns=["lang", "score"])

    told = docs.withColumn("__siltstone_lang", predict(F.col(text_col).cast("string")))
    return told.withColumns({lang_out: F.col("__siltstone_lang.lang"), score_out: F.col("__siltstone_lang.score")}).drop("__siltstone_lang")
