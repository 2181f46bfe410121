"""Benchmark decontamination: seeds that no similar passage can lack, then Smith-Waterman alignment.

1. *Seeds.* The words of items and documents (lower-cased, punctuation aside) are paired with the next word and the
   next but one. Each item word is a *place*; a place is hit where one of its pairs stands in a document.
2. *Bound.* In an alignment with ``m`` matched words and ``e`` edits, at most ``e / 2`` of the ``m - 1`` steps from a
   match to the next hold two edits or more; the others are pairs. So at least ``m - 1 - e / 2 = score / 2 - 1``
   places are hit, all within ``e`` diagonals, and a score of ``threshold`` bounds both: a stretch of a document with
   fewer hits can't reach it. Of an item's places as many as the bound allows are not looked up, those whose pairs most
   items hold first.
3. *Alignment.* The item is aligned with each stretch that has enough hits; its score over the score of a full match
   is the similarity. At least ``threshold`` means contaminated. Edited copies (words replaced, dropped, inserted)
   lose a part of it.

The items are the small side: they go to the tasks in blocks of at most ``block_items`` items and ``BLOCK_BYTES`` bytes
(an item beyond that is a block of its own); a larger table takes more passes. The corpus is never shuffled and no pair
of documents is formed. The driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.alignment import MATCH, plain_words, smith_waterman
from siltstone.llm.common import bounded_batches, lean

SEED_WORDS = 3
THRESHOLD = 0.5
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 2_000_000
STEPS = (1, 2)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_WHOLE = np.uint64(0x9FB21C651E98DF25)
_NULL_ITEM = np.iinfo(np.int64).min


def _pairs(hashes: np.ndarray, step: int) -> np.ndarray:
    """Hash of each word with the one ``step`` further on."""
    return W.mix(hashes[:-step] * _PAIR + hashes[step:])


class _Items:
    """A block of test items with their seeds: sorted hashes with the item index and item position of each."""

    def __init__(self, rows: list[tuple[int, str]], seed_words: int, threshold: float):
        self.ids, self.words = [], []
        for item, text in rows:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            hashes, _, _, _ = plain_words(raw, np.array([0, len(raw)], dtype=np.int64))
            if len(hashes):
                self.ids.append(item)
                self.words.append(hashes)
        self.lengths = n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.sizes = sorted({len(w) for w in self.words if len(w) < seed_words})
        least = np.ceil(MATCH * n * threshold - 1e-9).astype(np.int64)
        self.drift = np.where(n < seed_words, 0, MATCH * n - least)  # a score of `least` leaves room for so many edits
        self.need = np.where(n < seed_words, 1, np.maximum(1, (least + 1) // 2 - 1))
        if self.ids:
            self._seeds(seed_words)

    def _seeds(self, seed_words: int) -> None:
        hashes, index, place = [], [], []
        for k, words in enumerate(self.words):
            n = len(words)
            steps = [(W.window_hashes(words, n) ^ _WHOLE, [0])] if n < seed_words else [(_pairs(words, s), np.arange(n - s)) for s in STEPS]
            for grams, at in steps:
                hashes.append(grams)
                index.append(np.full(len(grams), k))
                place.append(at)
        h, i, p = np.concatenate(hashes), np.concatenate(index), np.concatenate(place)
        _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
        spread = counts[which]  # seeds of the block with the same hash
        base = np.cumsum(self.lengths) - self.lengths
        most = np.zeros(int(self.lengths.sum()), dtype=np.int64)
        np.maximum.at(most, base[i] + p, spread)
        keep = np.ones(len(most), dtype=bool)
        for k, (at, n, need) in enumerate(zip(base.tolist(), self.lengths.tolist(), self.need.tolist(), strict=True)):
            spare = need // 2  # of `need` places that are hit, at most so many are among those left out
            keep[at + np.argsort(-most[at : at + n], kind="stable")[:spare]] = False
            self.need[k] -= spare
        kept = keep[base[i] + p]
        order = np.flatnonzero(kept)[np.argsort(h[kept], kind="stable")]
        self.hash, self.item, self.place = h[order], i[order], p[order]


def _positions(texts: pa.Array, sizes: list[int], wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Pieces of a batch: (first row, word offsets, word hashes, [(word index, hash)] of wanted seeds by kind)."""
    data, offsets = W.text_bytes(texts)
    small = np.unique(wanted >> np.uint64(40)).astype(np.int64)
    gate = np.zeros(1 << 24, dtype=bool)
    gate[small] = True
    for a, b in W.pieces(offsets):
        hashes, _, _, word_off = plain_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found = []
        for size, whole in [*((s, True) for s in sizes), *((s + 1, False) for s in STEPS)]:
            index, _ = W.valid_windows(word_off, size)
            if len(index):
                grams = W.window_hashes(hashes, size)[index] ^ _WHOLE if whole else _pairs(hashes, size - 1)[index]
                some = np.flatnonzero(gate[(grams >> np.uint64(40)).astype(np.int64)])
                grams, index = grams[some], index[some]
                at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
                hit = wanted[at] == grams
                found.append((index[hit], grams[hit]))
        yield a, word_off, hashes, found


def _matcher(items: _Items, threshold: float):
    wanted = np.unique(items.hash)

    def stretches(index, grams, word_off) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, end word) of each stretch with enough hits."""
        lo, hi = np.searchsorted(items.hash, grams, "left"), np.searchsorted(items.hash, grams, "right")
        reps = hi - lo
        which = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        where = np.repeat(index, reps)
        item, place = items.item[which], items.place[which]
        begin = where - place
        row = np.searchsorted(word_off, where, side="right") - 1
        order = np.lexsort((place, begin, item, row))
        row, item, begin, place = row[order], item[order], begin[order], place[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] != begin[:-1]) | (place[1:] != place[:-1])
        row, item, begin, place = row[new], item[new], begin[new], place[new]
        # runs of `need` hits within `drift` diagonals; those that overlap form a stretch
        at = np.arange(len(row))
        last = at + items.need[item] - 1
        end = np.minimum(last, len(row) - 1)
        full = np.flatnonzero((last == end) & (row[end] == row) & (item[end] == item) & (begin[end] - begin <= items.drift[item]))
        if not len(full):
            return
        heads = np.concatenate([[0], np.flatnonzero(full[1:] > last[full[:-1]]) + 1])
        tails = np.concatenate([heads[1:], [len(full)]]) - 1
        for a, b in zip(full[heads].tolist(), last[full[tails]].tolist(), strict=True):
            k, extra = int(item[a]), int(items.drift[item[a]])
            if len(np.unique(place[a : b + 1])) >= items.need[k]:
                yield int(row[a]), k, max(int(word_off[row[a]]), int(begin[a]) - extra), min(int(word_off[row[a] + 1]), int(begin[b]) + int(items.lengths[k]) + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in ("id", "item", "score", "start", "end")}
            for first, word_off, hashes, found in _positions(batch.column(1), items.sizes, wanted):
                index, grams = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
                if not len(index):
                    continue
                todo = list(stretches(index, grams, word_off))
                aligned = smith_waterman([items.words[k] for _, k, _, _ in todo], [hashes[a:b] for _, _, a, b in todo])
                best: dict[tuple[int, int], tuple] = {}
                for (row, k, a, _), (score, begin, end) in zip(todo, aligned, strict=True):
                    similar = score / (MATCH * len(items.words[k]))
                    if similar >= threshold and similar > best.get((row, k), (0,))[0]:
                        best[row, k] = similar, a + begin - int(word_off[row]), a + end - int(word_off[row])
                for (row, k), (similar, begin, end) in best.items():
                    for name, value in zip(out, (ids[first + row], items.ids[k], similar, begin, end), strict=True):
                        out[name].append(value)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    seed_words: int = SEED_WORDS,
    threshold: float = THRESHOLD,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Matches of test items in documents: ``id_col``, ``item_id``, ``score`` (0 to 1) and ``start``, ``end`` (words).

    One row for each input row and item with a stretch of at least ``threshold`` similarity: the best one (ties: the
    first). Items of fewer words than ``seed_words`` are sought as they are. No other stretch is missed while
    ``threshold`` times an item's words is more than 1.

    Edge cases: null, empty and wordless texts match nothing, on both sides; items with a null id are reported with
    the least long. Repeated documents and repeated items each give their own rows. Null document ids are reported as
    null. Without items or documents the result is empty. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = items.where(F.col(item_text_col).isNotNull()).select(F.coalesce(F.col(item_id_col).cast("long"), F.lit(int(_NULL_ITEM))).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    found = None
    for block in _blocks(rows, block_items):
        part = _Items(block, seed_words, threshold)
        if not part.ids:
            continue
        one = texts.mapInArrow(lean(_matcher(part, threshold)), "id long, item long, score double, start long, end long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "id long, item long, score double, start long, end long")
    return found.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "score", "start", "end")


def _blocks(rows: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    held = 0
    for r in rows.toLocalIterator():
        own = len(r["text"].encode())
        if block and (len(block) == size or held + own > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append((r["item"], r["text"]))
        held += own
    if block:
        yield block
