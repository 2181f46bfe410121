"""Word alignments over hashed words, vectorised over many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from siltstone.llm import words as W

MATCH, MISMATCH, GAP = 2, -1, -1
_CELLS = 4_000_000


def plain_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with ASCII punctuation as blanks, so that words compare by their letters and digits."""
    return _PLAIN[data]


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 32
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _PLAIN[_c] = 0x20


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start bytes and end bytes of the plain words, and the n + 1 offsets of texts into them."""
    plain = plain_bytes(data)
    starts, ends, word_off = W.word_spans(plain, offsets)
    return W.word_hashes(plain, starts, ends), starts, ends, word_off


def smith_waterman(queries: list[np.ndarray], targets: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """Best local alignment of each query with its target: (score, start, end) with the target interval [start, end).

    Match 2, mismatch -1, gap -1 a word. Ties take the alignment that ends first; a start is that of the cell's best
    path (diagonal before gaps). Pairs are padded to the longest of a batch; batches hold a bounded number of cells.
    """
    order = sorted(range(len(queries)), key=lambda k: (len(queries[k]), len(targets[k])))
    found: list = [(0, 0, 0)] * len(queries)
    at = 0
    while at < len(order):
        batch = [order[at]]
        while at + len(batch) < len(order):
            k = order[at + len(batch)]
            if (len(batch) + 1) * max(len(targets[i]) for i in (*batch[-1:], k)) > _CELLS // 64:
                break
            batch.append(k)
        at += len(batch)
        for k, best in zip(batch, _batch([queries[k] for k in batch], [targets[k] for k in batch]), strict=True):
            found[k] = best
    yield from found


def _batch(queries: list[np.ndarray], targets: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    n, rows, cols = len(queries), max(map(len, queries)), max(max(map(len, targets)), 1)
    q, t = np.zeros((n, rows), dtype=np.uint64), np.ones((n, cols), dtype=np.uint64)
    q_len, t_len = np.array([len(x) for x in queries]), np.array([len(x) for x in targets])
    for i, (x, y) in enumerate(zip(queries, targets, strict=True)):
        q[i, : len(x)], t[i, : len(y)] = x, y
    column = np.arange(cols)
    inside = column[None, :] < t_len[:, None]
    lanes = np.arange(n)
    score, begin = np.zeros((n, cols), dtype=np.int32), np.tile(column, (n, 1))
    best, best_end, best_begin = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(rows):
        live = (i < q_len)[:, None] & inside
        step = np.where((q[:, i : i + 1] == t) & live, MATCH, MISMATCH)
        diagonal = np.concatenate([np.zeros((n, 1), dtype=np.int32), score[:, :-1]], axis=1)
        origin = np.concatenate([np.zeros((n, 1), dtype=begin.dtype), begin[:, :-1]], axis=1)
        origin = np.where(diagonal > 0, origin, column)
        value = diagonal + step
        up = score + GAP
        from_up = up > value
        value, origin = np.where(from_up, up, value), np.where(from_up, begin, origin)
        low = value <= 0
        value, origin = np.where(low, 0, value), np.where(low, column + 1, origin)
        lifted = value - GAP * column  # gaps along the target: a running maximum with its position
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == top, column, 0), axis=1)
        source = np.where(lifted == top, column, source)
        score = np.maximum(np.where(live, top + GAP * column, 0), 0).astype(np.int32)
        begin = np.take_along_axis(origin, source, axis=1)
        end = np.argmax(score, axis=1)
        peak = score[lanes, end]
        better = peak > best
        best[better], best_end[better], best_begin[better] = peak[better], end[better] + 1, begin[lanes, end][better]
    for x in zip(best.tolist(), best_begin.tolist(), best_end.tolist(), strict=True):
        yield x


def banded(query: np.ndarray, target: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int]:
    """Local alignment of ``query`` with ``target`` around the diagonal ``target = query + shift``.

    Returns (matched words, start, end, score) with the target interval [start, end). Cells further than ``band``
    from the diagonal are never touched: len(query) * (2 * band + 1) cells in all.
    """
    width = 2 * band + 1
    offset = np.arange(width) - band
    score, matched, begin = (np.zeros(width + 1, dtype=np.int64) for _ in range(3))
    begin[:] = 0
    best = (0, 0, 0, 0)
    for i in range(len(query)):
        column = i + shift + offset
        ok = (column >= 0) & (column < len(target))
        same = ok & (target[np.clip(column, 0, max(len(target) - 1, 0))] == query[i]) if len(target) else np.zeros(width, dtype=bool)
        fresh = score[:width] <= 0
        value = np.where(fresh, 0, score[:width]) + np.where(same, MATCH, MISMATCH)
        hits = np.where(fresh, 0, matched[:width]) + same
        origin = np.where(fresh, column, begin[:width])
        up = score[1 : width + 1] + GAP  # the target cell above lies one place further right in the band
        better = up > value
        value, hits, origin = np.where(better, up, value), np.where(better, matched[1 : width + 1], hits), np.where(better, begin[1 : width + 1], origin)
        value = np.where(ok, value, 0)
        lifted = value - GAP * offset
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width), 0))
        value, hits, origin = np.maximum(top + GAP * offset, 0), hits[source], origin[source]
        value = np.where(ok, value, 0)
        score[:width], matched[:width], begin[:width] = value, hits, origin
        k = int(np.argmax(value))
        if value[k] > best[3]:
            best = (int(hits[k]), int(origin[k]), int(column[k]) + 1, int(value[k]))
    return best
