"""Vectorised word access over Arrow string batches.

A *word* is a maximal run of characters outside ``\\x20`` and ``\\x09-\\x0D``. All six separators are
single ASCII bytes, so words are found on the UTF-8 bytes without decoding. Every function works on one
Arrow batch at a time and never loops over words in Python; memory is bounded by cutting a batch into
pieces of about ``PIECE_BYTES`` (a single longer text forms its own piece).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection that spreads every input bit)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        keep = {"up": np.multiply.accumulate(up), "down": np.multiply.accumulate(down)}
        if size > 4 * PIECE_BYTES:  # made for one very long text; not worth keeping
            return keep["up"], keep["down"]
        _powers.update(keep)
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (nulls as empty) and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) that hold about ``limit`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 offsets of texts into the words."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes; ``lower`` folds A-Z first."""
    up, down = _power_tables(len(data) + 1)
    codes = _BYTE_CODE[_LOWER[data]] if lower else _BYTE_CODE[data]
    codes *= up[: len(data)]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes, out=total[1:])
    out = total[ends] - total[starts]
    out *= down[starts]
    return mix(out)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp value of every ``size`` consecutive entries, mod 2**64 and mixed (len - size + 1 values)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # Horner by doubling: `have` holds windows of `width` entries, `out` those of the bits of `size` seen so far.
    out, done, have, width, power = None, 0, hashes, 1, int(_WORD_BASE)
    while True:
        if size & width:
            if out is None:
                out, done = have.copy(), width
            else:
                out = out[: len(hashes) - done - width + 1] * np.uint64(power) + have[done : done + len(hashes) - done - width + 1]
                done += width
        if done == size:
            return mix(out[:n])
        m = len(have) - width
        have = have[:m] * np.uint64(power) + have[width : width + m]
        power, width = power * power & 0xFFFFFFFFFFFFFFFF, width * 2


def valid_windows(word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each window's first word, and each text's number of windows (those inside one text)."""
    counts = np.maximum(np.diff(word_offsets) - size + 1, 0)
    if not counts.sum():
        return np.zeros(0, dtype=np.int64), counts
    base = np.repeat(word_offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(counts.sum()), counts
