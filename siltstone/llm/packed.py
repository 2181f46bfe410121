"""Compressed texts in shuffles: whole texts, about half the bytes of Spark's own codec."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from siltstone.llm.words import PIECE_BYTES

NULL_ID = np.iinfo(np.int64).max


def mark(text: bytes) -> int:
    """A 32-bit hash that tells apart rows with one id and different texts."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little", signed=True)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, th, no_id, z): null ids as the largest long, text hash, compressed text (null stays)."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        raw = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pc.fill_null(ids, int(NULL_ID)),
                pa.array([mark(r or b"") for r in raw], pa.int32()),
                ids.is_null(),
                pa.array([None if r is None else press.compress(r) for r in raw], pa.binary()),
            ],
            names=["id", "th", "no_id", "z"],
        )


def unpacked(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, bytes, offsets) of the compressed texts in column z; nulls as empty texts."""
    open_up = zstandard.ZstdDecompressor()
    column = batch.column(batch.schema.get_field_index("z"))
    rows, size, a = [], 0, 0
    for i, z in enumerate(column):
        z = z.as_buffer()
        raw = b"" if z is None or z.size == 0 else open_up.decompress(z)
        rows.append(raw)
        size += len(raw)
        if size >= limit or i == len(column) - 1:
            offsets = np.zeros(len(rows) + 1, dtype=np.int64)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            yield a, i + 1, np.frombuffer(b"".join(rows), dtype=np.uint8), offsets
            rows, size, a = [], 0, i + 1
