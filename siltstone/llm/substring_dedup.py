"""Exact removal of repeated word windows (substring deduplication).

Every window of ``window`` consecutive words has a Rabin-Karp hash; all windows with one hash are brought
together in Spark, the first of them in (document id, position) order stays and the words of the others go.
Removed windows merge into maximal intervals.

Most windows of a corpus occur once, and shipping all of their hashes would move several times the input. So
the work has two rounds over the same distributed pattern:

1. *Seeds.* Of the ``seed_words``-word hashes inside a window the smallest one is its seed. Equal windows have
   equal seeds, so a window whose seed is found in one place only can't repeat. Seeds are a small part of all
   positions; they are counted first.
2. *Windows.* The full hash of each window with a repeated seed is compared.

Skew: within a task, equal hashes are resolved before anything is shuffled. A hash therefore leaves a task
once for each ``FLUSH`` windows, however many documents share it, and no reducer sees a group larger than the
number of flushes. Nothing is dropped or capped. Everything is plain lineage: a lost executor costs a recomputation.

Windows are equal if two independent hashes are, 96 bits together: among n windows about n**2 / 2**97 pairs are taken
for equal and aren't (0.0006 for 10**13 windows, some 100 TB of text). Seeds have 64 bits; a collision of seeds only
makes a window a candidate.

The number of hash ranges grows with the input, so a task holds about ``RANGE_BYTES`` of entries at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.common import bounded_batches, lean, shuffle_partitions
from siltstone.llm.packed import NULL_ID, mark, pack, unpacked

FLUSH = 1_000_000
WITNESS = 0xFFFFFFFF  # stands for a position that was flagged before
_SEED = np.dtype([("h", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("pos", "<u4")])
_ENTRY = np.dtype([*_SEED.descr, ("g", "<u4")])
BUCKETS = 1024
RANGE_BYTES = 64 << 20
_OTHER = np.uint64(0x2545F4914F6CDD1D)


def ranges_for(docs: DataFrame, least: int = BUCKETS) -> int:
    """Hash ranges for an input: ``least``, or one for each ``RANGE_BYTES`` of what Spark expects to read.

    A word of about six bytes gives up to one entry in eight words; tables compress to about a third. Together a range
    of entries is about as large as its part of the files. Where Spark has no size the texts are counted.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.lit(1)).alias("n")).first()["n"] or 0
        size *= 4096
    return min(1 << 20, max(least, -(-size // RANGE_BYTES)))


def _seeds(hashes: np.ndarray, seed_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every seed-length run, and for each window the index of its smallest one (leftmost of equals)."""
    runs = W.window_hashes(hashes, seed_words)
    span = window - seed_words + 1
    if len(runs) < span:
        return runs, np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << 20) - 1)
    ranked = (runs & ~low) | (np.arange(len(runs), dtype=np.uint64) & low)
    least, width = ranked, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    n = len(runs) - span + 1
    least = np.minimum(least[:n], least[span - width : span - width + n])
    start = np.arange(n, dtype=np.int64)
    return runs, start + (((least & low).astype(np.int64) - start) & int(low))


class _Sender:
    """Gathers entries and ready flags of a map task and yields them as (bucket, kind, doc, th, blob) rows."""

    def __init__(self, buckets: int, earliest: bool):
        self.buckets, self.earliest, self.held, self.n = buckets, earliest, [], 0
        self.kind = _ENTRY if earliest else _SEED

    def add(self, h, doc, th, pos, g=None) -> Iterator[pa.RecordBatch]:
        if len(h):
            entry = np.empty(len(h), dtype=self.kind)
            entry["h"], entry["doc"], entry["th"], entry["pos"] = h, doc, th, pos
            if g is not None:
                entry["g"] = g
            self.held.append(entry)
            self.n += len(h)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        entries = np.concatenate(self.held)
        self.held, self.n = [], 0
        keep, flags, known = resolve(entries, self.earliest)
        if self.earliest:
            sent = entries[keep]
        else:  # one witness for each hash that is already known to repeat; its position is flagged here
            sent = entries[keep].copy()
            sent["pos"][known] = WITNESS
        bucket = ((sent["h"] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        sent, bucket = sent[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sent)]])
        yield _rows([int(b) for b in bucket[starts]], None, [_planes(sent[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        yield from flag_rows(entries[flags], self.buckets)


def _planes(entries: np.ndarray) -> bytes:
    """The entries byte by byte, all first bytes before all second ones: high bytes are alike and take no room in a shuffle."""
    return np.ascontiguousarray(entries.view(np.uint8).reshape(len(entries), entries.itemsize).T).tobytes()


def _entries(blob: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _rows(buckets, owners, blobs) -> pa.RecordBatch:
    doc, th = owners if owners is not None else ([None] * len(blobs), [None] * len(blobs))
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(doc, pa.int64()), pa.array(th, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "doc", "th", "blob"])


def flag_rows(entries: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each document of the entries, with the flagged positions."""
    if not len(entries):
        return
    entries = entries[np.lexsort((entries["pos"], entries["th"], entries["doc"]))]
    doc, th, raw = entries["doc"], entries["th"], entries["pos"].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(th) != 0)) + 1])
    ends = np.concatenate([starts[1:], [len(doc)]])
    where = (W.mix(doc[starts].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64).tolist()
    yield _rows(where, (doc[starts], th[starts]), [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def resolve(entries: np.ndarray, earliest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of one entry to pass on for each hash, of the flagged entries, and which of the former are known to repeat.

    ``earliest``: the first place of a hash passes and all other places are flagged; else every place of a hash
    with more than one is flagged. The same place twice (a row that is there twice) is one place.
    """
    hashes = [entries[name] for name in ("h", "g") if name in entries.dtype.names]
    order = np.lexsort((entries["pos"], entries["th"], entries["doc"], *reversed(hashes)))
    e = entries[order]
    new_hash = np.ones(len(e), dtype=bool)
    new_hash[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in hashes])
    heads = np.flatnonzero(new_hash)
    group = np.cumsum(new_hash) - 1
    same = (e["doc"] == e["doc"][heads][group]) & (e["th"] == e["th"][heads][group]) & (e["pos"] == e["pos"][heads][group])
    if earliest:
        return order[heads], order[~same], np.zeros(len(heads), dtype=bool)
    repeated = np.bincount(group[~same], minlength=len(heads)) > 0
    return order[heads], order[repeated[group]], repeated


def _reduce(earliest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            e = np.concatenate([_entries(blob, _ENTRY if earliest else _SEED) for blob in held])
            held.clear()
            if earliest:
                yield _places(e[resolve(e, True)[1]])
                return
            _, inverse = np.unique(e["h"], return_inverse=True)
            witness = np.bincount(inverse, weights=e["pos"] == WITNESS) > 0
            several = np.zeros(len(e), dtype=bool)
            several[resolve(e, False)[1]] = True
            yield _places(e[(several | witness[inverse]) & (e["pos"] != WITNESS)])

        for batch in batches:
            for bucket, doc, th, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    yield from close()
                    at = bucket
                if doc is None:
                    held.append(blob)
                else:
                    known = np.empty(len(blob) // 4, dtype=_ENTRY)
                    known["doc"], known["th"], known["pos"] = doc, th, np.frombuffer(blob, dtype="<u4")
                    yield _places(known)
        yield from close()

    return run


def _places(entries: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(entries["doc"])), pa.array(np.ascontiguousarray(entries["th"])), pa.array(entries["pos"].astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "th", "pos"])


_ROW = "bucket int, doc long, th int, blob binary"


def _resolved(mapped: DataFrame, parts: int, earliest: bool) -> DataFrame:
    """Bring equal hashes together and return (doc, th, places): the flagged positions of each document."""
    dealt = mapped.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(_reduce(earliest)), "doc long, th int, pos int").groupBy("doc", "th").agg(F.collect_list("pos").alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed_words: int = 6, buckets: int | None = None) -> DataFrame:
    """Remove every word covered by a ``window``-word run that starts earlier in the corpus.

    Earlier means a smaller id, or the same document at an earlier word; windows are judged on the input.
    Returns one row for each input row: ``id_col``, ``n_words``, ``n_removed``, ``spans`` (removed word intervals
    ``[start, end)``, maximal and in order) and ``kept_text`` (kept words joined by one space).

    ``buckets`` is the number of hash ranges that are compared one at a time (None: by the size of the input): a task
    holds one range's entries, 28 bytes for each repeated-seed window of the corpus divided by ``buckets``.

    Edge cases: a null or blank text has no words and keeps the empty text; a text shorter than the window keeps
    all words. Rows with a null id come after all others. Rows with equal id and text are one document and get the
    same answer; rows with equal id and different texts are different documents in an arbitrary but fixed order.
    Ids are integers. Other columns of the input are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    if buckets is None:
        buckets = ranges_for(docs.select(id_col, text_col))

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(pack), "id long, th int, no_id boolean, z binary").withColumnRenamed("id", "doc")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets, earliest=False)
        for batch in batches:
            doc, raw = batch.column(0).cast(pa.int64()), batch.column(1)
            data, offsets = W.text_bytes(raw)
            doc = np.asarray(pc.fill_null(doc, int(NULL_ID)))
            for a, b in W.pieces(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, word_off = W.word_spans(part, off)
                index, counts = W.valid_windows(word_off, window)
                if not len(index):
                    continue
                marks = np.array([mark(part[off[i] : off[i + 1]].tobytes()) if counts[i] else 0 for i in range(b - a)], dtype=np.int32)
                runs, least = _seeds(W.word_hashes(part, starts, ends), seed_words, window)
                chosen = np.unique(least[index])
                row = np.searchsorted(word_off, chosen, side="right") - 1
                yield from out.add(runs[chosen], doc[a:b][row], marks[row], chosen - word_off[row])
        yield from out.flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets, earliest=True)
        for batch in batches:
            doc, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            places = batch.column(3)
            for a, b, part, off in unpacked(batch):
                starts, ends, word_off = W.word_spans(part, off)
                index, counts = W.valid_windows(word_off, window)
                if not len(index):
                    continue
                hashes = W.word_hashes(part, starts, ends)
                _, least = _seeds(hashes, seed_words, window)
                seeded = np.zeros(len(hashes) + 1, dtype=bool)
                for i in range(a, b):
                    seeded[word_off[i - a] + places[i].values.to_numpy()] = True
                index = index[seeded[least[index]]]
                row = np.searchsorted(word_off, index, side="right") - 1
                other = W.window_hashes(W.mix(hashes ^ _OTHER), window)[index] >> np.uint64(32)
                yield from out.add(W.window_hashes(hashes, window)[index], doc[a:b][row], th[a:b][row], index - word_off[row], other)
        yield from out.flush()

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(4)
            for a, b, part, off in unpacked(batch):
                starts, ends, word_off = W.word_spans(part, off)
                edge = np.zeros(len(starts) + window + 1, dtype=np.int32)
                for i in range(a, b):
                    if places[i].is_valid:
                        p = np.unique(places[i].values.to_numpy()) + word_off[i - a]
                        edge[p] += 1
                        edge[p + window] -= 1
                gone = np.cumsum(edge)[: len(starts)] > 0
                text, text_off = joined(part, starts, ends, word_off, ~gone)
                removed = np.concatenate([[0], np.cumsum(gone)])[word_off]
                spans = _spans(gone, word_off)
                ids = pa.array(np.asarray(batch.column(0))[a:b], mask=np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool)[a:b])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(word_off), pa.int64()), pa.array(np.diff(removed), pa.int64()), spans, _strings(text, text_off)],
                    names=["id", "n_words", "n_removed", "spans", "kept_text"],
                )

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = packed.repartition(parts, "doc", "th")
    seeded = _resolved(plain.mapInArrow(lean(seeds), _ROW), parts, earliest=False)
    candidates = texts.join(seeded, ["doc", "th"]).select("doc", "th", "z", "places")
    repeated = _resolved(candidates.mapInArrow(lean(windows), _ROW), parts, earliest=True)
    marked = texts.join(repeated, ["doc", "th"], "left").select("doc", "th", "no_id", "z", "places")
    out = marked.mapInArrow(lean(cut_out), "id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")
    return out.withColumnRenamed("id", id_col)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_off: np.ndarray, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each text joined by one space: bytes and n + 1 offsets."""
    s, e = starts[keep], ends[keep]
    kept_off = np.concatenate([[0], np.cumsum(keep)])[word_off]
    sizes = e - s + 1
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(after) else 0
    source = np.repeat(s - (after - sizes), sizes) + np.arange(total)
    if len(after):
        source[after - 1] = 0
    text = data[source] if total else np.zeros(0, dtype=np.uint8)
    if len(after):
        text[after - 1] = 0x20
    bounds = np.concatenate([[0], after])[kept_off]
    whole = np.diff(kept_off) > 0
    tails = bounds[1:][whole] - 1  # no space after a text's last word
    mask = np.ones(total, dtype=bool)
    mask[tails] = False
    less = np.concatenate([[0], np.cumsum(whole)])
    return text[mask].tobytes(), bounds - less


def _strings(text: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())


def _spans(gone: np.ndarray, word_off: np.ndarray) -> pa.Array:
    flag = np.concatenate([[False], gone, [False]])
    fresh = np.zeros(len(gone) + 1, dtype=bool)  # intervals end with their text
    fresh[word_off] = True
    begin = np.flatnonzero(gone & (~flag[:-2] | fresh[:-1]))
    end = np.flatnonzero(gone & (~flag[2:] | fresh[1:])) + 1
    row = np.searchsorted(word_off, begin, side="right") - 1
    counts = np.searchsorted(begin, word_off)
    pairs = pa.StructArray.from_arrays([pa.array(begin - word_off[row], pa.int64()), pa.array(end - word_off[row], pa.int64())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs)
