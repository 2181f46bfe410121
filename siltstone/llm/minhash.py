"""Near-duplicate groups: universal hash minima, banding, signature verification, exact confirmation, components.

Stages, each on distributed tables:

1. One pass computes each document's shingle set, its size, a 128-bit hash of the set and ``bands * rows`` minima
   of universal hashes ``a * x + b mod 2**32``, folded into one key a band and a 1-bit sketch of 128 minima.
2. Documents with equal sets form a class at once; only one document of a class goes on, so exact copies cost
   nothing more, however many there are.
3. Classes with a band key in common are candidates. In each bucket they are held against one pivot. Buckets in
   which the components leave members apart go on: a document that shares less than the threshold of its shingles
   with all the other members together can't be linked with any of them, and drops out (edited copies of a large
   group do so one by one, not pair by pair). The rest is compared completely: members that buckets connect form a
   cluster, clusters are cut into blocks of ``_BLOCK_SHINGLES``, and a task counts common shingles of one pair of
   blocks over posting lists. It reports one link for each document and other component, never the pairs.
4. A candidate pair becomes a link only if the full shingle sets confirm it.
5. Large-star and small-star turn links into components.

Pairs meet their texts by shuffles. A pivot with many members is dealt to several tasks, each of which streams
its members past the pivot's set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.common import bounded_batches, lean, shared_out, shuffle_partitions, shuffled_joins
from siltstone.llm.components import connected_components
from siltstone.llm.packed import mark, pack, unpacked
from siltstone.scratch import cut, drop

_MEMBERS = 400
_BLOCK_SHINGLES = 400_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the n + 1 offsets into them.

    A text of fewer words than ``size`` has its whole word sequence as one shingle; one without words has none.
    """
    starts, ends, word_off = W.word_spans(data, offsets)
    hashes = W.word_hashes(data, starts, ends, lower=lower)
    n_words = np.diff(word_off)
    index, counts = W.valid_windows(word_off, size)
    counts = np.where((counts == 0) & (n_words > 0), 1, counts)
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], dtype=np.uint64)
    whole = np.repeat(n_words >= size, counts)
    out[whole] = W.window_hashes(hashes, size)[index]
    for n in range(1, size):
        short = np.flatnonzero(n_words == n)
        if len(short):
            out[at[short]] = W.mix(W.window_hashes(hashes, n)[word_off[short]] + np.uint64(n))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][counts > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


def _signatures(size: int, bands: int, rows: int, lower: bool):
    n_hashes = bands * rows
    rng = np.random.default_rng(20_040_613)
    a = rng.integers(0, 1 << 31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = W.text_bytes(batch.column(1))
            for lo, hi in W.pieces(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                sets, at = shingle_sets(part, off, size, lower)
                n = np.diff(at)
                full = np.flatnonzero(n)
                heads = at[:-1][full]
                sums = np.zeros((2, len(n)), dtype=np.uint64)
                minima = np.zeros((n_hashes, len(full)), dtype=np.uint32)
                if len(full):
                    sums[0, full] = np.add.reduceat(sets, heads)
                    sums[1, full] = np.add.reduceat(W.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), heads)
                    x = (sets >> np.uint64(32)).astype(np.uint32)
                    v = np.empty_like(x)
                    for k in range(n_hashes):
                        np.multiply(x, a[k], out=v)
                        np.add(v, b[k], out=v)
                        minima[k] = np.minimum.reduceat(v, heads)
                keys = np.zeros((bands, len(full)), dtype=np.uint64)
                for band in range(bands):
                    for row in range(rows):
                        keys[band] = W.mix(keys[band] * np.uint64(0x9E3779B97F4A7C15) + minima[band * rows + row] + np.uint64(band + 1))
                bits = ((minima ^ (minima >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(31)
                sketch = np.zeros((2, len(n)), dtype=np.uint64)
                for k in range(min(128, n_hashes)):
                    sketch[k // 64, full] |= bits[k].astype(np.uint64) << np.uint64(k % 64)
                lengths = np.zeros(len(n) + 1, dtype=np.int32)
                lengths[1:][full] = bands
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([mark(part[off[i] : off[i + 1]].tobytes()) for i in range(hi - lo)], pa.int32()),
                        pa.array(n, pa.int64()),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array(sketch[0].view(np.int64)),
                        pa.array(sketch[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(keys.T.reshape(-1).view(np.int64))),
                    ],
                    names=["id", "th", "n", "s1", "s2", "m1", "m2", "keys"],
                )

    return run, "id long, th int, n long, s1 long, s2 long, m1 long, m2 long, keys array<long>"


def _confirm(size: int, lower: bool, percent: int):
    """Stream members past the pivot rows that precede them: (p, salt, tag, id, z) sorted to linked (p, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for batch in batches:
            p, salt, tag, ids = (batch.column(i).to_pylist() for i in range(4))
            linked: tuple[list, list] = ([], [])
            for a, b, part, off in unpacked(batch):
                sets, bounds = shingle_sets(part, off, size, lower)
                for i in range(a, b):
                    own = sets[bounds[i - a] : bounds[i - a + 1]]
                    if (p[i], salt[i]) != at:
                        at, pivots = (p[i], salt[i]), []
                    if tag[i] == 0:
                        pivots.append(own)
                        continue
                    for q in pivots:
                        where = np.minimum(np.searchsorted(q, own), len(q) - 1)
                        common = int((q[where] == own).sum())
                        if 100 * common >= percent * (len(q) + len(own) - common):
                            linked[0].append(p[i])
                            linked[1].append(ids[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(linked[0], pa.int64()), pa.array(linked[1], pa.int64())], names=["a", "b"])

    return run


def _exploded(size: int, lower: bool):
    """(id, z) to one row (id, h) for each shingle of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b, part, off in unpacked(batch):
                sets, bounds = shingle_sets(part, off, size, lower)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], np.diff(bounds))), pa.array(sets.view(np.int64))], names=["id", "h"])

    return run


def _alone(ids: DataFrame, texts: DataFrame, size: int, lower: bool) -> DataFrame:
    """(id, alone): how many shingles of each document none of the others in ``ids`` has."""
    rows = texts.join(ids.select("id").distinct(), "id").select("id", "z").mapInArrow(lean(_exploded(size, lower)), "id long, h long")
    return rows.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))


def _block_links(placed: DataFrame, texts: DataFrame, parts: int, size: int, lower: bool, percent: int) -> DataFrame:
    """Links (a, b) between different components of a cluster: (cluster, id, c, blocks, own block) and texts.

    Every pair of blocks of a cluster is one group; a document goes to the ``blocks`` groups with its block.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = placed.withColumn("other", other).join(texts, "id").select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c", "z")
    dealt = rows.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "own", "id")

    def links(group, ids, components, sides, sets):
        """Of each document of the first block, and each other component, the first link into the second block."""
        counts = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), counts)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        component, side = np.array(components), np.array(sides)
        one_block = group[1] == group[2]
        a, b = [], []
        for k in range(len(sets)):
            if not one_block and side[k] != group[1]:
                continue
            lo, hi = np.searchsorted(tokens, sets[k], "left"), np.searchsorted(tokens, sets[k], "right")
            reps = hi - lo
            common = np.bincount(owner[np.repeat(hi - np.cumsum(reps), reps) + np.arange(reps.sum())], minlength=len(sets))
            near = (100 * common >= percent * (counts + counts[k] - common)) & (component != component[k])
            if not one_block:
                near &= side == group[2]
            hits = np.flatnonzero(near)
            _, firsts = np.unique(component[hits], return_index=True)
            a += [ids[k]] * len(firsts)
            b += [ids[h] for h in hits[firsts].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])
        for batch in batches:
            cluster, i, j, own, ids, c = (batch.column(k).to_pylist() for k in range(6))
            for lo, hi, part, off in unpacked(batch):
                sets, bounds = shingle_sets(part, off, size, lower)
                for k in range(lo, hi):
                    if (cluster[k], i[k], j[k]) != at:
                        if held[0]:
                            yield links(at, *held)
                        at, held = (cluster[k], i[k], j[k]), ([], [], [], [])
                    for column, value in zip(held, (ids[k], c[k], own[k], sets[bounds[k - lo] : bounds[k - lo + 1]].copy()), strict=True):
                        column.append(value)
        if held[0]:
            yield links(at, *held)

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _links(pairs: DataFrame, texts: DataFrame, parts: int, size: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (p, x) whose full sets reach the threshold, as edges (a, b)."""
    crowd = cut(pairs.groupBy("p").agg(F.count("*").alias("of"), F.ceil(F.count("*") / F.lit(_MEMBERS)).alias("salts")))
    dealt = shared_out(pairs, crowd, ["p"], "of", ["x"]).select("p", "x", F.expr("cast(pmod(xxhash64(x), salts) as int)").alias("salt"))
    members = dealt.join(texts, dealt.x == texts.id).select("p", "salt", F.lit(1).alias("tag"), "id", "z")
    heads = dealt.select("p", "salt").distinct()
    pivots = heads.join(texts, heads.p == texts.id).select("p", "salt", F.lit(0).alias("tag"), "id", "z")
    rows = pivots.unionByName(members).repartition(parts, "p", "salt").sortWithinPartitions("p", "salt", "tag")
    return rows.mapInArrow(lean(_confirm(size, lower, percent)), "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, bands: int, rows: int, lower: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: signatures of all rows, classes of equal sets, components (node, component) of linked classes."""
    parts = shuffle_partitions(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _signatures(shingle_words, bands, rows, lower)
    signed = cut(plain.mapInArrow(lean(run), schema), "signed")

    usable = signed.where("n > 0 and id is not null")
    classes = cut(usable.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "th", "m1", "m2", "keys")).alias("r")).select("s1", "s2", "n", "r.*"), "classes")
    owned = usable.select("id", "s1", "s2", "n").join(classes.select("s1", "s2", "n", F.col("id").alias("rep")), ["s1", "s2", "n"]).select("id", "rep")
    clashes = owned.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared_ids = cut(owned.join(clashes.select("id"), "id").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())

    keyed = classes.select("id", F.explode("keys").alias("key"))
    firsts = cut(keyed.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("last"), F.count("*").alias("of")).where("p < last").select("key", "p", "of"))
    buckets = cut(shared_out(keyed, firsts, ["key"], "of", ["id"]).select("key", "id", "p"), "buckets")
    drop(firsts)

    facts = classes.select("id", "th", "n", "m1", "m2")
    chosen = facts.join(buckets.select("id").distinct(), "id").select("id", "th").distinct()
    packed = plain.mapInArrow(lean(pack), "id long, th int, no_id boolean, z binary")
    texts = cut(packed.join(chosen, ["id", "th"], "left_semi").select("id", "z"), "near-texts")

    n_bits = min(128, bands * rows)
    off = (1 - percent / 100) / 2
    allowed = int(n_bits * off + 6 * math.sqrt(n_bits * off * (1 - off)))
    x, p = facts.select(*(F.col(c).alias(f"x_{c}") for c in facts.columns)), facts.select(*(F.col(c).alias(f"p_{c}") for c in facts.columns))
    near = f"100 * least(x_n, p_n) >= {percent} * greatest(x_n, p_n) and bit_count(x_m1 ^ p_m1) + bit_count(x_m2 ^ p_m2) <= {allowed}"

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs (p, x) that pass the size bound and the sketch."""
        known = pairs.distinct().join(x, F.col("x") == F.col("x_id")).drop("x_id")
        pivots = cut(known.groupBy("p").agg(F.count("*").alias("of")).join(p, F.col("p") == F.col("p_id")).drop("p_id"))
        return shared_out(known, pivots, ["p"], "of", ["x"]).where(near).select("p", "x").distinct()

    def still(members: DataFrame) -> DataFrame:
        """Members of buckets in which several components are left."""
        mixed = members.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("of")).where("c0 < c1").select("key", "of")
        return shared_out(members, cut(mixed), ["key"], "of", ["id"])

    pairs = cut(candidates(buckets.where("id <> p").select("p", F.col("id").alias("x"))))
    edges = cut(shared_ids.unionByName(_links(pairs, texts, parts, shingle_words, lower, percent)), "edges")
    drop(pairs, shared_ids)
    labels = connected_components(edges)
    told = buckets.join(labels, buckets.id == labels.node, "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    left = cut(still(told), "left")
    drop(buckets)
    if left.head(1):
        sizes = facts.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("sets"))
        rare = _alone(left, texts, shingle_words, lower).join(sizes, "id")
        hopeless = rare.where(f"sets = 1 and 100 * (n - alone) < {percent} * n").select("id")
        wider, left = left, cut(still(left.join(hopeless, "id", "left_anti")), "left")
        drop(wider)
    if left.head(1):
        first = cut(left.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("of")))
        cluster = connected_components(shared_out(left, first, ["key"], "of", ["id"]).select("a", F.col("id").alias("b")))
        members = left.select("id", "c").distinct().join(cluster, F.col("id") == F.col("node")).select("id", "c", F.col("component").alias("cluster")).join(sizes.select("id", "n"), "id")
        blocks = members.groupBy("cluster").agg(F.expr(f"cast(ceil(sum(n) / {_BLOCK_SHINGLES}) as int)").alias("blocks"))
        placed = cut(members.join(blocks, "cluster").select("cluster", "id", "c", "blocks", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("own")))
        fewer, edges = edges, cut(edges.unionByName(_block_links(placed, texts, parts, shingle_words, lower, percent)), "edges")
        drop(cluster, placed, fewer, labels)
        labels = connected_components(edges)
    drop(left, texts, edges)
    return signed, classes, labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, lower: bool = True
) -> DataFrame:
    """Groups of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns one row for each input row: ``id_col``, ``n_shingles``, ``component_id`` (least id reachable over links,
    itself included) and ``kept`` (the document is its group's least id). The set of a text has its distinct
    ``shingle_words``-word runs; ``lower`` folds A-Z. A pair at the threshold misses all bands with probability
    ``(1 - (percent / 100) ** rows) ** bands`` (3e-6 by default).

    Edge cases: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer words
    has one shingle. Rows with a null id are linked with nothing, get a null component and are kept. Rows that share
    an id are one node: links of any of their texts count for all of them. Ids are integers. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with shuffled_joins(spark):
        signed, classes, labels = _grouped(docs, id_col, text_col, shingle_words, percent, bands, rows, lower)
    reps = classes.join(labels.hint("merge"), classes.id == labels.node, "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    own = signed.select("id", "n", "s1", "s2").join(reps.hint("merge"), ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
