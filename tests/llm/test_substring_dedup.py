import random
import re

import pytest

from siltstone.llm.substring_dedup import remove_repeats
from tests.llm.conftest import prose


def expected(rows, window):
    """Brute force; rows are (id, text), ids distinct."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone |= set(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    vocabulary = "abcdefg"[: 3 + 2 * seed]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in rng.sample(range(-50, 500), 40):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(40))] + passage[rng.randrange(20) :] * rng.randrange(3) + [rng.choice(vocabulary) for _ in range(rng.randrange(20))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    got = remove_repeats(documents(rows).repartition(5), window=6, seed_words=3, buckets=8).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == expected(rows, 6)
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_awkward_rows(spark, documents, awkward):
    got = remove_repeats(documents(awkward, clashing=True), window=20)
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept_text"]
    rows = got.collect()
    assert len(rows) == len(awkward)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[1] == by[2] == by[3] == [(0, 0)] and by[4] == [(60, 0)] and by[5] == [(60, 60), (60, 60)]
    assert sorted(by[None]) == [(0, 0), (60, 60)] and by[6] == [(40, 0), (40, 0)] and by[8] == [(30_001, 30_000)]


def test_empty_table_and_one_document(spark, documents):
    assert remove_repeats(documents([])).collect() == []
    text = prose(9, 25)
    (row,) = remove_repeats(documents([(1, f"{text} between {text}")])).collect()
    assert row.n_removed == 25 and row.kept_text == f"{text} between"


def test_ranges_grow_with_the_input(spark, documents, monkeypatch, tmp_path):
    from siltstone.llm import substring_dedup

    rows = [(k, f"{prose(k, 30)} {prose(1, 25)} {prose(2000 + k, 10)}") for k in range(60)]
    documents(rows).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert substring_dedup.ranges_for(docs) == substring_dedup.BUCKETS
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 4)
    assert substring_dedup.ranges_for(docs) > substring_dedup.BUCKETS
    got = remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == expected(rows, 20)


def test_equal_hashes_need_a_second_hash():
    """Entries with one window hash and different second hashes are different windows."""
    import numpy as np

    from siltstone.llm.substring_dedup import _ENTRY, resolve

    entries = np.zeros(5, dtype=_ENTRY)
    entries["h"], entries["g"], entries["doc"], entries["pos"] = 7, [1, 2, 1, 2, 3], [4, 1, 2, 3, 9], 0
    keep, flags, _ = resolve(entries, earliest=True)
    assert sorted(entries["doc"][keep].tolist()) == [1, 2, 9] and sorted(entries["doc"][flags].tolist()) == [3, 4]
