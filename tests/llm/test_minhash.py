import random
import re

import pytest

from siltstone.llm import minhash
from siltstone.llm.components import connected_components
from siltstone.llm.minhash import near_duplicates
from tests.llm.conftest import prose


def expected(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    part = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i], part[i] == i) for i in ids}


def told(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(12):
        base = prose(100 * seed + g, rng.randrange(3, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            words = [rng.choice("xyz") if rng.random() < rng.choice([0, 0.01, 0.03, 0.08]) else w for w in base]
            rows.append((i, rng.choice([" ", "\n"]).join(words).title() if i % 3 else " ".join(words)))
            i += 1
    rng.shuffle(rows)
    assert told(near_duplicates(documents(rows).repartition(3), shingle_words=3, percent=85, bands=25, rows=5)) == expected(rows, 3, 85)


def test_one_large_group_that_falls_apart(spark, documents, monkeypatch):
    """Edited copies of one text: many pairs below the threshold, pivots with members in several tasks."""
    monkeypatch.setattr(minhash, "_MEMBERS", 5)
    monkeypatch.setattr(minhash, "_BLOCK_SHINGLES", 1200)
    rng = random.Random(5)
    base = prose(77, 150).split()
    rows = [(k, " ".join(rng.choice("xyz") if rng.random() < 0.02 else w for w in base)) for k in range(60)]
    assert told(near_duplicates(documents(rows), shingle_words=3, percent=85, bands=40, rows=4)) == expected(rows, 3, 85)


def test_awkward_rows(spark, documents, awkward):
    got = near_duplicates(documents(awkward, clashing=True), shingle_words=3, percent=85, bands=25)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = got.collect()
    assert len(rows) == len(awkward)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[5] == [(58, 4, False)] * 2 and by[8][0][1] == 7
    assert sorted(by[None]) == [(0, None, True), (58, None, True)] and by[101] == [(1, 101, True)] and by[103] == [(1, 103, True)]
    assert near_duplicates(documents([])).collect() == []


def test_ids_with_two_texts_connect_both(spark, documents):
    a, b = prose(11, 50), prose(12, 50)
    got = told(near_duplicates(documents([(1, a), (2, a), (2, b), (3, b)]), shingle_words=3, percent=85))
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (200, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
