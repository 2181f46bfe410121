"""Licence scan: telling phrases, repeated notices, and every template aligned with the whole text."""

import random

import numpy as np

from siltstone.llm.alignment import banded
from siltstone.llm.licenses import BAND, MIN_COVERAGE, SHORT_COVERAGE, SHORT_WORDS, TELLING, TEMPLATES, VERSIONS, Index, _best, _holds, _plain, scan_licenses
from tests.llm.conftest import prose


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {k: [] for k in range(len(texts))}
    for r in scan_licenses(df).collect():
        out[r.doc_id].append((r.start_word, r.license))
    return [[name for _, name in sorted(v)] for v in out.values()]


def test_notices_of_other_licences(spark):
    texts = ["Licensed under the terms of the Acme license", "This work is licensed under the GNU General Public License, version 1.", "Licensed under the Microsoft Public License, version 2.0.", "She criticised the MIT license in a talk", "This work is licensed under the GNU Acme General Public Licence"]
    assert found(spark, texts) == [[], [], [], [], []]


def test_repeated_notices(spark):
    line, other = "Released under the MIT License.", "Licensed under CC BY 4.0."
    texts = [f"{line}\n{line}", f"{line} {prose(1, 8)} {line} {other} {line}", "\n".join([line] * 30), f"{other} {other.replace('BY', 'BY-SA')} {other}"]
    assert found(spark, texts) == [["MIT"] * 2, ["MIT", "MIT", "CC-BY-4.0", "MIT"], ["MIT"] * 30, ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-4.0"]]


def test_every_template_is_itself(spark):
    assert [x[0] for x in found(spark, [f"{prose(k, 20)} {text} {prose(k + 1, 20)}" for k, (_, text) in enumerate(TEMPLATES)])] == [name for name, _ in TEMPLATES]


def test_against_alignment_with_every_template(spark):
    """Small texts with one or two notices, some words changed: the index loses none that a whole alignment finds."""
    rng = random.Random(5)
    index = Index(TEMPLATES, TELLING, VERSIONS)
    texts = []
    for k in range(60):
        parts = [prose(k, 12)]
        for name, text in rng.sample(TEMPLATES, 1 + k % 2):
            words = text.split()
            for _ in range(len(words) // 9):
                words[rng.randrange(len(words))] = rng.choice(["zz", "", "zz yy"])
            parts += [" ".join(words), prose(k + 100, 40)]
        texts.append(" ".join(parts))
    want = []
    for text in texts:
        words, _ = _plain([text])
        hits = []
        for t, query in enumerate(index.words):
            need = max(MIN_COVERAGE, SHORT_COVERAGE) if len(query) < SHORT_WORDS else MIN_COVERAGE
            spans = [(0, len(words))]
            while spans:
                a, b = spans.pop()
                if b - a < 2:
                    continue
                matched, start, end, _ = banded(query, words[a:b], 0, max(b - a, len(query)))
                if matched >= need * len(query) and all(any(_holds(words[a + start : a + end], p) for p in group) for group in index.phrases[t]):
                    hits.append((matched / len(query), matched, a + start, a + end, t))
                    spans += [(a, a + start), (a + end, b)]
        want.append([index.names[x[4]] for x in _best(hits)])
    got = found(spark, texts)
    assert got == want and sum(map(len, want)) > 60


def test_phrases_stand_word_by_word():
    words = np.array([1, 2, 3, 4], dtype=np.uint64)
    assert _holds(words, words[1:3]) and not _holds(words, words[[0, 2]]) and not _holds(words[:1], words) and BAND > 0
