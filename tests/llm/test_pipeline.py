"""The pipeline over a small corpus, each stage against its plain counterpart."""

import corpus_pipeline
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import prose


def test_stages(spark, documents, tmp_path):
    lines = "\n".join(prose(k, 12) for k in range(6))
    base = prose(40, 120)
    item = prose(41, 25)
    rows = [(k, f"{prose(200 + k, 90)}\n{prose(300 + k, 30)}") for k in range(30)]
    rows += [(100, f"{prose(60, 60)}\n{lines}"), (101, f"{prose(61, 60)}\n{lines}"), (102, base), (103, base.replace("a", "b", 1)), (104, f"{prose(62, 50)} {item} {prose(63, 50)}"), (105, None), (106, "12 34"), (107, ""), (None, prose(64, 70))]
    docs = documents([(i, t, ("en" if (i or 0) % 3 else "fr", f"src{(i or 0) % 4}")) for i, t in rows], clashing=True)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    all_ids = {i for i, _ in rows}
    assert set(kept["language_id"]) == all_ids - {105, 106, 107}
    assert set(kept["line_dedup"]) == set(kept["language_id"]) and kept["line_dedup"][101] == prose(61, 60) and kept["line_dedup"][100].endswith(lines)
    assert set(kept["near_dedup"]) == set(kept["line_dedup"]) - {103}
    assert set(kept["decontaminate"]) == set(kept["near_dedup"]) - {104}
    final = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, final)) == sorted(map(str, whole)) and {r.doc_id for r in final} <= set(kept["decontaminate"])


def test_registered_names():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_on_an_empty_table(spark, documents, tmp_path):
    spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = documents([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.collect() == [] and (out.columns == empty.columns or name == "mixing"), name


def test_stages_on_awkward_rows(spark, documents, awkward, tmp_path):
    """Nulls, blanks, a long text, repeated and null ids, clashing columns: every stage runs and keeps its columns."""
    spark.createDataFrame([(None, None), (1, ""), (2, prose(77, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [*awkward, (6, prose(3, 40)), (None, prose(78, 60)), (900, prose(77, 20)), (901, None)]
    docs = documents(rows, clashing=True)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        kept = out.collect()
        assert out.columns == docs.columns and len(kept) <= len(rows), name
        assert any(r.doc_id is None for r in kept), name
    left = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert 900 not in left and {1, 2, 3, 901} <= left
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()
    assert {r.epoch for r in mixed} <= {0, 1, 2} and all(r.tokens > 0 for r in mixed)


def test_recall_of_near_dedup_against_exact_pairs(spark, documents):
    """Edited copies around the threshold: the stage's groups hold every pair that exact comparison links."""
    import random

    rng = random.Random(12)
    rows = []
    for group in range(25):
        base = prose(group, rng.randrange(40, 160)).split()
        for copy in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            rows.append((group * 10 + copy, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect()}
    assert kept == {i for i in sets if root(i) == i} and len(pairs) > 50 and len(kept) > 30


def test_language_id_carries_the_prediction(spark, documents):
    """Wrong and missing labels are replaced, languages without a weight go."""
    import random

    rng = random.Random(2)
    words = {"en": ["lorna", "narol", "olan"], "de": ["kishu", "shuki", "huik"], "xx": ["pemt", "tempe", "mepet"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(k, text(lang), (lang, "src1")) for k, lang in enumerate(sorted(words) * 10)]
    rows += [(100, text("en"), (None, "src1")), (101, text("de"), ("en", "src1")), (102, text("xx"), ("en", "src1"))]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, documents(rows), "").collect()}
    assert got[100] == "en" and got[101] == "de" and 102 not in got
    assert {got.get(k) for k, (_, _, (lang, _)) in enumerate(rows[:30]) if lang == "xx"} == {None}
