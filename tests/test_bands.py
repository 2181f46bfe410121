"""Band, interval and as-of joins against loops in Python."""

import random

import pytest

from siltstone.operators import bands
from siltstone.plans.joins import QUERIES


def made(spark, seed, n=60):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xyz"), rng.randrange(200)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, file string, line long")


def test_band_semi_and_anti(spark):
    a, fa = made(spark, 1)
    b, fb = made(spark, 2, 20)
    near = {i for i, f, n in a if any(f == g and abs(n - m) <= 5 for _, g, m in b)}
    assert {r.id for r in bands.band_semi(fa, fb, ["file"], "line", 5).collect()} == near
    assert {r.id for r in bands.band_anti(fa, fb, ["file"], "line", 5).collect()} == {i for i, _, _ in a} - near
    assert bands.band_anti(fa, fb.limit(0), ["file"], "line", 5).count() == len(a)


def test_greedy_pairs(spark):
    a, fa = made(spark, 3)
    b, fb = made(spark, 4)
    free, want = sorted(b), set()
    for i, f, n in sorted(a):
        hit = next((x for x in free if x[1] == f and abs(x[2] - n) <= 4), None)
        if hit:
            free.remove(hit)
            want.add((i, hit[0]))
    assert {(r.left_id, r.right_id) for r in bands.greedy_pairs(fa, fb, ["file"], "line", 4, "id", "id").collect()} == want


def test_intervals(spark):
    a, fa = made(spark, 5)
    spans = [(i, f, n, n + 5 + i) for i, f, n in made(spark, 6, 30)[0]]
    fs = spark.createDataFrame(spans, "id long, file string, start long, end long")
    inner, near = {}, {}
    for i, f, n in a:
        held = [s for s in spans if s[1] == f and s[2] <= n <= s[3]]
        if held:
            inner[i] = max(s[2] for s in held)
        wide = [s for s in spans if s[1] == f and s[2] - 8 <= n <= s[3]]
        if wide:
            near[i] = min((abs(n - s[2]), s[2]) for s in wide)[1]
    assert {r.id: r.s_start for r in bands.innermost(fa, fs, "file", "id", "line", "start", "end", cell=16).collect()} == inner
    assert {r.id: r.s_start for r in bands.nearest_start(fa, fs, "file", "id", "line", "start", "end", cell=16).collect()} == near


def test_asof(spark):
    a, fa = made(spark, 7)
    marks = [(f, n, float(i)) for i, f, n in made(spark, 8, 15)[0]]
    fm = spark.createDataFrame(marks, "file string, line long, value double")
    want = {i: max(((m, v) for g, m, v in marks if g == f and m <= n), default=(0, None))[1] for i, f, n in a}
    assert {r.id: r.value for r in bands.asof_at_or_above(fa, fm, "file", "line", "value").collect()} == want


@pytest.mark.parametrize("most", ["bits", "blocks", "things"])
def test_shared_members(spark, monkeypatch, most):
    """All pairs by brute force: sets of two longs, many blocks of holders, more things than bits."""
    if most != "bits":
        monkeypatch.setattr(bands, "BLOCK", 7)
        monkeypatch.setattr(bands, "SLICE", 3)
    if most == "things":
        monkeypatch.setattr(bands, "WORDS", 1)
    draw = random.Random(5)
    rows = [(f"g{draw.randrange(90)}", f"f{i % 40:02d}") for i in range(1200)] + [(f"g{i}", f) for i in range(90) for f in ("same", "also")]
    rows += rows[:50] + [(None, "f01"), (None, "f02"), ("g1", None), ("g2", None), ("g3", "one")]
    sets = {}
    for g, f in rows:
        if g is not None and f is not None:
            sets.setdefault(f, set()).add(g)
    for least in (1, 9):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        got = bands.shared_members(spark.createDataFrame(rows, "g string, f string"), least).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert bands.shared_members(spark.createDataFrame([], "g string, f string"), 1).collect() == []


def test_scope_overlap_moves_holders(spark):
    """Pairs are counted as they stream past: nothing gathers them by a and b."""
    plan = QUERIES["scope_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Scan parquet")[0]
