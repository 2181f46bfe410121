"""Graphs of our own against brute force, each operator both in one task and in its loops."""

import random

import pytest

from siltstone.operators import graph

BOTH = pytest.mark.parametrize("small", [graph.SMALL, 0], ids=["one task", "loops"])


def frames(spark, nodes, edges, kind="long"):
    return spark.createDataFrame([(n,) for n in nodes], f"id {kind}"), spark.createDataFrame(list(edges), f"src {kind}, dst {kind}")


def told(df, *columns):
    return {r[columns[0]]: r[columns[1]] for r in df.collect()}


def reach(nodes, edges):
    """Nodes that each node reaches by one edge or more."""
    out = {a: {d for s, d in edges if s == a} for a in nodes}
    for k in nodes:
        for a in nodes:
            if k in out[a]:
                out[a] |= out[k]
    return out


def some_graph(seed, n=14, m=18, acyclic=False):
    rng = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rng.sample(range(n), 2)
        edges.add((min(a, b), max(a, b)) if acyclic else (a, b))
    return list(range(n)), sorted(edges)


@BOTH
@pytest.mark.parametrize("seed", [3, 4])
def test_components_and_reach(spark, seed, small):
    nodes, edges = some_graph(seed)
    far = reach(nodes, edges)
    n, e = frames(spark, nodes, edges)
    assert told(graph.strong_components(n, e, small=small), "id", "component") == {a: min([a, *(b for b in far[a] if a in far[b])]) for a in nodes}
    both = reach(nodes, edges + [(d, s) for s, d in edges])
    assert told(graph.weak_components(n, e, small=small), "id", "component") == {a: min({a} | both[a]) for a in nodes}
    start = spark.createDataFrame([(2,), (5,)], "id long")
    assert {r.id for r in graph.reachable(e, start, small=small).collect()} == {2, 5} | far[2] | far[5]
    assert {(r.src, r.dst) for r in graph.closure(e).collect()} == {(a, b) for a in nodes for b in far[a]}
    pairs = graph.reach_pairs(n, e, small=small).first()
    assert (pairs.n, pairs.pairs) == (len(nodes), sum(len(far[a] - {a}) for a in nodes))


@BOTH
def test_long_chains_and_rings(spark, small):
    """A ring with a chain in and one out, and a chain beside it."""
    ring = [(k, (k + 1) % 6) for k in range(6)]
    edges = ring + [(20, 21), (21, 0), (3, 30), (30, 31), (40, 41), (41, 42)]
    nodes = sorted({x for e in edges for x in e} | {99})
    n, e = frames(spark, nodes, edges)
    assert told(graph.strong_components(n, e, small=small), "id", "component") == {x: 0 if x < 6 else x for x in nodes}
    weights = {k: int(v) for k, v in told(graph.path_weights(n, e, small=small), "id", "weight").items()}
    assert weights[20] == 0 and weights[21] == 1 and {weights[k] for k in range(6)} == {2} and weights[30] == 3 and weights[31] == 4 and weights[42] == 2 and weights[99] == 0
    with pytest.raises(ValueError):
        graph.levels(n, e, rounds=15, small=small)


@BOTH
@pytest.mark.parametrize("seed", [5, 6])
def test_levels_and_weights_of_acyclic_graphs(spark, seed, small):
    nodes, edges = some_graph(seed, acyclic=True)
    n, e = frames(spark, nodes, edges)
    level, paths = {}, dict.fromkeys(nodes, 0)
    for a in reversed(nodes):
        level[a] = max([level[d] + 1 for s, d in edges if s == a], default=0)
    for b in nodes:
        paths[b] = sum(paths[s] + 1 for s, d in edges if d == b)
    assert told(graph.levels(n, e, small=small), "id", "level") == level
    assert {k: int(v) for k, v in told(graph.path_weights(n, e, small=small), "id", "weight").items()} == paths


def test_roles_and_hub_split(spark):
    edges = [(f"in{k}", "mid") for k in range(4)] + [("mid", f"out{k}") for k in range(3)] + [("top", f"in{k}") for k in range(4)] + [(f"in{k}", "main.x") for k in range(3)] + [("main.x", f"out{k}") for k in range(3)]
    nodes = sorted({x for e in edges for x in e} | {"lone"})
    n, e = frames(spark, nodes, edges, "string")
    want = {"mid": "hub", "top": "root", "lone": "root", "main.x": "composer", **{f"in{k}": "composer" for k in range(4)}, **{f"out{k}": "leaf" for k in range(3)}}
    assert told(graph.roles(n, e, entry="id like 'main.%'"), "id", "role") == want
    split = {(r.src, r.dst) for r in graph.hub_split(n, e, entry="id like 'main.%'").collect()}
    assert split == {(s if s != "mid" else "mid (composer)", d if d != "mid" else "mid (leaf)") for s, d in edges} | {("mid (composer)", "mid (leaf)")}


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_cuts_leave_no_cycle(spark, seed):
    nodes, edges = some_graph(seed, m=24)
    n, e = frames(spark, nodes, edges)
    cuts = {(r.src, r.dst) for r in graph.cycle_cuts(n, e).collect()}
    left = reach(nodes, [x for x in edges if x not in cuts])
    assert cuts <= set(edges) and all(a not in left[a] for a in nodes) and len(cuts) <= len(edges) // 2
    far = reach(nodes, edges)
    assert bool(cuts) == any(a in far[a] for a in nodes)


def test_edit_distance(spark):
    """A tree with a shortcut needs no edit; a ring, an arc up and a hub need one each."""
    tree = [(1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (1, 6)]
    row = graph.edit_distance(*frames(spark, range(1, 7), tree)).first()
    assert tuple(row) == (0, 0, 0, 0)
    ring, hub = [(10, 11), (11, 12), (12, 13), (13, 10)], [(k, 30) for k in (20, 21, 22)] + [(30, k) for k in (31, 32, 33)]
    up = [(33, 1)]
    edges = tree + ring + hub + up
    n, e = frames(spark, sorted({x for p in edges for x in p}), edges)
    row = graph.edit_distance(n, e, spark.createDataFrame(up, "src long, dst long")).first()
    assert (row.cycle_cuts, row.upward_cuts, row.splits, row.distance) == (1, 1, 1, 3)
    assert graph.edit_distance(n, e, entry="id = 30").first().splits == 0


def test_facades_in_a_row(spark):
    """Two facades behind each other, one that turns back on itself, and a user of nothing else."""
    edges = [(1, 10), (10, 11), (11, 2), (11, 3), (4, 12), (12, 12), (12, 4), (5, 2)]
    got = graph.collapsed(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(10,), (11,), (12,)], "id long"))
    assert {(r.src, r.dst) for r in got.collect()} == {(1, 2), (1, 3), (5, 2)}


def test_unguarded(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert {r.id for r in graph.unguarded(edges, ids(3, 5, 9), ids(1)).collect()} == {5, 9}
    assert {r.id for r in graph.affected(edges, ids(3)).collect()} == {1, 2, 3}
