"""Graph operators over ``nodes(id)`` and ``edges(src, dst)``, an edge meaning "src uses dst".

Edges are written once and counted. A graph of at most ``SMALL`` nodes and edges is solved in one task, as its size
is known; a larger one in bounded loops of joins, one written table a round, so plans stay short and a lost executor
costs one round. ``small=0`` takes the loops at any size. Loops that don't settle raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.scratch import Gathered, cut, drop

MAX_ROUNDS = 200
SMALL = 200_000
SMALL_CLOSURE = 10_000  # nodes of a graph whose reachable pairs fit one task as bit sets
HUGE = "decimal(38,0)"


def _held(nodes: DataFrame, edges: DataFrame, small: int) -> tuple[DataFrame, DataFrame, bool]:
    """Distinct nodes and edges as written tables, and whether they are small."""
    nodes, edges = cut(nodes.select("id").distinct()), cut(edges.select("src", "dst").distinct())
    return nodes, edges, nodes.count() <= small and edges.count() <= small


def _solved(nodes: DataFrame, edges: DataFrame, solve: Callable[[list, list], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``solve(ids, arcs)`` makes of a small graph, in one task."""
    rows = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("node")).unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(False).alias("node")))
    kinds = nodes.select(F.lit(None).cast(f"struct<{schema}>").alias("o")).select("o.*").schema
    arrow = to_arrow_schema(kinds)
    names, types = arrow.names, arrow.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, arcs = [], []
        for batch in batches:
            for a, b, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node:
                    ids.append(a)
                else:
                    arcs.append((a, b))
        found = solve(sorted(ids), sorted(arcs))
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.coalesce(1).mapInArrow(run, kinds)


def _components(ids: list, arcs: list) -> dict:
    """Least id of each node's strong component (Tarjan's algorithm without recursion)."""
    out: dict = {x: [] for x in ids}
    for s, d in arcs:
        out.setdefault(s, []).append(d)
        out.setdefault(d, [])
    index, low, on, stack, label, n = {}, {}, set(), [], {}, 0
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = n
        n += 1
        stack.append(start)
        on.add(start)
        work = [(start, iter(out[start]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = [stack.pop()]
                    while members[-1] != v:
                        members.append(stack.pop())
                    on.difference_update(members)
                    label.update(dict.fromkeys(members, min(members)))
    return label


def _condensed(ids: list, arcs: list) -> tuple[dict, dict, list]:
    """Component of each node, distinct arcs between components, and components so that arcs point forward."""
    label = _components(ids, arcs)
    out: dict = {c: set() for c in label.values()}
    into = dict.fromkeys(out, 0)
    for s, d in arcs:
        a, b = label[s], label[d]
        if a != b and b not in out[a]:
            out[a].add(b)
            into[b] += 1
    ready = sorted(c for c in into if not into[c])
    for c in ready:
        for d in out[c]:
            into[d] -= 1
            if not into[d]:
                ready.append(d)
    return label, out, ready


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out of every node, 0 where it has none."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return nodes.join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def roles(nodes: DataFrame, edges: DataFrame, hub: int = 3, entry: str = "false") -> DataFrame:
    """root (nothing uses it), leaf (uses nothing), hub (both degrees at ``hub`` or more), else composer.

    A root is never a hub, nor is a node that the SQL condition ``entry`` names as an entry point; a node without any
    edge is a root.
    """
    both = (F.col("fan_in") >= hub) & (F.col("fan_out") >= hub) & ~F.expr(entry)
    role = F.when(F.col("fan_in") == 0, "root").when(F.col("fan_out") == 0, "leaf").when(both, "hub").otherwise("composer")
    return degrees(nodes, edges).withColumn("role", role)


def reachable(edges: DataFrame, start: DataFrame, rounds: int = MAX_ROUNDS, small: int = SMALL) -> DataFrame:
    """Nodes that ``start(id)`` reaches, itself included."""
    start, edges, is_small = _held(start, edges, small)
    if is_small:

        def walk(ids, arcs):
            out: dict = {}
            for s, d in arcs:
                out.setdefault(s, []).append(d)
            seen, front = set(ids), list(ids)
            while front:
                front = [d for s in front for d in out.get(s, ()) if d not in seen and not seen.add(d)]
            return [(x,) for x in sorted(seen)]

        return _solved(start, edges, walk, f"id:{dict(start.dtypes)['id']}")
    front, seen = start, Gathered(start)
    for _ in range(rounds):
        front = cut(front.join(edges, front.id == edges.src).select(F.col("dst").alias("id")).distinct().join(seen.all(), "id", "left_anti"))
        if front.isEmpty():
            return seen.all()
        seen.add(front)
    raise RuntimeError("reachability did not settle")


def closure(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """All (src, dst) with a path of at least one edge. As large as the answer: for graphs of modules, not of records."""
    front = cut(edges.select("src", "dst").distinct())
    seen, step = Gathered(front), front.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    for _ in range(rounds):
        front = cut(front.join(step, F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst")).distinct().join(seen.all(), ["src", "dst"], "left_anti"))
        if front.isEmpty():
            return seen.all()
        seen.add(front)
    raise RuntimeError("closure did not settle")


def reach_pairs(nodes: DataFrame, edges: DataFrame, small: int = SMALL_CLOSURE) -> DataFrame:
    """One row (n, pairs): the nodes, and the pairs of different nodes with a path from one to the other."""
    nodes, edges, is_small = _held(nodes, edges, small)
    if is_small:

        def count(ids, arcs):
            label, out, order = _condensed(ids, arcs)
            sizes: dict = {}
            for c in label.values():
                sizes[c] = sizes.get(c, 0) + 1
            place = {c: i for i, c in enumerate(order)}
            bits, pairs = {}, 0
            for c in reversed(order):
                reach = 1 << place[c]
                for d in out[c]:
                    reach |= bits[d]
                bits[c] = reach
                members, rest, i = 0, reach, 0
                while rest:
                    skip = (rest & -rest).bit_length() - 1
                    rest >>= skip + 1
                    i += skip
                    members += sizes[order[i]]
                    i += 1
                pairs += sizes[c] * (members - 1)
            return [(len(ids), pairs)]

        return _solved(nodes, edges, count, "n:bigint,pairs:bigint")
    pairs = closure(edges).where("src <> dst").agg(F.count("*").alias("pairs"))
    return nodes.agg(F.count("*").alias("n")).join(F.broadcast(pairs)).select("n", "pairs")


def strong_components(nodes: DataFrame, edges: DataFrame, rounds: int = MAX_ROUNDS, small: int = SMALL) -> DataFrame:
    """(id, component): the least id of the node's cycle, its own id outside cycles.

    Large graphs: nodes without a live arc in or out are trimmed; the rest takes the least id that reaches it as its
    colour (with pointer jumping, as what reaches the colour reaches the node), and the nodes of a colour that reach
    the colour's own node are its component. No pairs of nodes are formed.
    """
    nodes, edges, is_small = _held(nodes, edges, small)
    kind = dict(nodes.dtypes)["id"]
    if is_small:

        def label(ids, arcs):
            found = _components(ids, arcs)
            return [(x, found[x]) for x in ids]

        return _solved(nodes, edges, label, f"id:{kind},component:{kind}")
    live, done = cut(edges.where("src <> dst")), []
    for _ in range(rounds):
        ends = live.select(F.col("src").alias("id")).intersect(live.select("dst"))
        inner = cut(live.join(ends.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if inner.count() < live.count():
            live = inner
            continue
        if live.isEmpty():
            break
        colour = cut(live.select(F.col("src").alias("id")).unionByName(live.select(F.col("dst").alias("id"))).distinct().select("id", F.col("id").alias("c")))
        for _ in range(rounds):
            into = live.join(colour, live.src == colour.id).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            moved = colour.join(into, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"))
            jump = moved.select(F.col("id").alias("c"), F.col("c").alias("cc"))
            new = cut(moved.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("c")))
            settled = new.join(colour, ["id", "c"], "left_anti").isEmpty()
            drop(colour)
            colour = new
            if settled:
                break
        else:
            raise RuntimeError("colours did not settle")
        s, d = (colour.select(F.col("id").alias(x), F.col("c").alias(f"{x}_c")) for x in ("src", "dst"))
        within = cut(live.join(s, "src").join(d, "dst").where("src_c = dst_c").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = reachable(within, colour.where("id = c").select("id"), rounds, small=0)
        found = cut(back.join(colour, "id").select("id", F.col("c").alias("component")))
        done.append(found)
        live = cut(live.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    else:
        raise RuntimeError("components did not settle")
    out = nodes
    if done:
        known = done[0]
        for more in done[1:]:
            known = known.unionByName(more)
        out = nodes.join(known, "id", "left")
        return out.select("id", F.coalesce("component", "id").alias("component"))
    return out.select("id", F.col("id").alias("component"))


def weak_components(nodes: DataFrame, edges: DataFrame, rounds: int = MAX_ROUNDS, small: int = SMALL) -> DataFrame:
    """(id, component) by the least id over edges in either direction, propagated with pointer jumping."""
    nodes, edges, is_small = _held(nodes, edges, small)
    kind = dict(nodes.dtypes)["id"]
    if is_small:

        def label(ids, arcs):
            found = _components(ids, arcs + [(d, s) for s, d in arcs])
            return [(x, found[x]) for x in ids]

        return _solved(nodes, edges, label, f"id:{kind},component:{kind}")
    both = cut(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("c")))
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.id).groupBy(F.col("src").alias("id")).agg(F.min("c").alias("m"))
        moved = labels.join(near, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = moved.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = cut(moved.join(jump, "c", "left").select("id", F.coalesce("cc", "c").alias("c")))
        if labels.join(new, ["id", "c"], "left_anti").isEmpty():
            return new.withColumnRenamed("c", "component")
        drop(labels)
        labels = new
    raise RuntimeError("components did not settle")


def levels(nodes: DataFrame, edges: DataFrame, rounds: int = MAX_ROUNDS, small: int = SMALL) -> DataFrame:
    """(id, level): the longest path down to a leaf of an acyclic graph. A cycle raises."""
    nodes, edges, is_small = _held(nodes, edges, small)
    kind = dict(nodes.dtypes)["id"]
    if is_small:

        def depth(ids, arcs):
            label, out, order = _condensed(ids, arcs)
            level: dict = {}
            for c in reversed(order):
                level[c] = max((level[d] + 1 for d in out[c]), default=0)
            cyclic = len(out) < len(label) or any(s == d for s, d in arcs)
            return [(None, None)] if cyclic else [(x, level[x]) for x in ids]

        out = cut(_solved(nodes, edges, depth, f"id:{kind},level:int"))
        if out.where("id is null").head(1):
            raise ValueError("the graph has a cycle")
        return out
    level = cut(nodes.select("id", F.lit(0).alias("level")))
    for _ in range(rounds):
        above = edges.join(level, edges.dst == level.id).groupBy(F.col("src").alias("id")).agg((F.max("level") + 1).alias("up"))
        new = cut(nodes.join(above, "id", "left").select("id", F.coalesce("up", F.lit(0)).alias("level")))
        if level.join(new, ["id", "level"], "left_anti").isEmpty():
            return level
        drop(level)
        level = new
    raise ValueError("the graph has a cycle, or paths longer than the bound")


def condensed(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Components of the nodes, and distinct edges between different components."""
    parts = cut(strong_components(nodes, edges, small=small))
    a, b = (parts.select(F.col("id").alias(x), F.col("component").alias(y)) for x, y in (("src", "s"), ("dst", "d")))
    return parts, edges.join(a, "src").join(b, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def path_weights(nodes: DataFrame, edges: DataFrame, rounds: int = MAX_ROUNDS, small: int = SMALL) -> DataFrame:
    """(id, weight): how many call paths end in a node; a cycle counts as one node and its members share the weight.

    The weight of a node is the sum of its callers' weights and one for each, taken in topological order. Decimal, as
    counts multiply; a count beyond 38 digits raises. Large graphs: each round settles the nodes whose callers are
    settled and sends their sums on once.
    """
    nodes, edges, is_small = _held(nodes, edges, small)
    kind = dict(nodes.dtypes)["id"]
    if is_small:

        def weigh(ids, arcs):
            from decimal import Decimal

            label, out, order = _condensed(ids, arcs)
            weight = dict.fromkeys(out, 0)
            for c in order:
                for d in out[c]:
                    weight[d] += weight[c] + 1
            return [(x, Decimal(weight[label[x]])) for x in ids]

        return _solved(nodes, edges, weigh, f"id:{kind},weight:{HUGE}")
    parts, arcs = condensed(nodes, edges, small)
    arcs = cut(arcs)
    callers = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("open"))
    heads = parts.select(F.col("component").alias("id")).distinct()
    state = cut(heads.join(callers, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).cast(HUGE).alias("weight")))
    ready, done = cut(state.where("open = 0").select("id", "weight")), None
    for _ in range(rounds):
        done = ready if done is None else cut(done.unionByName(ready))
        sent = ready.join(arcs, ready.id == arcs.src).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.sum(F.col("weight") + 1).cast(HUGE).alias("more"))
        waiting = state.join(ready.select("id"), "id", "left_anti")
        new = cut(waiting.join(sent, "id", "left").select("id", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), (F.col("weight") + F.coalesce("more", F.lit(0))).cast(HUGE).alias("weight")))
        drop(state)
        state, ready = new, cut(new.where("open = 0").select("id", "weight"))
        if ready.isEmpty():
            break
    else:
        raise RuntimeError("paths longer than the bound")
    return parts.join(done.select(F.col("id").alias("component"), "weight"), "component").select("id", "weight")


def stability(nodes: DataFrame, edges: DataFrame, stable: float = 0.25) -> DataFrame:
    """Instability fan_out / (fan_in + fan_out), and whether it is low enough to be used freely."""
    d = degrees(nodes, edges)
    out = d.withColumn("instability", F.round(F.try_divide(F.col("fan_out").cast("double"), F.col("fan_in") + F.col("fan_out")), 6))
    return out.withColumn("stable", F.coalesce(F.col("instability") <= stable, F.lit(True)))


def reuse_arcs(nodes: DataFrame, edges: DataFrame, stable: float = 0.25) -> DataFrame:
    """One row (free, counted): arcs into stable nodes are free reuse, the rest counts."""
    told = edges.join(stability(nodes, edges, stable).select(F.col("id").alias("dst"), "stable"), "dst")
    return told.agg(F.count_if("stable").alias("free"), F.count_if(~F.col("stable")).alias("counted"))


def propagation_cost(nodes: DataFrame, edges: DataFrame, small: int = SMALL_CLOSURE) -> DataFrame:
    """Share of node pairs (each node with itself included) in which a change can travel, in percent."""
    return reach_pairs(nodes, edges, small).select("n", "pairs", F.round(100.0 * (F.col("pairs") + F.col("n")) / (F.col("n") * F.col("n")), 6).alias("cost"))


def nccd(nodes: DataFrame, edges: DataFrame, small: int = SMALL_CLOSURE) -> DataFrame:
    """Lakos' normalised cumulative component dependency: 1.0 for a balanced binary tree of the same size."""
    both = reach_pairs(nodes, edges, small).withColumn("ccd", F.col("pairs") + F.col("n"))
    return both.select("n", "ccd", F.round(F.col("ccd") / ((F.col("n") + 1) * F.log2(F.col("n") + 1) - F.col("n")), 6).alias("nccd"))


def modularity(edges: DataFrame, community: DataFrame, *by: str) -> DataFrame:
    """Newman's Q of a partition ``community(id, c)``, edges taken as undirected.

    With ``by`` (columns of ``community``, such as a folder depth) one Q for each of their values.
    """
    a, b = (community.select(F.col("id").alias(x), F.col("c").alias(y), *(F.col(k).alias(f"{x}_{k}") for k in by)) for x, y in (("src", "cs"), ("dst", "cd")))
    told = edges.join(a, "src").join(b, "dst")
    for k in by:
        told = told.where(F.col(f"src_{k}") == F.col(f"dst_{k}"))
    keys = [F.col(f"src_{k}").alias(k) for k in by]
    ends = told.select(*keys, F.col("cs").alias("c"), F.lit(1).alias("d"), (F.col("cs") == F.col("cd")).cast("int").alias("e"))
    ends = ends.unionByName(told.select(*keys, F.col("cd").alias("c"), F.lit(1).alias("d"), F.lit(0).alias("e")))
    per = ends.groupBy(*by, "c").agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    m = edges.agg(F.count("*").alias("m"))
    share = F.col("e") / F.col("m") - (F.col("d") / (2 * F.col("m"))) * (F.col("d") / (2 * F.col("m")))
    return per.join(F.broadcast(m)).groupBy(*by).agg(F.round(F.sum(share), 6).alias("q"))


def unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that no entry reaches."""
    return nodes.join(reachable(edges, entries), "id", "left_anti")


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes that use a changed node, directly or through others, and the changed ones."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed)


def unguarded(edges: DataFrame, changed: DataFrame, tests: DataFrame) -> DataFrame:
    """Changed nodes (id) that no test (id) reaches: nothing guards them."""
    return changed.select("id").distinct().join(reachable(edges, tests), "id", "left_anti")


def upward_arcs(edges: DataFrame, layers: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Edges from a lower to a higher layer (``layers(id, layer)``; nodes without one are judged by nothing), and edges
    into a composition root ``roots(id)``."""
    a, b = (layers.select(F.col("id").alias(x), F.col("layer").alias(f"__{x}")) for x in ("src", "dst"))
    told = edges.join(a, "src", "left").join(b, "dst", "left")
    up = F.coalesce(F.col("__src") < F.col("__dst"), F.lit(False))
    if roots is not None:
        told = told.join(roots.select(F.col("id").alias("dst"), F.lit(True).alias("__root")).distinct(), "dst", "left")
        up = up | F.coalesce("__root", F.lit(False))
    return told.where(up).select("src", "dst")


def collapsed(edges: DataFrame, facades: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Edges with every facade ``facades(id)`` replaced by what it re-exports, through facades of facades.

    For metrics only: reachability needs the edges as they are, or a facade itself would count as dead.
    """
    thin = facades.select(F.col("id").alias("dst")).distinct()
    edges = cut(edges.select("src", "dst").distinct())
    out = edges.join(thin, "dst", "left_semi").select("src", "dst")
    onward = edges.join(thin.withColumnRenamed("dst", "src"), "src", "left_semi").select(F.col("src").alias("via"), F.col("dst").alias("end"))
    rest = edges.join(thin, "dst", "left_anti").select("src", "dst")
    front = cut(out)
    seen = Gathered(front)
    for _ in range(rounds):
        if front.isEmpty():
            every = rest.unionByName(seen.all().join(onward, F.col("dst") == F.col("via")).select("src", F.col("end").alias("dst")).join(thin, "dst", "left_anti").select("src", "dst"))
            return every.join(thin.withColumnRenamed("dst", "src"), "src", "left_anti").where("src <> dst").select("src", "dst").distinct()
        step = front.join(onward, F.col("dst") == F.col("via")).select("src", F.col("end").alias("dst")).join(thin, "dst", "left_semi").select("src", "dst").distinct()
        front = cut(step.join(seen.all(), ["src", "dst"], "left_anti"))
        seen.add(front)
    raise RuntimeError("facades did not settle")


def hub_split(nodes: DataFrame, edges: DataFrame, hub: int = 3, entry: str = "false") -> DataFrame:
    """Edges after each hub h became ``h (leaf)``, which callers use, and ``h (composer)``, which keeps its uses."""
    hubs = roles(nodes, edges, hub, entry).where("role = 'hub'").select("id")
    tagged = edges.join(hubs.select(F.col("id").alias("hs")), F.col("src") == F.col("hs"), "left").join(hubs.select(F.col("id").alias("hd")), F.col("dst") == F.col("hd"), "left")
    moved = tagged.select(
        F.when(F.col("hs").isNotNull(), F.concat("src", F.lit(" (composer)"))).otherwise(F.col("src").cast("string")).alias("src"),
        F.when(F.col("hd").isNotNull(), F.concat("dst", F.lit(" (leaf)"))).otherwise(F.col("dst").cast("string")).alias("dst"),
    )
    inner = hubs.select(F.concat("id", F.lit(" (composer)")).alias("src"), F.concat("id", F.lit(" (leaf)")).alias("dst"))
    return moved.unionByName(inner).distinct()


def cycle_cuts(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Arcs whose removal leaves no cycle (greedy feedback arc set of Eades, Lin and Smyth), one component at a time.

    Columns src, dst, n (nodes of the component). A component is worked through by one task: one of more than
    ``SMALL`` arcs raises, as neither its cut list nor its order would be of use to a reader.
    """
    nodes, edges, _ = _held(nodes, edges, small)
    parts = cut(strong_components(nodes, edges, small=small))
    a, b = (parts.select(F.col("id").alias(x), F.col("component").alias(y)) for x, y in (("src", "component"), ("dst", "other")))
    inside = cut(edges.where("src <> dst").join(a, "src").join(b, "dst").where("component = other").select("component", "src", "dst"))
    largest = inside.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if largest and largest > SMALL:
        raise RuntimeError(f"a component of {largest} arcs is too large to cut")

    def cut_arcs(group):
        import pandas as pd

        left = {x: set() for x in pd.concat([group.src, group.dst])}
        into = {x: set() for x in left}
        for s, d in zip(group.src, group.dst, strict=True):
            left[s].add(d)
            into[d].add(s)
        n, head, tail = len(left), [], []
        while left:
            sinks = sorted(x for x in left if not left[x])
            sources = sorted(x for x in left if not into[x])
            if sinks:
                x = sinks[0]
                tail.append(x)
            else:
                x = sources[0] if sources else min(left, key=lambda v: (len(into[v]) - len(left[v]), v))
                head.append(x)
            for y in left.pop(x):
                into[y].discard(x)
            for y in into.pop(x):
                left[y].discard(x)
        place = {x: i for i, x in enumerate(head + tail[::-1])}
        back = group[[place[s] > place[d] for s, d in zip(group.src, group.dst, strict=True)]]
        return back[["src", "dst"]].assign(n=n)

    kind = dict(edges.dtypes)["src"]
    return inside.groupBy("component").applyInPandas(cut_arcs, f"src {kind}, dst {kind}, n long")


def edit_distance(nodes: DataFrame, edges: DataFrame, upward: DataFrame | None = None, hub: int = 3, entry: str = "false") -> DataFrame:
    """One row (cycle_cuts, upward_cuts, splits, distance): the edits that make a graph ideal.

    Arcs of ``upward(src, dst)`` go first, then the arcs that close cycles, then hubs are split. An arc beside a
    longer path is no edit.
    """
    nodes, edges, _ = _held(nodes, edges, SMALL)
    if upward is None:
        upward = edges.where("false")
    up = cut(edges.join(upward.select("src", "dst").distinct(), ["src", "dst"], "left_semi"))
    rest = cut(edges.join(up, ["src", "dst"], "left_anti"))
    cuts = cut(cycle_cuts(nodes, rest))
    hubs = roles(nodes, rest.join(cuts, ["src", "dst"], "left_anti"), hub, entry)
    counts = cuts.agg(F.count("*").alias("cycle_cuts")).join(F.broadcast(up.agg(F.count("*").alias("upward_cuts")))).join(F.broadcast(hubs.agg(F.count_if(F.col("role") == "hub").alias("splits"))))
    return counts.withColumn("distance", F.expr("cycle_cuts + upward_cuts + splits"))
