"""Communities and betweenness against plain algorithms on small graphs."""

import random
from collections import deque

import pytest

from lexquarry.operators import communities as M
from lexquarry.operators import graph as G


def planted(groups=12, size=15, seed=3):
    rng, edges = random.Random(seed), set()
    for g in range(groups):
        for i in range(size):
            for _ in range(3):
                edges.add((g * size + i, g * size + rng.randrange(size)))
            if rng.random() < 0.5:
                edges.add((g * size + i, rng.randrange(groups * size)))
    return sorted((a, b) for a, b in edges if a != b)


def modularity(edges, of):
    und = {(min(e), max(e)) for e in edges}
    m, ends, inside = len(und), {}, 0
    for a, b in und:
        for x in (a, b):
            ends[of[x]] = ends.get(of[x], 0) + 1
        inside += of[a] == of[b]
    return inside / m - sum(d * d for d in ends.values()) / (2 * m) ** 2


def louvain(edges):
    """Plain Louvain: try every neighbouring community for every node, over and over, then coarsen."""
    und = {(min(e), max(e)) for e in edges}
    near = {}
    for a, b in und:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1.0
    names = {n: {n} for n in near}
    while True:
        of, m2 = {n: n for n in near}, sum(sum(x.values()) for x in near.values())
        deg, changed, any_change = {n: sum(x.values()) for n, x in near.items()}, True, False
        while changed:
            changed = False
            for n in sorted(near):
                def gain(c, n=n):
                    return sum(w for b, w in near[n].items() if b != n and of[b] == c) - deg[n] * sum(deg[x] for x in near if x != n and of[x] == c) / m2
                best = max(sorted({of[b] for b in near[n]} | {of[n]}), key=lambda c: (round(gain(c), 9), c == of[n]))
                if best != of[n]:
                    of[n], changed, any_change = best, True, True
        if not any_change:
            return {x: c for c, xs in names.items() for x in xs}
        coarse, merged = {}, {}
        for a, x in near.items():
            for b, w in x.items():
                row = coarse.setdefault(of[a], {})
                row[of[b]] = row.get(of[b], 0.0) + w
        for n, xs in names.items():
            merged.setdefault(of[n], set()).update(xs)
        near, names = coarse, merged


def connected(edges, of):
    near = {}
    for a, b in edges:
        if of[a] == of[b]:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    for c in set(of.values()):
        members = {n for n in of if of[n] == c}
        seen, todo = {min(members)}, deque([min(members)])
        while todo:
            for b in near.get(todo.popleft(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if seen != members or c != min(members):
            return False
    return True


@pytest.mark.parametrize(("small", "least"), [(M.SMALL, 1.0), (700, 0.95)])
def test_modularity(spark, small, least):
    """In one task as good as plain Louvain; when the joins coarsen the graph first, nearly so. Communities are connected."""
    edges = planted()
    df = spark.createDataFrame([*edges, edges[0], (edges[1][1], edges[1][0]), (5, 5), (None, 3)], "a long, b long").repartition(3)
    got = {r["node"]: r["community"] for r in M.modular_communities(df, small=small).collect()}
    simple = [e for e in edges if e[0] != e[1]]
    assert set(got) == {x for e in simple for x in e} and connected(simple, got)
    assert modularity(simple, got) >= least * modularity(simple, louvain(simple)) - 1e-9


def test_weights_and_names(spark):
    rows = [("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("c", "d", 0.1), ("d", "e", 5.0), ("e", "f", 5.0), ("d", "f", 5.0), ("b", "a", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, w double")
    got = M.modular_communities(df, "w")
    assert {r["node"]: r["community"] for r in got.collect()} == dict.fromkeys("abc", "a") | dict.fromkeys("def", "d")
    assert M.weighted_modularity(df, got, "w") > 0.45
    assert M.modular_communities(df.limit(0), "w").count() == 0


def test_betweenness_in_blocks(spark):
    """Whatever the number of sources swept at once, and over parts of a graph that aren't connected."""
    edges = planted(4, 6) + [(100, 101), (101, 102), (102, 103), (103, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    todo.append(w)
                paths[w] += paths[v] if dist[w] == dist[v] + 1 else 0.0
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[w] == dist[v] + 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                want[w] += share[w]
    n = len(near)
    for sweep in (G.SWEEP, len(near) * 150):
        got = {r["node"]: r["betweenness"] for r in G.betweenness(df, sweep=sweep).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k] / ((n - 1) * (n - 2))) < 2e-9 for k in want)
    assert G.betweenness(df, samples=5).count() == n


def test_betweenness_of_a_graph_that_tasks_hold(spark, monkeypatch):
    """As by joins, of strings, several components and a sample, whatever the number of sources swept at once."""
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in planted(4, 6) + [(100, 101), (101, 102), (102, 103), (103, 100)]], "a string, b string")
    for samples in (None, 5):
        want = {r["node"]: r["betweenness"] for r in G.betweenness(df, samples, held=0).collect()}
        for at_once in (3, 64):
            monkeypatch.setattr(G, "SOURCES", at_once)
            got = {r["node"]: r["betweenness"] for r in G.betweenness(df, samples).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    assert G.betweenness(df.limit(0)).count() == 0
