"""Entity linking, walks around entities and quotes against plain loops."""

import random

from lexquarry.operators import evidence_table as V

QUESTIONS = [(1, "What does the Data Act say?"), (2, "nothing known"), (3, None), (4, "DATA\tACT and Privacy  Law"), (None, "data act"), (5, "")]
ALIASES = [("data act", 7), ("Data Act", 9), ("privacy law", 2), ("x", 3), ("", 4), (None, 5), ("law", None), ("act", 11)]
NEAR = [(1, 7, 1), (1, 30, 2), (1, 31, 3), (2, 40, 1), (2, 41, 2), (2, 42, 3), (2, None, 4), (None, 1, 1)]


def test_linked(spark):
    q, a, n = spark.createDataFrame(QUESTIONS, "question long, text string"), spark.createDataFrame(ALIASES, "alias string, entity long"), spark.createDataFrame(NEAR, "question long, entity long, rank int")
    got = sorted(map(tuple, V.linked(q, a, n, 3).collect()))
    assert got == [(1, 7, "alias", 1), (1, 11, "alias", 2), (1, 30, "vector", 3), (2, 40, "vector", 1), (2, 41, "vector", 2), (2, 42, "vector", 3), (4, 2, "alias", 1), (4, 7, "alias", 2), (4, 11, "alias", 3)]
    assert V.linked(q.limit(0), a, n.limit(0)).isEmpty() and V.linked(q, a.limit(0), n.limit(0)).isEmpty()


def walked(seeds, edges, hops, most, allowed):
    """Walk on from everything, then take the first `most`."""
    best = {}
    for h, r, t, a, j, c in edges:
        if allowed is None or j in allowed:
            best[h, r, t, a] = max(best.get((h, r, t, a), 0), c)
    out = {}
    for q in {q for q, _ in seeds}:
        front, found = {n for p, n in seeds if p == q}, {}
        for hop in range(1, hops + 1):
            new = sorted((e for e in best if e not in found and {e[0], e[2]} & (front - {None})), key=lambda e: (-best[e], e[0] is not None, e[0] or 0, e[2] is not None, e[2] or 0, e[1], e[3]))
            found.update({e: hop for e in new})
            front |= {x for e in new for x in (e[0], e[2])}
        out.update({(q, *e): (found[e], i) for i, e in enumerate(list(found)[:most], 1)})
    return out


def test_around(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.choice("RAN"), rng.randrange(60), rng.randrange(9), rng.choice("jkm"), rng.randrange(50, 100) / 100) for _ in range(150)]
    edges += [(3, "R", 3, 1, "j", 0.9), (None, "R", 4, 1, "j", 0.8), (5, "A", None, 2, "k", 0.7)] + [(50, "R", i, 1, "j", 0.6) for i in range(100, 140)]  # a hub
    seeds = [(q, rng.randrange(60)) for q in range(25)] + [(99, 50), (99, 3), (98, 777)]
    table, start = spark.createDataFrame(edges, "head long, relation string, tail long, article long, jurisdiction string, confidence double"), spark.createDataFrame(seeds, "question long, entity long")
    for hops, most, allowed in ((1, 12, None), (2, 12, None), (2, 6, ("j", "k")), (3, 40, ("j",))):
        got = {(r["question"], r["head"], r["relation"], r["tail"], r["article"]): (r["hop"], r["place"]) for r in V.around(start, table, hops, most, allowed).collect()}
        assert got == walked(seeds, edges, hops, most, allowed)
    assert V.around(start, table.limit(0)).isEmpty()


def test_quoted(spark):
    found = spark.createDataFrame([(1, a, p) for p, a in enumerate([4, 4, 2, 9, 1], 1)], "question long, article long, place int")
    texts = spark.createDataFrame([(4, "four"), (2, "é" * 30), (1, "one"), (8, "eight")], "article long, text string")
    assert sorted(map(tuple, V.quoted(found, texts, 3, 20).collect())) == [(1, 2, 2, "é" * 20 + "...(cut)", 5), (1, 4, 1, "four", 5)]
