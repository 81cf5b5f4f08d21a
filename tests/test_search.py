"""Search kernels against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.operators import ordered as O
from lexquarry.operators import search as S

WORDS = [f"w{i}" for i in range(60)]


def corpus():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(WORDS, weights=[60 - j for j in range(60)], k=rng.randrange(0, 40))), "ab"[i % 2] if i % 9 else None) for i in range(300)]
    docs += [(300, None, "a"), (301, "", "b"), (302, docs[5][1], "a"), (303, docs[5][1], "b")]
    queries = [(100 + i, " ".join(rng.choices(WORDS, k=5))) for i in range(25)] + [(200, "nowhere"), (201, None), (202, "")]
    return docs, queries


def brute(docs, queries):
    toks = {d: (t or "").split() for d, t, _ in docs}
    mean = sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for q, text in queries:
        for d, t in toks.items():
            tf = Counter(t)
            score = sum(math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set((text or "").split()) if tf[w])
            if score:
                out[q, d] = round(score, 6)
    return out


@pytest.mark.parametrize("cells", [S.CELLS, 40])
def test_bm25(spark, monkeypatch, cells):
    """Ties, nulls, empty texts, and several batches of queries."""
    monkeypatch.setattr(S, "CELLS", cells)
    docs, queries = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, g string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query string")
    scores = brute(docs, queries)
    want = []
    for x, _ in queries:
        ranked = sorted(((-s, doc) for (y, doc), s in scores.items() if y == x))[:7]
        want += [(x, doc, -s, i + 1) for i, (s, doc) in enumerate(ranked)]
    assert sorted(map(tuple, S.bm25_top(d, q, 7).collect())) == sorted(want)
    by_group = {doc: g for doc, _, g in docs}
    want = []
    for x, _ in queries:
        for g in ("a", "b", None):
            want += [(x, g, doc, -s) for s, doc in sorted(((-s, doc) for (y, doc), s in scores.items() if y == x and by_group[doc] == g))[:2]]
    got = S.bm25_top(d, q, 2, group="g").drop("rank").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bm25_of_nothing(spark):
    docs, queries = corpus()
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    assert S.bm25_top(none, q, 3).count() == 0
    assert S.bm25_top(spark.createDataFrame(docs, "doc_id long, text string, g string"), q.limit(0), 3).columns == ["query_id", "doc_id", "score", "rank"]


def vectors(spark, n, width=16):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, width))
    v = centres[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    return v, spark.createDataFrame([*rows, (n, None, 1), (n + 1, v[0].tolist(), None)], "id long, v array<double>, g int").repartition(4)


def test_neighbours_within_groups(spark):
    v, df = vectors(spark, 300)
    cos = np.round(v @ v.T, 9)
    np.fill_diagonal(cos, -9)
    for same in (True, False):
        got = {(r["a"], r["rank"]): r["b"] for r in S.knn_within(df, "g", "id", "v", 4, same).collect()}
        assert not any(301 in (r["a"], r["b"]) for r in S.knn_within(df, "g", "id", "v", 4, same).collect())
        for a in range(0, 300, 7):
            allowed = [b for b in range(300) if (b % 3 == a % 3) == same and b != a]
            best = sorted(allowed, key=lambda b: (-cos[a, b], b))[:4]
            assert [got[a, i + 1] for i in range(4)] == best


def test_inverted_file_recall(spark):
    """Every vector is in the index; recall is measured against the exact operator."""
    _, df = vectors(spark, 3000)
    exact = {(r["a"], r["b"]) for r in S.knn(df.filter("id % 20 = 0"), df, "id", "v", 10).collect()}
    found = {(r["a"], r["b"]) for r in S.knn_probed(df.filter("id % 20 = 0"), df, "id", "v", 10, cells=32, probes=10).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    every = {(r["a"], r["b"]) for r in S.knn_probed(df.filter("id % 20 = 0"), df, "id", "v", 10, cells=8, probes=8).collect()}
    assert every == exact


def test_containing(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abc ", k=rng.randrange(0, 14))) for _ in range(200)]
    names = list({"".join(rng.choices("abc", k=rng.randrange(0, 5))) for _ in range(60)} | {"a", "bc"})
    t, n = spark.createDataFrame([(x,) for x in set(texts)], "t string"), spark.createDataFrame([(x,) for x in names], "n string")
    got = O.containing(t, "t", n, "n").collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x in set(texts) for y in names if y and y in x)
    cut = O.prefixed(t, "t", n.filter(F.col("n") != ""), "n").collect()
    assert sorted((r["t"], r["n"]) for r in cut) == sorted((x, y) for x in set(texts) for y in names if y and x.startswith(y))
