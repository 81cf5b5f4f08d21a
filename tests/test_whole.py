"""Queries without SQL against brute force over whole tables: no row of the input may be lost."""

import numpy as np

from lexquarry.plans.all import REGISTRY

from .conftest import SMALL


def rows(spark, name, folder=SMALL):
    return REGISTRY[name].run(spark, str(folder)).collect()


def nearest(spark, k):
    """Both directions of the edges from each vector to its nearest, as a matrix over all vectors."""
    e = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())
    ids, v = np.array([i for i, _ in e]), np.array([x for _, x in e], float)
    cos = np.round(v @ v.T, 9)
    np.fill_diagonal(cos, -2)
    near = np.zeros(cos.shape, bool)
    for i, row in enumerate(cos):
        near[i, np.lexsort((ids, -row))[:k]] = True
    return ids, near | near.T


def test_betweenness_of_all_vectors(spark):
    ids, near = nearest(spark, 2)
    n = len(ids)
    dist, paths = np.where(np.eye(n, dtype=bool), 0.0, np.inf), np.eye(n)
    front, hop = np.eye(n), 0
    while front.any():
        hop, step = hop + 1, front @ near
        front = np.where(np.isinf(dist), step, 0)
        dist[front > 0], paths = hop, paths + front
    want = {}
    for v in range(n):
        through = (dist[:, [v]] + dist[[v], :] == dist) & np.isfinite(dist)
        through[v], through[:, v] = False, False
        np.fill_diagonal(through, False)
        share = np.divide(paths[:, [v]] * paths[[v], :], paths, out=np.zeros((n, n)), where=through)
        want[int(ids[v])] = share.sum() / ((n - 1) * (n - 2))
    got = {r["node"]: r["betweenness"] for r in rows(spark, "betweenness_exact")}
    assert n > 150 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_communities_of_all_vectors(spark):
    ids, near = nearest(spark, 3)
    got = {r["node"]: r["community"] for r in rows(spark, "label_communities")}
    assert sorted(got) == ids.tolist() and len(ids) > 150
    parts = {}
    for i in range(len(ids)):  # what a community's nodes reach stays in one component of the whole graph
        parts.setdefault(i, i)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            least = min(parts[j] for j in (i, *np.flatnonzero(near[i])))
            changed, parts[i] = changed or least != parts[i], least
    root = {int(ids[i]): p for i, p in parts.items()}
    assert all(root[n] == root[c] for n, c in got.items())


def test_bootstrap_counts_all_judgements(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    gold = {}
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        if r["doc_id"] in docs and int(r["quality"] + r["quality"] * (1 - r["toxic"])) > 0:
            gold.setdefault(docs[r["doc_id"]]["source"], set()).add(r["doc_id"])
    deltas = []
    for source, ids in gold.items():
        run = [d["doc_id"] for d in sorted((d for d in docs.values() if d["source"] == source), key=lambda d: (-d["n_chars"], d["doc_id"]))][:20]
        deltas.append((len(ids & set(run)) - len(ids & set(run[:5]))) / len(ids))
    assert abs(rows(spark, "bootstrap_interval")[0]["mean"] - sum(deltas) / len(deltas)) < 2e-6
