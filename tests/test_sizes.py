"""What has to hold for large tables: what leaves a task is bounded, and nothing is done twice."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexquarry.operators import ordered as O
from lexquarry.operators import search as S
from lexquarry.plans.all import REGISTRY
from lexquarry.plans.graphs import near_graph

from .conftest import SMALL


def sides(v, ids, most):
    """Blocks of a task as batches of (block, left, right)."""
    side = lambda x, i: {"dim": x.shape[1], "kind": "<f8", "ids": i.astype("<i8").tobytes(), "v": x.tobytes(), "names": [None], "sizes": [len(i)]}
    for at in range(0, len(ids), most):
        yield pa.RecordBatch.from_pylist([{"block": 0, "left": side(v, ids), "right": side(v[at : at + most], ids[at : at + most])}])


def test_a_task_returns_k_rows_of_each_vector():
    """However many right blocks it meets, and however many vectors tie."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 8))
    v[200:500] = v[200]  # copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[600:650] = v[599] + rng.normal(size=(50, 8)) * 3e-8  # apart by less than single precision tells
    ids = rng.permutation(700)
    got = pa.Table.from_batches(S._kept(3, True, None)(sides(v, ids, 150))).to_pylist()
    assert len(got) == 3 * 700
    cos = np.round(v @ v.T, 9)
    np.fill_diagonal(cos, -np.inf)
    want = {(int(ids[i]), int(b)) for i in range(700) for b in ids[np.lexsort((ids, -cos[i]))[:3]]}
    assert {(r["a"], r["b"]) for r in got} == want


def test_nearest_of_odd_vectors(spark):
    """Huge vectors, vectors that aren't finite, missing ones and repeated ids."""
    rows = [(i, [1e25 * (i + 1), float(-i)]) for i in range(5)] + [(7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, None), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["a"], r["b"], r["rank"]) for r in S.knn(df, df, "id", "v", 2).collect()}
    assert {(a, b) for a, b, k in got if k == 1 and a != 3} == {(0, 4), (1, 4), (2, 4), (4, 3)}
    assert not {7, 8, 9} & {x for r in got for x in r[:2]} and all(a != b for a, b, _ in got)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_nearest_graph_is_searched_once(spark):
    """What reads it several times reads what was found, not the vectors."""
    assert "MapInArrow" not in plan(near_graph(spark.read.parquet(f"{SMALL}/embeddings.parquet")))


def test_mutual_best_searches_once(spark):
    assert "MapInArrow" not in plan(REGISTRY["mutual_best_matrix"].run(spark, SMALL))


def test_groups_are_masked_before_the_cut():
    """Neighbours of other groups, of the same group, and rows without a group, over several right blocks; k rows of each at most."""
    rng = np.random.default_rng(6)
    v, ids, g = rng.normal(size=(400, 8)), np.arange(400), np.sort(rng.integers(0, 4, 400))

    def side(i):
        names, sizes = np.unique(g[i], return_counts=True)
        return {"dim": 8, "kind": "<f8", "ids": ids[i].astype("<i8").tobytes(), "v": v[i].tobytes(), "names": [None if n == 3 else str(n) for n in names], "sizes": sizes.tolist()}

    blocks = [pa.RecordBatch.from_pylist([{"block": 0, "left": side(ids), "right": side(ids[at : at + 90])}]) for at in range(0, 400, 90)]
    for same in (True, False):
        cos = np.where(((g[:, None] == g[None, :]) == same) & (g < 3)[:, None] & (g < 3)[None, :], v @ v.T, -np.inf)
        np.fill_diagonal(cos, -np.inf)
        want = {(i, int(j)) for i in range(400) for j in np.argsort(-cos[i])[:5] if np.isfinite(cos[i, j])}
        got = pa.Table.from_batches(S._kept(5, True, same)(iter(blocks))).to_pylist()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def most_rows(df):
    """The most rows that an operator of the finished plan has made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_name_pairs_are_not_broadcast(spark):
    """Forms are far more than the file that Spark judges them by."""
    got = REGISTRY["levenshtein_pairs"].run(spark, SMALL)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_lexical_network_meets_kinds_of_parts(spark, tmp_path):
    """Parts with the same words are met once, whatever their number; the rows are those of all pairs."""
    names, kinds = ["red bolt", "blue bolt", "red ring", "big blue pin"], ["SMALL", "LARGE"]
    rows = [(i, names[i % 4], f"Brand#{i % 5}", kinds[i % 7 % 2]) for i in range(3000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    df = REGISTRY["lexical_network"].run(spark, str(tmp_path))
    assert most_rows(df) < 20_000
    words = {i: (law, set(f"{n} {k.lower()}".split())) for i, n, law, k in rows if law in ("Brand#0", "Brand#1", "Brand#2")}
    want = set()
    for a, (la, wa) in list(words.items())[:60]:
        near = sorted((-round(len(wa & wb) / len(wa | wb), 6), b) for b, (lb, wb) in words.items() if la < lb and len(wa & wb) / len(wa | wb) >= 0.2)
        want |= {(a, b, -x, p + 1) for p, (x, b) in enumerate(near[:3])}
    assert {tuple(r) for r in df.select("a", "b", "jaccard", "place").collect() if r["a"] in dict(list(words.items())[:60])} == want


def test_overlap_of_all_lengths(spark):
    """Against trying every length; the lengths are tried only where the first place found doesn't fit."""
    rng, rows = random.Random(1), []
    for i in range(600):
        letters = rng.choice(["a", "ab", "aé日", "abcdefgh"])
        word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))  # noqa: B023, E731
        before = word(40)
        rows.append((before if i % 50 else None, before[len(before) - rng.randrange(len(before) + 1) :] + word(20) if i % 61 else None))
    cut = O.overlap(F.col("b"), F.col("t"), 3, 12)
    got = spark.createDataFrame(rows, "b string, t string").select("b", "t", cut.alias("k")).collect()
    for b, t, k in got:
        assert k == max([n for n in range(3, 13) if b and t and n <= min(len(b), len(t)) and t[:n] == b[-n:]], default=0)
    assert "instr" in str(cut)
