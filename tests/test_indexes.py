"""Stored indexes against the operators that go over whole tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.operators import search as S
from lexquarry.operators.inverted import LexicalIndex
from lexquarry.operators.vector_index import VectorIndex

WORDS = [f"w{i}" for i in range(80)]


def corpus(n=900):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(80)], k=rng.randrange(0, 30)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, docs[5][1]), (n + 3, docs[5][1]), (n + 4, "once")]
    docs += [(n + 10 + i, "rare w0") for i in range(15)]
    queries = [(100 + i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 6)))) for i in range(25)] + [(200, "nowhere"), (201, None), (202, ""), (203, "rare once"), (204, "rare")]
    return docs, queries


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    docs, queries = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query string")


def test_index_gives_the_rows_of_bm25(spark, tables, tmp_path):
    docs, queries = tables
    index = LexicalIndex(spark, str(tmp_path), slice_size=32)
    index.add(docs)
    assert rows(index.search(queries, 7)) == rows(S.bm25_top(docs, queries, 7))
    assert rows(index.search(queries, 1000)) == rows(S.bm25_top(docs, queries, 1000))


def test_writes_and_compaction(spark, tables, tmp_path):
    docs, queries = tables
    index = LexicalIndex(spark, str(tmp_path), slice_size=50)
    index.add(docs.filter("doc_id < 400"))
    index.add(docs.filter("doc_id >= 400"))
    index.delete(docs.filter("doc_id between 100 and 300 or doc_id = 904"))
    changed = docs.filter("doc_id between 500 and 560").withColumn("text", F.concat_ws(" ", F.col("text"), F.lit("w3 rare new")))
    index.upsert(changed)
    live = docs.filter("not (doc_id between 100 and 300 or doc_id = 904 or doc_id between 500 and 560)").unionByName(changed)
    want = rows(S.bm25_top(live, queries, 9))
    assert rows(index.search(queries, 9)) == want
    index.compact()
    assert rows(index.search(queries, 9)) == want
    index.delete(live)
    assert index.search(queries, 9).count() == 0
    index.compact()
    index.add(docs)
    assert rows(index.search(queries, 9)) == rows(S.bm25_top(docs, queries, 9))


def test_blocks_that_cannot_matter_stay_closed(spark, tables, tmp_path):
    docs, queries = tables
    index = LexicalIndex(spark, str(tmp_path), slice_size=16)
    index.add(docs.coalesce(1).sortWithinPartitions("doc_id"))
    one = queries.filter("query_id = 204")
    postings = spark.read.parquet(f"{tmp_path}/postings")
    every = postings.filter("term = 'rare'").count()
    opened = spark.sparkContext.accumulator(0)
    assert index.search(one, 3, opened=opened).count() == 3
    assert opened.value <= every and opened.value < postings.count() / 20
    mixed = spark.createDataFrame([(1, "rare w0")], "query_id long, query string")
    opened = spark.sparkContext.accumulator(0)
    assert rows(index.search(mixed, 5, opened=opened)) == rows(S.bm25_top(docs, mixed, 5))
    asked = postings.filter("term in ('rare', 'w0')")
    assert opened.value <= asked.count() / 4  # w0 is in nearly every slice


def test_a_write_without_commit_does_not_count(spark, tables, tmp_path):
    docs, queries = tables
    index = LexicalIndex(spark, str(tmp_path), slice_size=64)
    index.add(docs)
    want = rows(index.search(queries, 5))
    half = LexicalIndex(spark, str(tmp_path), slice_size=64)
    half._commit = lambda seg, kind: None  # as if the writer was lost before
    half.add(docs.withColumn("text", F.lit("rare w1")))
    half.delete(docs)
    assert rows(index.search(queries, 5)) == want


def test_index_with_string_keys_and_nothing_in_it(spark, tables, tmp_path):
    from pyspark.sql import types as T

    docs, queries = tables
    index = LexicalIndex(spark, str(tmp_path), T.StringType())
    index.add(docs.limit(0))
    assert index.search(queries, 3).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    index.add(named)
    assert rows(index.search(queries, 3)) == rows(S.bm25_top(named, queries, 3))
    assert index.search(queries.limit(0), 3).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.7 * rng.normal(size=(3000, 24))
    v[2000:2900] = v[2000]  # one very common vector
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3000, None)]
    return v, spark.createDataFrame(rows, "id long, v array<double>").repartition(4).cache()


def test_vector_index_finds_nearly_all(spark, vectors, tmp_path):
    """Probes well under cells; every vector is indexed, in two batches; what is found has its exact cosine."""
    v, df = vectors
    index = VectorIndex(spark, str(tmp_path))
    index.fit(df.filter("id < 1500"), "v", cells=40)
    index.add(df.filter("id < 1000 or id is null"), "id", "v")
    index.add(df.filter("id >= 1000"), "id", "v")
    assert index.count() == 3000
    asked = df.filter("id % 20 = 0")
    got = index.search(asked, 10, "id", "v", probes=10).collect()
    cos = v @ v.T
    np.fill_diagonal(cos, -9)
    assert all(abs(r["cosine"] - cos[r["a"], r["b"]]) < 1e-6 for r in got)
    assert sorted({r["a"] for r in got}) == [i for i in range(3000) if i % 20 == 0] and all(r["rank"] <= 10 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["a"], set()).add(r["b"])
    hits = 0
    for a in by:
        least = np.sort(cos[a])[-10]
        hits += sum(cos[a, b] >= least - 1e-9 for b in by[a])
        assert len(by[a]) == 10
    assert hits / (10 * len(by)) >= 0.9


def test_vector_index_with_every_cell_is_exact(spark, vectors, tmp_path):
    _, df = vectors
    some = df.filter("id < 400")
    index = VectorIndex(spark, str(tmp_path))
    index.fit(some, "v", cells=8)
    index.add(some, "id", "v")
    asked = some.filter("id % 20 = 0")
    pairs = lambda d: {(r["a"], r["b"]) for r in d.collect()}
    assert pairs(index.search(asked, 5, "id", "v", probes=8, again=400)) == pairs(S.knn(asked, some, "id", "v", 5))
    index.delete(some.filter("id between 100 and 299"), "id")
    left = some.filter("id not between 100 and 299")
    assert index.count() == 200
    assert pairs(index.search(asked, 5, "id", "v", probes=8, again=400)) == pairs(S.knn(asked, left, "id", "v", 5))
    index.add(some.filter("id between 100 and 299"), "id", "v")
    assert pairs(index.search(asked, 5, "id", "v", probes=8, again=400)) == pairs(S.knn(asked, some, "id", "v", 5))


def test_vector_index_of_nothing(spark, vectors, tmp_path):
    _, df = vectors
    index = VectorIndex(spark, str(tmp_path))
    with pytest.raises(ValueError):
        index.fit(df.filter("v is null"), "v")
    index.fit(df.limit(5), "v", cells=3)
    index.add(df.limit(0), "id", "v")
    assert index.search(df.limit(3), 2, "id", "v").count() == 0 and index.count() == 0
