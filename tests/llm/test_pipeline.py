"""Stages against brute force, each on its own input; the whole over a small table."""

import re

import corpus_pipeline
import pytest

from tests.conftest import SMALL
from tests.llm.test_operators import ngrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SMALL).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs.toPandas(), result.toPandas()))
        docs = result
    return out


def test_order_and_columns(steps):
    assert [n for n, *_ in steps] == ["quality_rules", "exact_dedup", "near_duplicates", "mixing", "packing"]
    assert all(list(b.columns) == list(a.columns) for _, a, b in steps[:-1])


def test_quality_stage(steps):
    _, a, b = steps[0]
    for d, t in zip(a.doc_id, a.text, strict=True):
        w = WORD.findall(t)
        s = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, x in enumerate(s) if s.count(x) > 1 for j in range(i, i + 8)} if len(set(s)) < len(s) else set()
        bad = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert (d in set(b.doc_id)) == (not bad)


def test_exact_stage(steps):
    _, a, b = steps[1]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for d, t in zip(a.doc_id, a.text, strict=True):
        best[bare(t)] = min(best.get(bare(t), (0, 0)), (-len(t), d)) if bare(t) in best else (-len(t), d)
    assert set(b.doc_id) == {d for _, d in best.values()}


def test_near_stage(steps):
    _, a, b = steps[2]
    sets = dict(zip(a.doc_id, map(ngrams, a.text), strict=True))
    group = {d: d for d in sets}
    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if v == old else v for k, v in group.items()}
    assert set(b.doc_id) == set(group.values()) and len(b) == len(set(b.doc_id))


def test_mixing_stage(steps):
    _, a, b = steps[3]
    size = {d: len(WORD.findall(t)) for d, t in zip(a.doc_id, a.text, strict=True)}
    taken = b.text.map(lambda t: len(WORD.findall(t))).groupby(b.doc_id).sum()
    assert all(n <= 3 * size[d] for d, n in taken.items())
    assert abs(taken.sum() - sum(size.values())) <= a.source.nunique()
    assert (b.n_chars == b.text.str.len()).all()


def test_packing_stage(steps):
    _, a, b = steps[4]
    assert b.sequence_id.is_unique and ((b.length & (b.length - 1)) == 0).all() and b.length.max() <= 1024
    assert b.length.sum() == b[b.start == 0].doc_tokens.sum() and (b.start == 0).sum() == len(a)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SMALL).count() == len(steps[-1][2])
