"""Queries that fold ordered rows, against the fold over all rows: candidates may be reduced only where the result is the same."""

import random
from collections import Counter

import pytest

from lexquarry.plans.all import REGISTRY


def rows(spark, name, folder):
    return REGISTRY[name].run(spark, str(folder)).collect()


@pytest.mark.parametrize("case", ["hot source", "copies", "mixed", "few"])
def test_quota_reaches_its_total(spark, tmp_path, case):
    rng = random.Random(case)
    docs = []
    for i in range(2500):
        if case == "hot source":  # the longest 900 are of one source
            n, source, text = (9000 - i, "hot", f"h{i}") if i < 900 else (5000 - i, f"s{i % 30}", f"t{i}")
        elif case == "copies":  # a long text 900 times, over 300 sources
            n, source, text = (9000, f"s{i % 300}", "copy") if i < 900 else (5000 - i, f"s{i % 300}", f"t{i}")
        elif case == "mixed":
            k = rng.randrange(40)
            n, source, text = 1000 - k, f"s{rng.randrange(9)}", f"t{k}"
        else:
            n, source, text = rng.randrange(50), rng.choice("ab"), rng.choice([None, "x", "y"])
        docs.append((i, rng.choice(["en", "fr"]), source, text, n))
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for lang in ("en", "fr"):
        taken, seen, each = [], set(), Counter()
        for d in sorted((d for d in docs if d[1] == lang), key=lambda d: (-d[4], d[0])):
            if len(taken) < 12 and each[d[2]] < 2 and d[3] not in seen:
                taken.append((lang, len(taken), d[0], d[2]))
                each[d[2]] += 1
                seen |= {d[3]} - {None}
        want += taken
    assert case == "few" or len(want) == 24
    assert sorted(map(tuple, rows(spark, "greedy_quota", tmp_path))) == sorted(want)


def test_topics_of_all_names(spark, tmp_path):
    rng = random.Random(1)
    names = [f"{'ab' * (i % 3)}{i:03d}" for i in range(60)] + ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(150)]
    part = [(n,) for i, n in enumerate(names) for _ in range(1 + max(0, 60 - i))]
    spark.createDataFrame(part, "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    kept = []
    for n, _ in sorted(Counter(n for (n,) in part).items(), key=lambda x: (-x[1], x[0])):
        if all(len(set(n) & set(k)) / len(set(n) | set(k)) < 0.7 for k in kept):
            kept.append(n)
    assert [r["p_name"] for r in sorted(rows(spark, "greedy_topics", tmp_path), key=lambda r: r["place"])] == kept


def test_edges_of_nodes_that_come_late(spark, tmp_path):
    rng = random.Random(2)
    items = [(rng.choice("AR"), rng.randrange(400), rng.randrange(400)) for _ in range(12000)]
    items += [("A", 39, b) for b in range(1, 5)]
    spark.createDataFrame(items, "l_returnflag string, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    weight = Counter((f, str(a % 40), str(b % 40)) for f, a, b in items if a % 40 != b % 40)
    want = []
    for flag in "AR":
        degree, place = Counter(), 0
        for (_, a, b), _ in sorted(((k, n) for k, n in weight.items() if k[0] == flag), key=lambda x: (-x[1], x[0][1:])):
            if degree[a] < 8 or degree[b] < 8:
                want.append((flag, place, a, b))
                place += 1
                degree[a] += 1
                degree[b] += 1
    assert sorted(map(tuple, rows(spark, "degree_capped_edges", tmp_path))) == sorted(want)
