"""Hard negatives, the filter audit and toxicity against brute force, with nulls, ties, repeated rows, odd vectors and clashing columns."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import filter_audit, hard_negatives, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, label int, block long, ablock long, windows string, x string, score string"


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8)) / 3
    rows = [(i, (base[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(430)]
    hot = rows[9][1]
    rows += [(i, hot, i % 3) for i in range(430, 600)]  # one very common vector: ties at every place
    rows += [rows[100], rows[100], rows[205], (600, [], 1), (700, [], 2), (601, hot[:5], 0), (602, hot + [0.5], 1)]
    rows += [(None, hot, 1), (603, None, 1), (604, hot, None), (605, [1.0, None], 1), (606, [float("nan")] * 8, 1), (607, [float("inf")] * 8, 2), (-100, rows[3][1], 2)]
    return rows


def mined(rows, every=100, positives=5, negatives=10):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, l, v) in enumerate(good):
        if i % every == 0:
            scored = sorted((-dot(v, w), j, m) for b, (j, m, w) in enumerate(good) if b != at)
            for p, j, _ in [x for x in scored if x[2] == l][:positives]:
                far = [x for x in scored if x[2] != l and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
                out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(far)]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 7, 1, "w", "x", "s") for r in vectors()], VECTORS).repartition(5)


@pytest.mark.parametrize(("digit", "anchors", "cells"), [(10, 2048, 1 << 20), (3, 2, 300)])
def test_hard_negatives(table, monkeypatch, digit, anchors, cells):
    """Whatever the width of a digit and the size of blocks."""
    monkeypatch.setattr(hard_negatives, "DIGIT", digit)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    got = sorted(map(tuple, hard_negatives.hard_negatives(table).collect()))
    assert got == mined(vectors()) and len(got) > 200


def test_digits_stop_at_what_a_window_wants():
    """A block never sends more digits than the window still wants rows, however many rows it has."""
    w = {"by_id": False, "hi": 10_000, "lo": 0, "left": 5, "shift": 3, "id_lo": 0, "id_hi": 9}
    scores = np.arange(10_001)
    got = list(hard_negatives._counted(w, scores, scores))
    assert got == [(0, 8, 5)]
    ties = list(hard_negatives._counted(w | {"by_id": True, "hi": 7, "shift": 0, "id_lo": 2, "id_hi": 90}, np.full(50, 7), np.arange(50)))
    assert ties == [(i, 1, 5) for i in range(5)]


def test_hard_negatives_of_large_whole_numbers(spark):
    """Scores beyond 2^53 are exact; those beyond a long are refused."""
    rows = [(i, [float(2**20 + 3 * i), 1.0, float(i)], i % 2) for i in range(0, 300, 25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, least=0, most=100).collect())) == [r for r in mined_between(rows)]
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<double>, label int"))


def mined_between(rows):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows]
    out = []
    for i, l, v in good:
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in good if j != i)
            for p, j, _ in [x for x in scored if x[2] == l][:5]:
                far = [x for x in scored if x[2] != l and 0 <= -x[0] <= -p][:10]
                out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(far)]
    return sorted(out)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none).count() == 0
    only_nulls = spark.createDataFrame([(0, None, 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(only_nulls).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (5, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(alone).count() == 0


DOCS = "doc_id long, text string, lang string, part string, digest string, first string, A string, words string, step int"


def documents():
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "bb", "Ccc", "dd#", "é", "Ω", "x\x0bz", "|"]) + (str(rng.randrange(300)) if rng.random() < 0.8 else "")
    rows = []
    for i in range(160):
        text = rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.choice([0, 3, 150, 199, 200, 201, 500])))
        if i % 3:
            text = text.replace("#", "").replace("|", "")
        rows.append((i, text.lower() if i % 4 else text, rng.choice(["en", "de", "", None])))
    rows += [(i, rows[7][1], "en") for i in range(160, 220)]  # a large group of copies
    rows += [(220, None, None), (221, "", "en"), (222, " \n", "en"), (223, "word " * 30_000, "de"), (224, "﻿nul\x00l", "\x00"), rows[5], rows[5], (None, rows[7][1], "en"), (None, "alone with no id", "fr"), (None, "alone with no id", "fr")]
    return rows


def audited(rows, labels):
    order_of = [i if i is not None else math.inf for i, _, _ in rows]
    least = {}
    for i, (_, text, _) in zip(order_of, rows, strict=True):
        least[text or ""] = min(i, least.get(text or "", math.inf))
    docs = []
    for i, (doc, text, lang) in zip(order_of, rows, strict=True):
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i > least[t]}
        mine = [l for l in labels if l[0] == doc and doc is not None]
        docs.append((lang or "", fails, any(l[1] == 1 for l in mine), any(l[2] == 1 for l in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        mine, all_removed = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                failing = [d for d in mine if d[1][f]]
                out[part, "".join(order), step] = [len(stay), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                all_removed[f] += len(gone)
                left = stay
        for (p, order, step), v in out.items():
            if p == part:
                v.append(all_removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 225, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*r, "p", "d", "f", "A", "w", 9) for r in documents()], DOCS).repartition(4)
    got = filter_audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited(documents(), labels)
    assert len(got) == len(want) == 600 * 5
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got} == want


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {(r["part"], r["unique_fails"], r["shapley"]) for r in one if r["filter_order"][r["step"] - 1] == "A"} == {("", 1, 120)}
    assert {r["removed"] for r in one if r["filter_order"][r["step"] - 1] != "A"} == {0}


def labelled(n=900):
    rng = random.Random(1)
    clean, bad = [f"word{i}" for i in range(400)], ["vile", "rotten", "awful"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(clean, k=rng.randrange(5, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad).capitalize() + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(w), "en", 1.5))
        if i % 10 != 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled()
    docs += [(5000, None, "en", 0.0), (5001, "", "en", 0.0), (5002, " \n ", "en", 0.0), (5003, "word1 " * 40_000 + "vile rotten", "en", 0.0), docs[0], docs[0], (None, "vile awful", "en", 0.0), (None, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3)
    t = spark.createDataFrame([*labels, labels[0], (None, 1), (77, None), (6000, 1)], "doc_id long, toxic int")
    weights = toxicity.fitted(d, t)
    out = toxicity.scored(d, weights)
    assert out.columns == ["doc_id", "text", "lang", "score", "score_"] and out.count() == len(docs)
    got = [(r["doc_id"], r["text"], r["score_"]) for r in out.collect()]
    truth = dict(labels)
    held = [(truth[i], s) for i, _, s in got if i in truth and zlib.crc32(str(i).encode()) % 3 == 1]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    assert len(pos) > 30 and sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.99
    assert sum(p >= 0.7 for p in pos) / len(pos) > 0.9 and not any(n >= 0.7 for n in neg)
    of = {i: s for i, _, s in got}
    assert of[5000] == of[5001] == of[5002] < 0.5 and of[5003] > 0.7 and all(0 <= s <= 1 for _, _, s in got)
    again = sorted((str(k), v) for k, v in ((r["doc_id"], r["score_"]) for r in toxicity.scored(d.repartition(7), toxicity.fitted(d.repartition(2), t)).collect()))
    assert again == sorted((str(i), s) for i, _, s in got)
    assert weights.count() < 300  # L1: of some thousand features


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    fit = lambda rows: sorted(map(str, toxicity.fitted(d, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()))
    assert fit(labels) == fit(turned)
    flags = {r["doc_id"]: r["h"] for r in d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in flags}


def test_toxicity_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(none, toxicity.fitted(none, labels)).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [r["score"] for r in toxicity.scored(one, toxicity.fitted(one, labels)).collect()] == [0.0]


def test_ftrl_matches_the_plain_recurrence():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    rows = [np.append(r, 12) for r in rows]
    y = np.array([float(3 in r) for r in rows])
    got = toxicity.ftrl(rows, y, 13, 0.7, 1.0, 0.4, 0.1, 3)
    z, n, order = [0.0] * 13, [0.0] * 13, np.random.default_rng(5)
    w = lambda i: 0.0 if abs(z[i]) <= (l1 := 0.0 if i == 12 else 0.4) else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.7 + 0.1)
    for _ in range(3):
        for r in order.permutation(60):
            ws = {i: w(i) for i in rows[r]}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y[r]
            for i, wi in ws.items():
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
                z[i] += g - s * wi
                n[i] += g * g
    assert np.allclose(got, [w(i) for i in range(13)]) and got[3] > 1
