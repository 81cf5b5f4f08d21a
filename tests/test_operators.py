"""Hand-checked cases."""

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import evaluation as E
from lexquarry.operators import graph as G
from lexquarry.operators import ordered as O
from lexquarry.operators import ranking as R
from lexquarry.operators import search as S
from lexquarry.sources import articles as A
from lexquarry.sources import upserts as U
from lexquarry.streaming import ledger as L


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x"))
    return row.first()[0]


def ranked_list(spark, items):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(items)], "q int, item string, rank int")


def test_rrf(spark):
    got = R.rrf([ranked_list(spark, "abc"), ranked_list(spark, "cda")], ["q"], "item").orderBy("rank").collect()
    assert [r["item"] for r in got] == ["a", "c", "b", "d"]
    assert got[0]["score"] == pytest.approx(0.03226646, abs=1e-8) and got[2]["score"] == pytest.approx(0.01612903, abs=1e-8)


def test_rrf_does_not_depend_on_row_order(spark):
    a, b = ranked_list(spark, "abcdef"), ranked_list(spark, "fcxyab")
    plain = R.rrf([a, b], ["q"], "item").orderBy("rank").collect()
    mixed = R.rrf([a.orderBy(F.desc("rank")), b.orderBy("item")], ["q"], "item").orderBy("rank").collect()
    assert plain == mixed


def test_round_robin(spark):
    df = ranked_list(spark, ["x1", "x2", "x3", "y1", "z1", "y2"]).withColumn("g", F.substring("item", 1, 1))
    assert [r["item"] for r in R.round_robin(df, ["q"], "g", 5).orderBy("place").collect()] == ["x1", "y1", "z1", "x2", "y2"]
    same = df.withColumn("g", F.lit("x"))
    assert [r["item"] for r in R.round_robin(same, ["q"], "g", 2).orderBy("place").collect()] == ["x1", "x2"]


def test_metrics(spark):
    run = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("xaybz")], "query string, item string, rank int")
    gold = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 1), ("none", "a", 0)], "query string, item string, relevance int")
    n = {r["query"]: r["ndcg"] for r in E.ndcg(run, gold, "query", "item", 5).collect()}
    assert n["q"] == pytest.approx(0.562456, abs=1e-6) and n["none"] is None
    m = E.metrics(run, gold, "query", "item", (3, 5)).collect()
    assert len(m) == 1 and (m[0]["mrr"], m[0]["recall_3"], m[0]["precision_5"], m[0]["r_precision"]) == (0.5, 0.333333, 0.4, 0.333333)


def test_sign_test(spark):
    assert E.sign_test(10, 2) == pytest.approx(0.0386, abs=1e-4) and E.sign_test(11, 1) == pytest.approx(0.0063, abs=1e-4) and E.sign_test(0, 0) == 1
    assert one(spark, E.sign_test_column(F.col("a"), F.col("b")), a=10, b=2) == pytest.approx(E.sign_test(10, 2))


def test_weighted_jaccard(spark):
    w = spark.createDataFrame([("A", "p", 3), ("A", "q", 1), ("B", "p", 1), ("B", "r", 2)], "o string, k string, w int")
    pairs = spark.createDataFrame([("A", "B")], "a string, b string")
    assert S.weighted_jaccard(w, "o", "k", "w", pairs).first()["jaccard"] == pytest.approx(1 / 6, abs=1e-6)


@pytest.mark.parametrize(("text", "want"), [("32BA", "032BA"), ("5", "005"), ("End0", "End0"), ("1234", "1234")])
def test_padded_article(spark, text, want):
    assert one(spark, X.padded_article(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("十五", 15), ("二十一", 21), ("一百零三", 103), ("１２", 12), ("〇", 0), ("三万二千", 32000), ("abc", None)])
def test_chinese_number(spark, text, want):
    assert one(spark, X.chinese_number(F.col("t")), t=text) == want


def test_dates(spark):
    assert one(spark, X.best_date("a", "b"), a="0000-00-00", b="2019") == "2019-01-01"
    assert one(spark, X.best_date("a", "b"), a="", b="2011-08-12T00:00") == "2011-08-12"


def test_signature_and_lines(spark):
    assert one(spark, X.numeral_signature(F.col("t")), t="罚款5万至10万元") == "10|5|万|万"
    assert one(spark, X.merged_lines(F.col("t")), t="(\na\n)\nText") == "(a)\nText"


def test_references():
    assert X.own_references("第一條 依第二條及《某法》第五條，第12條", 1) == [2, 12]
    assert X.own_references("依第二條，《某法第三條》及第 兩 條、《收費總表》 第五條", None) == [2]
    assert X.own_references("第7/2023號法律第三十六條及第四條。第9條", None) == [9]
    assert X.cross_references("第7/2023號法律第三十六條") == [("MAC_LEI_7_2023", 36)]
    assert X.cross_references("第 5 / 2009 號 行政法規的第十七條") == [("MAC_REG_5_2009", 17)]
    assert X.cross_references("第5/2009號行政法規，第7條") == [] and X.cross_references("第9/2020號法令第3條") == []
    assert X.cross_references("第32章第 12 條，第32章第12條", "HK_CAP_1") == [("HK_CAP_32", 12)] and X.cross_references("第32章第12條", "HK_CAP_32") == []
    assert X.number_of("一百零三") == 103 and X.number_of("兩") == 2


def test_chunks_cover_the_text():
    text = "".join(f"Sentence {i}. " for i in range(400))
    parts = X._windows(text, 800, 150, ".")
    assert all(len(p) <= 800 for p in parts) and parts[0] == text[: len(parts[0])] and text.endswith(parts[-1])
    joined = parts[0]
    for p in parts[1:]:
        k = max(k for k in range(0, len(p) + 1) if joined.endswith(p[:k]))
        joined += p[k:]
    assert joined == text
    assert X._windows("", 800, 150, ".") == []
    assert len(X._windows("x" * 1000, 100, 99, ".")) == 19  # at most half a window overlaps


def test_classifier(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "b c d"), (3, "b c d e"), (4, "alpha stop"), (5, None)], "doc_id int, text string")
    tax = spark.createDataFrame([("t", "alpha", "strong"), *(("t", x, "weak") for x in ("b", "c", "d", "e ")), ("t", "stop", "exclude")], "topic string, keyword string, kind string")
    tax = tax.filter("keyword != 'e '").union(spark.createDataFrame([("t", "e", "weak")], "topic string, keyword string, kind string"))
    got = {r["doc_id"]: r["score"] for r in X.classified(docs, tax.filter("keyword not in ('b', 'c', 'd', 'e')"), "doc_id", "text").collect()}
    assert got == {1: 1.0}
    got = {r["doc_id"]: r["score"] for r in X.classified(docs, tax.filter("keyword != 'alpha'"), "doc_id", "text").collect()}
    assert got == {3: 1.2}


def test_overlap(spark):
    tail = "x" * 10 + "".join(chr(97 + i % 26) for i in range(40))
    assert one(spark, O.overlap(F.col("a"), F.col("b")), a=tail, b=tail[-40:] + "more") == 40
    assert one(spark, O.overlap(F.col("a"), F.col("b")), a=tail, b=tail[-20:] + "more") == 0


def test_carried_and_backfilled(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([None, "Ch1", None, "Ch2", None])], "law int, n int, c string")
    assert [r["x"] for r in O.carried(df, ["law"], [F.col("n")], F.col("c"), "x").orderBy("n").collect()] == [None, "Ch1", "Ch1", "Ch2", "Ch2"]
    df = spark.createDataFrame([(1, 0, ""), (1, 1, "2020-01-01"), (1, 2, None)], "f int, n int, d string")
    assert {r["d"] for r in O.backfilled(df, ["f"], [F.col("n")], ["d"]).collect()} == {"2020-01-01"}


def test_graph(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in G.components(e).collect()}
    assert {roots[i] for i in range(21)} == {0} and {roots[i] for i in (30, 31, 32)} == {30}
    far = {r["node"]: r["hops"] for r in G.distances(e, spark.sql("select 0L as node"), 4).collect()}
    assert far == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}  # depth included
    ranks = G.pagerank(e, 60).collect()
    assert sum(r["rank"] for r in ranks) == pytest.approx(1)
    star = spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long")
    got = {r["node"]: r["betweenness"] for r in G.betweenness(star).collect()}
    assert got[0] == pytest.approx(1.0) and got.get(1, 0) == 0


def test_communities(spark):
    clique = lambda nodes: [(a, b) for a in nodes for b in nodes if a < b]
    e = spark.createDataFrame([*clique(range(5)), *clique(range(10, 15)), (4, 10)], "a long, b long")
    labels = G.communities(e)
    found = {r["node"]: r["community"] for r in labels.collect()}
    assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(10, 15)}) == 1
    assert G.modularity(e, labels).first()["modularity"] > 0.3


def test_two_hop_score(spark):
    e = spark.createDataFrame([("a", "b", "imposes", 0.9), ("b", "c", "imposes", 0.8)], "head string, tail string, relation string, confidence double")
    got = {(r["mid"], r["end"]): r["score"] for r in G.two_hop_paths(e, spark.sql("select 'a' as node"), {"imposes": 1.15}).collect()}
    assert got[("b", "c")] == pytest.approx(0.9522, abs=1e-6)
    back = {(r["mid"], r["end"]): r["score"] for r in G.two_hop_paths(e, spark.sql("select 'c' as node"), {"imposes": 1.15}).collect()}
    assert back[("b", None)] == pytest.approx(0.8 * 1.15 * 0.6, abs=1e-6)


def test_upserts(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    both = U.upsert(rows(("a", 1), ("b", 1)), rows(("b", 2), ("c", 2)), ["id"])
    assert sorted(map(tuple, both.collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert [r["id"] for r in U.prune(rows(("a", 1), ("b", 1)), rows(("a", 0)), ["id"]).collect()] == ["a"]
    moved = U.renamed_ids(rows(("L1_ART_2", 1), ("L10_ART_2", 1)), spark.createDataFrame([("L1", "M9")], "old string, new string"), "id")
    assert sorted(r["id"] for r in moved.collect()) == ["L10_ART_2", "M9_ART_2"]
    assert U.next_id(rows(("X_7", 1), ("X_12", 1)), "id", "X_").first()["id"] == "X_13"
    filled = U.backfill(rows(("a_sub_0", 1), ("b_sub_3", 1)), spark.createDataFrame([("a", "schedule")], "id string, kind string"), "id", "kind")
    assert {r["id"]: r["kind"] for r in filled.collect()} == {"a_sub_0": "schedule", "b_sub_3": None}


def test_articles(spark, tmp_path):
    import json

    def put(name, x):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(x, ensure_ascii=False))

    put("macau/A_1_cleaned.json", [{"doc_id": "A_1_ART_001", "text_zh": "第一條 文本。", "article_number": "1", "topics": ["t1"]}, {"doc_id": "A_1_ART_002", "text_zh": " ", "text_en": "Second. " * 200, "article_number": "2"}])
    put("hk/B_2.json", {"law_id": "B_2", "jurisdiction": "hk", "articles": [{"doc_id": "B_2_ART_001", "text_en": "Third.", "article_number": "1"}]})
    put("hk/recycle_bin/C_3.json", [{"doc_id": "C_3_ART_001", "text_en": "gone", "article_number": "1"}])
    a = A.read_articles(spark, str(tmp_path)).cache()
    assert sorted((r["doc_id"], r["law_id"], r["jurisdiction"]) for r in a.collect()) == [("A_1_ART_001", "A_1", "macau"), ("A_1_ART_002", "A_1", "macau"), ("B_2_ART_001", "B_2", "hk")]
    c = A.chunks(a)
    ids = [r["id"] for r in c.filter("law_id = 'A_1'").orderBy("chunk_index").collect()]
    assert ids[0] == "A_1_ART_001_sub_0" and ids[-1].startswith("A_1_ART_002_sub_")
    laws = {r["law_id"]: (r["total_articles"], r["total_chunks"]) for r in A.catalog(c).collect()}
    assert laws["B_2"] == (1, 1) and laws["A_1"][0] == 2


def test_ledger_stream(spark, tmp_path):
    line = '{"ts":"2024-01-01T00:00:%02d","model":"m","purpose":"p","total_tokens":%d,"latency_s":1.0,"ok":true}'
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([line % (i, i) for i in range(5)] + ["not json"]))
    stream = lambda: L.ledger_stream(spark, str(folder)).filter("ts is not null")
    assert L.append_new(stream(), out, mark).count() == 5
    (folder / "b.jsonl").write_text(line % (30, 9))
    assert sorted(r["total_tokens"] for r in L.append_new(stream(), out, mark).collect()) == [0, 1, 2, 3, 4, 9]
    assert L.ledger_table(spark, str(folder)).count() == 6
