"""Many keywords in one pass, against plain contains."""

import random

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import search as S
from lexquarry.operators.keywords import occurring


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("letters", [4_000_000, 30])
def test_occurring(spark, letters):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abç😀 ", k=rng.randrange(0, 40))) for _ in range(200)] + ["", None]
    words = list({"".join(rng.choices("abç😀", k=rng.randrange(1, 5))) for _ in range(60)}) + ["", None, "ab", "ab"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = occurring(t, F.col("t"), spark.createDataFrame([(w,) for w in words], "w string"), "w", letters)
    assert sorted((r["i"], r["w"]) for r in got.collect()) == sorted((i, w) for i, x in enumerate(texts) if x is not None for w in set(words) if w is not None and w in x)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_nothing(spark):
    t = spark.createDataFrame([(1, "abc")], "i int, t string")
    none = spark.createDataFrame([], "w string")
    assert occurring(t, F.col("t"), none, "w").count() == 0
    assert occurring(t.limit(0), F.col("t"), spark.createDataFrame([("a",)], "w string"), "w").count() == 0
    with pytest.raises(ValueError):
        occurring(t, F.col("t"), none.withColumnRenamed("w", "i"), "i")


def test_a_hundred_thousand_keywords(spark):
    """Texts are read once: the keywords of each are those that were put there, and no others that are longer than a word."""
    words = spark.range(100_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("z")).alias("w"))
    docs = spark.range(2000).select("id", F.concat(F.lit("xx k"), F.lpad((F.col("id") * 50).cast("string"), 6, "0"), F.lit("z k"), F.lpad((F.col("id") * 50 + 200_001).cast("string"), 6, "0"), F.lit("z")).alias("t"))
    got = occurring(docs, F.col("t"), words, "w")
    assert sorted((r["id"], r["w"]) for r in got.select("id", "w").collect()) == [(i, f"k{i * 50:06d}z") for i in range(2000)]


def test_rules_and_synonyms_need_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "Tax law, new VAT rules"), (2, "nothing"), (3, None), (4, "vat only"), (5, "tax but sport")], "d int, t string")
    rules = spark.createDataFrame([("tax", "Tax", "strong"), ("tax", "vat", "weak"), ("tax", "sport", "exclude"), ("other", "nothing", "strong")], "topic string, keyword string, kind string")
    got = X.classified(docs, rules, "d", "t")
    assert sorted((r["d"], r["topic"], r["score"], r["matched"]) for r in got.collect()) == [(1, "tax", 1.3, ["Tax", "vat"]), (2, "other", 1.0, ["nothing"])]
    assert "NestedLoop" not in plan(got)
    more = S.expand_queries(docs, spark.createDataFrame([("tax", "levy"), ("tax", "duty"), ("vat", "levy")], "term string, extra string"), "d", "t")
    assert {r["d"]: r["expanded"] for r in more.collect()} == {1: "Tax law, new VAT rules duty levy", 2: "nothing", 3: "", 4: "vat only levy", 5: "tax but sport duty levy"}
    assert "NestedLoop" not in plan(more)
