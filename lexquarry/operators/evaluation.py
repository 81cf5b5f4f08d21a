"""Retrieval metrics and statistics over run tables (query, item, rank) and qrels (query, item, relevance)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import keep_best, ranked


def judged(run: DataFrame, qrels: DataFrame, query: str, item: str) -> DataFrame:
    """The run with each item's relevance, 0 if unjudged."""
    return run.join(qrels.select(query, item, "relevance"), [query, item], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def metrics(run: DataFrame, qrels: DataFrame, query: str, item: str, ks: tuple[int, ...] = (5, 10, 20), most: int = 20) -> DataFrame:
    """Per query of qrels: mrr, rank1, hit@k, recall@k, precision@k, r_precision. Queries without any gold are left out."""
    gold = qrels.filter("relevance > 0").groupBy(query).agg(F.count("*").alias("gold"))
    hits = judged(run, qrels, query, item).filter("relevance > 0").join(gold, query)
    within = lambda k: F.count_if(F.col("rank") <= k)
    r = F.least(F.col("gold"), F.lit(most))
    got = hits.groupBy(query).agg(F.min("rank").alias("first"), *(within(k).alias(f"n{k}") for k in ks), within(r).alias("nr"))
    full = gold.join(got, query, "left").fillna(0, [f"n{k}" for k in ks] + ["nr"])
    six = lambda c: F.round(c, 6)
    out = [six(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), (F.coalesce("first", F.lit(0)) == 1).cast("int").alias("rank1")]
    for k in ks:
        n = F.col(f"n{k}")
        out += [(n > 0).cast("int").alias(f"hit_{k}"), six(n / F.col("gold")).alias(f"recall_{k}"), six(n / k).alias(f"precision_{k}")]
    return full.select(query, "gold", *out, six(F.col("nr") / r).alias("r_precision"))


def ndcg(run: DataFrame, qrels: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, ndcg): gain 2^relevance - 1, ideal over the best min(k, gold) items; null without gold."""
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    discounted = lambda rank: F.sum(F.when(F.col(rank) <= k, gain / F.log2(F.col(rank) + 1)))
    dcg = judged(run, qrels, query, item).groupBy(query).agg(discounted("rank").alias("dcg"))
    best = ranked(qrels.filter("relevance > 0"), [query], [F.desc("relevance"), F.col(item)], "place").groupBy(query).agg(discounted("place").alias("ideal"))
    both = qrels.select(query).distinct().join(best, query, "left").join(dcg, query, "left")
    return both.select(query, F.round(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")), 6).alias("ndcg"))


def by_group(run: DataFrame, groups: DataFrame, query: str, item: str, group: str) -> DataFrame:
    """The run on the level of groups: each group once, at its best rank, ranks renumbered."""
    best = keep_best(run.join(groups.select(item, group), item), [query, group], [F.col("rank"), F.col(item)])
    return ranked(best.withColumnRenamed("rank", "item_rank"), [query], [F.col("item_rank"), F.col(group)]).select(query, group, "rank")


def valid_mean(c: str) -> tuple[Column, Column]:
    """Mean over known values, and how many there are."""
    return F.round(F.avg(c), 6).alias(f"{c}_mean"), F.count(c).alias(f"{c}_valid")


def bootstrap(deltas: DataFrame, value: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """One row: mean, and the 2.5 and 97.5 % quantiles of means of resamples. The number of values is a few queries by nature;
    resamples are drawn by hash, so reruns agree."""
    indexed = deltas.select(F.col(value).alias("v")).agg(F.array_sort(F.collect_list("v")).alias("v"))
    draws = indexed.select("v", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).repartition("round")  # rounds spread over tasks
    pick = lambda i: F.element_at("v", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % F.size("v") + 1).cast("int"))
    means = draws.select((F.aggregate(F.sequence(F.lit(1), F.size("v")), F.lit(0.0), lambda a, i: a + pick(i)) / F.size("v")).alias("m"))
    quantiles = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return deltas.agg(F.avg(value).alias("mean")).crossJoin(quantiles)


def sign_test(plus: int, minus: int) -> float:
    """Exact two-sided p of plus wins against minus losses; ties are left out before."""
    n = plus + minus
    if not n:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(plus, minus) + 1)) / 2**n)


def sign_test_column(plus: Column, minus: Column) -> Column:
    """The same as an expression: binomial coefficients by a running product."""
    n, k = (plus + minus).cast("int"), F.least(plus, minus).cast("int")
    state = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("sum"))
    step = lambda a, i: F.struct((a["c"] * (n - i + 1) / i).alias("c"), (a["sum"] + a["c"] * (n - i + 1) / i).alias("sum"))
    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), state, step, lambda a: a["sum"])).otherwise(1.0)
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))


def set_agreement(df: DataFrame, by: str, item: str, old: Column, new: Column) -> DataFrame:
    """Jaccard of two labellings' item sets per key."""
    g = df.groupBy(by).agg(F.collect_set(F.when(old, F.col(item))).alias("a"), F.collect_set(F.when(new, F.col(item))).alias("b"))
    union = F.size(F.array_union("a", "b"))
    return g.select(by, F.round(F.when(union > 0, F.size(F.array_intersect("a", "b")) / union), 6).alias("jaccard"))


def validated(rows: DataFrame, key: str, required: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(problem, n): duplicate keys, missing required values, values out of bounds."""
    counts = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"missing {c}") for c in required]
    counts += [F.count_if(~F.col(c).between(*b)).alias(f"bounds {c}") for c, b in bounds.items()]
    counts.append((F.count(key) - F.countDistinct(key)).alias(f"duplicate {key}"))
    one = rows.agg(*counts)
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*(F.col(f"`{c}`") for c in one.columns)))).alias("problem", "n"))


def differing(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows where two results differ, with both values."""
    both = a.select(*key, F.col(value).alias("left")).join(b.select(*key, F.col(value).alias("right")), key, "full")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))
