"""Ranked lists: top-k, fusion, diversification, staged reranking, deduplication. All are windows over (query, rank) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60  # fixed value


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number rows from 1 within by."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes to k a partition before the shuffle (group limit)."""
    return ranked(df, by, order, name).filter(F.col(name) <= k)


def keep_best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each group: the first in the given order."""
    return top_k(df, by, order, 1, "__first").drop("__first")


def rrf(lists: Sequence[DataFrame], by: Sequence[str], item: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (by, item, rank): sum of 1 / (k + rank), with the first list and rank an item came in.

    Ties go by list, then by rank in it, then by item."""
    rows = reduce(DataFrame.unionByName, (df.select(*by, item, "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)))
    got = rows.groupBy(*by, item).agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(got, by, [F.desc(F.round("score", 12)), F.col("first"), F.col(item)]).select(*by, item, "score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"), "rank")


def round_robin(df: DataFrame, by: Sequence[str], group: str, k: int, rank: str = "rank") -> DataFrame:
    """Take the best of every group, then the second of every group, and so on; groups go in order of first appearance."""
    depth = Window.partitionBy(*by, group).orderBy(rank)
    seen = df.withColumn("depth", F.row_number().over(depth)).withColumn("lead", F.min(rank).over(Window.partitionBy(*by, group)))
    return top_k(seen, by, [F.col("depth"), F.col("lead")], k, "place").drop("lead")


def diverse_fill(df: DataFrame, by: Sequence[str], group: str, own: Column, preferred: Column, k: int, score: str = "score", item: str = "item") -> DataFrame:
    """The best of each group first (preferred groups, then others, then one's own), the rest by score."""
    w = Window.partitionBy(*by, group).orderBy(F.desc(score), item)
    best = df.withColumn("best", F.row_number().over(w) == 1)
    tier = F.when(~F.col("best"), 3).when(own, 2).when(preferred, 0).otherwise(1)
    return top_k(best.withColumn("tier", tier), by, [F.col("tier"), F.desc(score), F.col(item)], k, "place").drop("best")


def two_stage(df: DataFrame, by: Sequence[str], new_score: Column, window: int, blank: Column) -> DataFrame:
    """Rescore only the first `window` rows; rows without text follow the scored ones, the tail keeps its order."""
    stage = F.when(F.col("rank") > window, 2).when(blank, 1).otherwise(0)
    scored = df.withColumn("stage", stage).withColumn("new_score", F.when(F.col("stage") == 0, new_score))
    return ranked(scored, by, [F.col("stage"), F.desc_nulls_last("new_score"), F.col("rank")], "new_rank")


def pinned(df: DataFrame, by: Sequence[str], pin: Column) -> DataFrame:
    """Rows that match go to the top; the order stays otherwise."""
    return ranked(df, by, [F.desc(pin.cast("int")), F.col("rank")], "new_rank")


def quota_round_robin(df: DataFrame, by: Sequence[str], seed: str, order: Sequence[Column], each: int, total: int) -> DataFrame:
    """At most `each` rows a seed and `total` in all, dealt in turns over seeds in order of seed."""
    part = top_k(df, [*by, seed], order, each, "depth")
    return top_k(part, by, [F.col("depth"), F.col(seed)], total, "place")


def converge(df: DataFrame, by: Sequence[str], protected: Column, quota: int, k: int, order: Sequence[Column]) -> DataFrame:
    """Cut to k rows, of which up to `quota` places are kept for protected rows."""
    marked = df.withColumn("protected", protected)
    ranked_in = ranked(marked, [*by, "protected"], order, "in_class")
    first = F.when(F.col("protected") & (F.col("in_class") <= quota), 0).otherwise(1)
    return top_k(ranked_in.withColumn("late", first), by, [F.col("late"), *order], k, "place")


def merge_keep_max(lists: Sequence[DataFrame], by: Sequence[str], score: str, tie: str) -> DataFrame:
    """Union of lists; of each key the row with the highest score."""
    return keep_best(reduce(DataFrame.unionByName, lists), by, [F.desc(score), F.col(tie)])


def sampled(df: DataFrame, by: Sequence[str], item: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each group in an order that only seed and item decide."""
    return top_k(df, by, [F.md5(F.concat(F.lit(seed), F.col(item).cast("string"))), F.col(item)], n, "draw")
