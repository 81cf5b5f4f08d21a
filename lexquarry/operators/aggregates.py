"""Rollups: groups with a mode, grouping sets, matrices with zero fill, running totals, graph-quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import keep_best, top_k


def mode_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest: counted first, so that a group's rows never meet."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    return keep_best(counts, by, [F.desc("__n"), F.col(value)]).drop("__n")


def rollup_groups(df: DataFrame, key: str, facet: str, item: str) -> DataFrame:
    """Per key: most frequent facet, rows, distinct items (rows where no item is known)."""
    got = df.groupBy(key).agg(F.count("*").alias("chunks"), F.countDistinct(item).alias("items"))
    items = F.when(F.col("items") == 0, F.col("chunks")).otherwise(F.col("items")).alias("items")
    return got.join(mode_by(df, [key], facet), key).select(key, facet, "chunks", items)


def terms(df: DataFrame, term: str, sub: str, n: int, n_sub: int, excluded: Sequence[str] = ()) -> DataFrame:
    """Top n terms with their top n_sub sub-terms. Both cuts rank sums, not rows."""
    pairs = df.filter(~F.col(term).isin(*excluded)) if excluded else df
    pairs = pairs.groupBy(term, sub).agg(F.count("*").alias("sub_count"))
    totals = pairs.groupBy(term).agg(F.sum("sub_count").alias("count"))
    top = totals.orderBy(F.desc("count"), term).limit(n)
    return top_k(pairs.join(top, term), [term], [F.desc("sub_count"), F.col(sub)], n_sub)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """One pass for several groupings; columns that a grouping lacks are null, and `level` numbers the sets by grouping_id."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    cols = [F.col(c) for c in names]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(*aggregates, F.grouping_id(*cols).cast("int").alias("level"))


def zero_filled(counts: DataFrame, rows: DataFrame, columns: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Every row with every column of two dimension tables, 0 where nothing was counted."""
    return rows.crossJoin(columns).join(counts, list(on), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def running_total(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def graph_quality(edges: DataFrame) -> DataFrame:
    """One row of figures on edges (head, tail, relation, confidence): self-loops are skipped, of equal edges the surest stays."""
    each = edges.groupBy("head", "relation", "tail").agg(F.max("confidence").alias("c"))  # the one pass over edges
    real = each.filter("head != tail")
    ends = each.select(F.explode(F.array("head", "tail")).alias("node"), (F.col("head") != F.col("tail")).alias("real")).groupBy("node").agg(F.bool_or("real").alias("real"))
    nodes = ends.agg(F.count("node").alias("nodes"), F.count_if("real").alias("linked"))
    c = F.col("c")
    figures = real.agg(
        F.count("*").alias("edges"), F.round(F.avg(c), 6).alias("mean_confidence"),
        F.count_if(c < 0.6).alias("below_60"), F.count_if((c >= 0.6) & (c < 0.8)).alias("below_80"),
        F.count_if((c >= 0.8) & (c < 0.9)).alias("below_90"), F.count_if(c >= 0.9).alias("from_90"),
    )
    n, e = F.col("nodes"), F.col("edges")
    both = figures.crossJoin(nodes)
    return both.select("nodes", "edges", F.round(2.0 * e / n, 6).alias("mean_degree"), F.round(2.0 * e / (n * (n - 1)), 9).alias("density"), F.round((n - F.col("linked")) / n, 6).alias("orphans"), "mean_confidence", "below_60", "below_80", "below_90", "from_90")


def graph_counts(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(what, value, n, share): edges by relation and nodes by type (node, type), of edges (head, tail, relation) without self-loops, equal
    edges once. A node without a type is `unknown`; of several types the first counts."""
    each = edges.filter("head != tail").select("head", "relation", "tail").distinct()
    by_relation = each.groupBy(F.coalesce("relation", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "value", "n")
    nodes = each.select(F.explode(F.array("head", "tail")).alias("node")).distinct()
    known = types.groupBy("node").agg(F.min("type").alias("type"))
    by_type = nodes.join(known, "node", "left").groupBy(F.coalesce("type", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "value", "n")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("what"))
    return by_relation.unionByName(by_type).withColumn("share", F.round(share, 6))


def concept_matrix(edges: DataFrame, least: int, n: int) -> DataFrame:
    """Concepts at either end of (jurisdiction, head, tail, article) by jurisdiction: distinct articles of each cell, for the n concepts
    of the most jurisdictions (least at least), then of the highest total, then by name."""
    ends = edges.select("jurisdiction", "article", F.explode(F.array("head", "tail")).alias("concept"))
    cells = ends.groupBy("concept", "jurisdiction").agg(F.countDistinct("article").alias("articles"))
    top = cells.groupBy("concept").agg(F.count("*").alias("jurisdictions"), F.sum("articles").alias("total")).filter(F.col("jurisdictions") >= least)
    return cells.join(top.orderBy(F.desc("jurisdictions"), F.desc("total"), "concept").limit(n), "concept")
