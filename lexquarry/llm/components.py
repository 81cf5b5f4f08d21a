"""Connected components by alternating large-star and small-star steps, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are hung on the smallest of it and its neighbours. Small star: its smaller ones, and itself.

    The smallest neighbour is a map-side minimum. It is stored before it is joined back: both sides are then shuffled for the join,
    so that a hub's many edges can be split over tasks."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "least")
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    out = stored(out.filter("a != b").distinct(), "edges")
    dropped(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type to (node, root): root is the smallest node of the component. Nodes without edges don't appear."""
    edges = stored(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.bit_xor(F.xxhash64("a", "b")), F.count("*")
    seen = edges.agg(*mark).first()
    while True:
        big = _star(edges, True)
        small = _star(big, False)
        dropped(edges, big)
        edges, now = small, small.agg(*mark).first()
        if now == seen:
            break
        seen = now
    roots = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "roots")
    dropped(edges)
    return roots
