"""Graph analytics on edge tables: components, PageRank, paths, centrality, communities.

Iterations write what they carry to checkpoints in the folder that all executors share, never to one executor only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.folders import tabled
from .ranking import top_k


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, in the folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (a, b), each once, without self-loops."""
    e = edges.select("a", "b").filter("a != b")
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def formatted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, degree, importance) and edges of (head, tail, relation, confidence): the surest of equal edges, no self-loops."""
    real = edges.filter("head != tail").groupBy("head", "tail", "relation").agg(F.max("confidence").alias("confidence"))
    ends = real.select(F.explode(F.array("head", "tail")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    most = Window.partitionBy(F.lit(1))
    return ends.withColumn("importance", F.round(F.col("degree") / F.max("degree").over(most), 6)), real


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node is connected with. Labels jump along labels, so rounds grow with the logarithm of a path."""
    both = settled(undirected(edges))
    labels = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = settled(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        changed = new.filter("root != old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            break
    return labels


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds on an undirected graph; ranks sum to 1. Nodes without edges don't appear."""
    both = settled(undirected(edges))
    out = both.groupBy("a").agg(F.count("*").alias("out"))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    nodes = settled(out.select(F.col("a").alias("node"), "out", n.alias("n")))
    ranks = nodes.select("node", "out", "n", (1.0 / F.col("n")).alias("rank"))
    for i in range(rounds):
        sent = both.join(ranks, F.col("a") == F.col("node")).groupBy("b").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = nodes.join(sent, F.col("node") == F.col("b")).select("node", "out", "n", ((1 - damping) / F.col("n") + damping * F.col("got")).alias("rank"))
        if i % 4 == 3:
            ranks = settled(ranks)
    return ranks.select("node", "rank")


def distances(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, node, hops) of all nodes within depth hops of each source, depth included. The frontier holds only new nodes."""
    both = settled(undirected(edges))
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.select("source", F.col("node").alias("a")).join(both, "a").select("source", F.col("b").alias("node")).distinct()
        front = settled(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.union(front)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(source, target, hops, path): of each pair, the lexicographically least of the shortest paths, at most depth hops long."""
    both = settled(undirected(edges))
    front = pairs.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path"))
    seen = front
    for _ in range(depth):
        step = front.join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        best = step.groupBy("source", "node").agg(F.min("path").alias("path"))
        front = settled(best.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        seen = seen.union(front)
    return pairs.join(seen.withColumnRenamed("node", "target"), ["source", "target"]).withColumn("hops", F.size("path") - 1)


def ego(edges: DataFrame, centre: Column, radius: int = 1) -> DataFrame:
    """Edges among the nodes within radius of the centre."""
    start = edges.select(F.explode(F.array("a", "b")).alias("node")).filter(F.col("node") == centre).distinct()
    near = distances(edges, start, radius).select("node").distinct()
    e = edges.select("a", "b").distinct()
    return e.join(near.withColumnRenamed("node", "a"), "a", "left_semi").join(near.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def two_hop_paths(edges: DataFrame, seeds: DataFrame, weights: dict[str, float], fanout: int = 12, reverse: float = 0.6, least: float = 0.05, keep: int = 30) -> DataFrame:
    """Simple paths of one and two hops from seeds over (head, tail, relation, confidence), in both directions.

    A hop counts max(confidence, least) x its relation's weight, x reverse against its direction. Only the best `fanout` hops of a
    node are followed, so the number of paths is bounded by seeds x fanout^2; the best `keep` of each seed are returned."""
    weight = F.coalesce(*(F.when(F.col("relation") == k, F.lit(v)) for k, v in weights.items()), F.lit(1.0))
    hop = F.greatest(F.col("confidence"), F.lit(least)) * weight
    ahead = edges.select(F.col("head").alias("x"), F.col("tail").alias("y"), "relation", hop.alias("s"), F.lit(1).alias("forward"))
    back = edges.select(F.col("tail").alias("x"), F.col("head").alias("y"), "relation", (hop * reverse).alias("s"), F.lit(0).alias("forward"))
    hops = top_k(ahead.union(back).filter("x != y"), ["x"], [F.desc(F.round("s", 9)), F.col("y"), F.col("relation"), F.col("forward")], fanout).drop("rank")
    first = seeds.select(F.col("node").alias("seed")).join(hops, F.col("seed") == F.col("x")).select("seed", F.col("y").alias("mid"), "relation", "s")
    one = first.select("seed", "mid", F.lit(None).cast(hops.schema["y"].dataType).alias("end"), F.col("relation").alias("via"), F.col("s").alias("score"))
    second = first.join(hops.select("x", "y", F.col("relation").alias("r2"), F.col("s").alias("s2")), F.col("mid") == F.col("x")).filter("y != seed")
    two = second.select("seed", "mid", F.col("y").alias("end"), F.concat_ws(">", "relation", "r2").alias("via"), (F.col("s") * F.col("s2")).alias("score"))
    return top_k(one.union(two), ["seed"], [F.desc(F.round("score", 9)), F.col("mid"), F.col("end"), F.col("via")], keep)


def beam_paths(edges: DataFrame, seeds: DataFrame, beam: int = 4, fanout: int = 3, rounds: int = 2, reverse: float = 0.6, least: float = 0.05) -> DataFrame:
    """(seed, path, score) of simple paths that grow from seeds (node) over (head, tail, confidence): in each round the best `beam`
    paths of a seed are followed over their last node's best `fanout` edges. All paths found are returned; a path's score is the
    product of max(confidence, least), times `reverse` for each hop against its direction. Seeds x rounds x beam x fanout bounds them."""
    sure = F.greatest(F.col("confidence"), F.lit(least))
    ahead = edges.select(F.col("head").alias("x"), F.col("tail").alias("y"), sure.alias("s"))
    back = edges.select(F.col("tail").alias("x"), F.col("head").alias("y"), (sure * reverse).alias("s"))
    hops = ahead.union(back).filter("x != y").groupBy("x", "y").agg(F.max("s").alias("s"))
    hops = settled(top_k(hops, ["x"], [F.desc(F.round("s", 9)), F.col("y")], fanout).drop("rank"))
    front = seeds.select(F.col("node").alias("seed"), F.array("node").alias("path"), F.lit(1.0).alias("score"))
    every = None
    for _ in range(rounds):
        best = top_k(front, ["seed"], [F.desc(F.round("score", 9)), F.col("path")], beam).drop("rank")
        step = best.join(hops, F.element_at("path", -1) == F.col("x")).filter(~F.array_contains("path", F.col("y")))
        front = step.select("seed", F.concat("path", F.array("y")).alias("path"), (F.col("score") * F.col("s")).alias("score"))
        every = front if every is None else every.union(front)
    return every


def path_level(levels: Column) -> Column:
    """The weakest step decides: the largest of L1 < L2 < L3."""
    return F.array_max(levels)


#: Rows of (source, edge) that a sweep of betweenness handles at once, about.
SWEEP = 50_000_000


def _shares(both: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """(node, share) of sources (node), a table a level: forward over levels, counting shortest paths, and back, sharing them out."""
    front = tabled(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))
    levels, before = [front], None
    while True:
        step = front.join(both, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        near = front if before is None else front.unionByName(before)  # neighbours of a level lie in it or next to it
        ahead = tabled(step.join(near.select("source", "node"), ["source", "node"], "left_anti"))
        if ahead.isEmpty():
            break
        levels.append(ahead)
        before, front = front, ahead
    below, out = levels[-1].withColumn("share", F.lit(0.0)), []
    for level in reversed(levels[:-1]):
        out.append(below.select("node", "share"))
        sent = below.select("source", F.col("node").alias("b"), ((1 + F.col("share")) / F.col("paths")).alias("sent")).join(both, "b")
        got = sent.groupBy("source", F.col("a").alias("node")).agg(F.sum("sent").alias("got"))
        below = tabled(level.join(got, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("got", F.lit(0.0))).alias("share")))
    return out


#: Directed edges of a graph that a task may hold (8 bytes each); sources that it sweeps at once, as far as these cells allow (8 bytes each).
HELD, SOURCES, CELLS = 2_000_000, 64, 16_000_000


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of all nodes, of a block of sources (places of nodes) and the graph: neighbours of nodes, node after node."""
    total = None
    for batch in batches:
        for i in range(batch.num_rows):
            sources, b, sizes = (batch[c].slice(i, 1).flatten().to_numpy() for c in ("sources", "b", "sizes"))
            starts = np.cumsum(sizes) - sizes
            total = np.zeros(len(starts)) if total is None else total
            most = max(1, min(SOURCES, CELLS // len(b)))
            for at in range(0, len(sources), most):
                some = sources[at : at + most]
                front = np.zeros((len(starts), len(some)))
                front[some, np.arange(len(some))] = 1.0
                paths, levels, seen = front.copy(), [], front > 0
                while (front := np.where(seen, 0.0, np.add.reduceat(front[b], starts, 0))).any():
                    levels.append(front > 0)
                    paths, seen = paths + front, seen | levels[-1]
                share = np.zeros_like(paths)
                for no in range(len(levels) - 1, 0, -1):  # what a level sends goes to the level before it
                    sent = np.divide(1 + share, paths, out=np.zeros_like(paths), where=levels[no])
                    share = np.where(levels[no - 1], paths * np.add.reduceat(sent[b], starts, 0), share)
                total += share.sum(1)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "share"])


def _in_tasks(both: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """(node, share), blocks of sources dealt to tasks, each with the graph."""
    nodes = tabled(both.groupBy("a").agg(F.collect_list("b").alias("near")).select(F.col("a").alias("node"), "near", (F.row_number().over(Window.orderBy("a")) - 1).cast("long").alias("place")))
    ends = nodes.select("place", F.explode("near").alias("node")).join(nodes.select("node", F.col("place").alias("b")), "node")
    rows = ends.groupBy("place").agg(F.collect_list("b").alias("near")).agg(F.array_sort(F.collect_list(F.struct("place", "near"))).alias("r"))
    flat = F.flatten("r.near")
    graph = tabled(rows.select(flat.alias("b"), F.transform("r.near", F.size).alias("sizes")))
    parts = max(1, min(-(-n // SOURCES), 8 * both.sparkSession.sparkContext.defaultParallelism))
    blocks = sources.select("node").join(nodes.select("node", "place"), "node").withColumn("part", (F.col("place") % parts).cast("int")).repartitionById(parts, "part")
    blocks = blocks.groupBy("part").agg(F.collect_list("place").alias("sources")).repartitionById(parts, "part")
    got = blocks.crossJoin(graph).select("sources", "b", "sizes").mapInArrow(_swept, "place long, share double")
    return nodes.select("node", "place").join(got.groupBy("place").agg(F.sum("share").alias("share")), "place").select("node", "share")


def betweenness(edges: DataFrame, samples: int | None = None, sweep: int = SWEEP, held: int = HELD) -> DataFrame:
    """(node, betweenness) of an undirected graph, from all sources or from `samples` chosen by hash. Sources go in blocks of which
    `sweep` bounds the rows; each block is swept level by level as joins with the edges, so no task holds the graph. A graph of at most
    `held` directed edges goes to tasks whole instead, each with a part of the sources."""
    both = tabled(undirected(edges))
    sources = both.select(F.col("a").alias("node")).distinct()
    n, m = sources.count(), both.count()
    if samples:
        sources = sources.orderBy(F.md5(F.col("node").cast("string"))).limit(samples)
    parts = max(1, -(-min(n, samples or n) * m // sweep))
    scale = 1.0 / max(1, (n - 1) * (n - 2)) * (n / min(n, samples) if samples else 1.0)
    if m <= held:
        return _in_tasks(both, sources, min(n, samples or n)).select("node", F.round(F.col("share") * scale, 9).alias("betweenness"))
    sources = tabled(sources.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts))))
    nodes = both.select(F.col("a").alias("node"), F.lit(0.0).alias("share")).distinct()
    for part in range(parts):
        swept = nodes
        for shares in _shares(both, sources.filter(F.col("part") == part)):
            swept = swept.unionByName(shares)
        nodes = tabled(swept.groupBy("node").agg(F.sum("share").alias("share")))
    return nodes.select("node", F.round(F.col("share") * scale, 9).alias("betweenness"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: each node takes its neighbours' most frequent label, ties to the smallest, and nodes
    take turns by a hashed half in each round so that labels settle."""
    both = settled(undirected(edges))
    labels = settled(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    for i in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "community").agg(F.count("*").alias("n"))
        best = top_k(votes, ["a"], [F.desc("n"), F.col("community")], 1).select("a", F.col("community").alias("new"))
        turn = F.conv(F.substring(F.md5(F.col("node").cast("string")), 32, 1), 16, 10).cast("int") % 2 == i % 2
        labels = settled(labels.join(best, F.col("node") == F.col("a"), "left").select("node", F.when(turn, F.coalesce("new", "community")).otherwise(F.col("community")).alias("community")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how much more edges stay inside communities than by chance."""
    both = undirected(edges)
    a = labels.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    joined = both.join(a, "a").join(b, "b")
    per = joined.groupBy("ca").agg(F.count("*").alias("ends"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    total = F.sum("ends").over(Window.partitionBy(F.lit(1)))
    return per.select((F.col("inside") / total - (F.col("ends") / total) ** 2).alias("q")).agg(F.round(F.sum("q"), 9).alias("modularity"))
