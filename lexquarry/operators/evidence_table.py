"""Evidence from a graph for questions: link entities, walk around them, keep the surest edges, quote their articles."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_text
from .graph import settled
from .ordered import containing
from .ranking import top_k

EDGE = ("head", "relation", "tail", "article")


def bare(name: Column) -> Column:
    """A name as it is compared: lower case, without white space."""
    return F.lower(F.regexp_replace(name, r"\s+", ""))


def linked(questions: DataFrame, aliases: DataFrame, near: DataFrame, most: int = 5) -> DataFrame:
    """(question, entity, source, place): the entities of a question, `most` at most. First those of which it has an alias (compared
    bare(), two characters at least), by entity; then those whose vectors are near, by rank. Each entity counts once.

    questions: question, text. aliases: alias, entity; an alias of several entities stands for the least. near: question, entity, rank.
    Nulls take no part."""
    names = aliases.select(bare(F.col("alias")).alias("alias"), "entity").filter("length(alias) >= 2 and entity is not null").groupBy("alias").agg(F.min("entity").alias("entity"))
    texts = questions.select("question", bare(F.col("text")).alias("text")).filter("question is not null")
    said = texts.join(containing(texts, "text", names, "alias"), "text").join(names, "alias").select("question", "entity", F.lit(0).alias("way"), F.lit(0).alias("rank"))
    both = said.unionByName(near.select("question", "entity", F.lit(1).alias("way"), F.col("rank").cast("int").alias("rank")).filter("question is not null and entity is not null"))
    first = both.groupBy("question", "entity").agg(F.min(F.struct("way", "rank")).alias("first"))
    found = top_k(first, ["question"], [F.col("first"), F.col("entity")], most, "place")
    return found.select("question", "entity", F.when(F.col("first.way") == 0, "alias").otherwise("vector").alias("source"), "place")


def around(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int = 12, allowed: Collection[str] | None = None) -> DataFrame:
    """(question, head, relation, tail, article, confidence, hop, place): of each question the first `most` edges around its entities,
    nearer ones first, then surer ones, then by name. Edges of other jurisdictions than `allowed` don't count and aren't walked; of
    equal edges the surest counts.

    A question is walked on only while it has fewer than `most` edges, from the ends of all it has, which gives the same rows as
    walking on from everything: what a full question would find further out comes behind its last place. So a question carries at
    most 2 x `most` nodes into a hop, and the most of an entity's edges are cut where they are found."""
    if allowed is not None:
        edges = edges.filter(F.col("jurisdiction").isin(*allowed))
    edges = edges.groupBy(*EDGE).agg(F.max("confidence").alias("confidence"))
    ends = edges.select(F.explode(F.array_distinct(F.array("head", "tail"))).alias("node"), *EDGE, "confidence").filter("node is not null")
    ends = settled(ends)
    order = [F.desc("confidence"), *(F.asc_nulls_first(c) for c in ("head", "tail", "relation", "article"))]
    front, found = seeds.select("question", F.col("entity").alias("node")).distinct(), None
    for hop in range(1, hops + 1):
        new = front.join(ends, "node").drop("node").distinct()
        if found is not None:
            seen = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("question", *EDGE)]
            new = new.alias("n").join(found.alias("o"), seen, "left_anti")
        new = top_k(new, ["question"], order, most, "place").withColumn("hop", F.lit(hop))
        if found is not None:
            held = found.groupBy("question").agg(F.count("*").cast("int").alias("held"))
            new = new.join(held, "question").withColumn("place", F.col("place") + F.col("held")).filter(F.col("place") <= most).drop("held")
        new = new.select("question", *EDGE, "confidence", "hop", "place")
        found = settled(new if found is None else found.unionByName(new))
        if hop < hops:
            few = found.groupBy("question").agg(F.count("*").alias("held")).filter(F.col("held") < most).select("question")
            front = found.join(few, "question").select("question", F.explode(F.array("head", "tail")).alias("node")).distinct()
    return found


def quoted(found: DataFrame, texts: DataFrame, most: int = 6, chars: int = 400) -> DataFrame:
    """(question, article, i, snippet, edges): the first `most` articles of a question's edges, whole or cut at `chars` characters and
    marked, with the number of its edges. Articles without a text are left out, and count. texts: article, text."""
    first = top_k(found.groupBy("question", "article").agg(F.min("place").alias("first")), ["question"], [F.col("first")], most, "i")
    n = found.groupBy("question").agg(F.count("*").alias("edges"))
    text = texts.select("article", cut_text(F.col("text"), chars).alias("snippet"))
    return first.join(text, "article").join(n, "question").select("question", "article", "i", "snippet", "edges")
