"""Entity resolution: alias tables, guarded alignment, representatives, canonical triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numeral_signature
from .graph import components
from .ranking import keep_best


def resolved(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions (kind, norm) with the alias table's canonical name, else their own; `level` says which."""
    a = aliases.select("kind", "norm", "canonical")
    return mentions.join(a, ["kind", "norm"], "left").withColumn("level", F.when(F.col("canonical").isNull(), "L4").when(F.col("canonical") == F.col("norm"), "L1").otherwise("L2")).withColumn("canonical", F.coalesce("canonical", "norm"))


def guard(a: Column, b: Column, similarity: Column, sure: float = 0.95, edits: int = 1, most: int = 40) -> Column:
    """Why two names must not be merged, the first reason that holds; null if they may."""
    far = F.levenshtein(a, b, edits)
    return (
        F.when(similarity < sure, "similarity").when(numeral_signature(a) != numeral_signature(b), "numerals").when((F.length(a) > most) | (F.length(b) > most), "length")
        .when(a.contains("《") | b.contains("《"), "title").when(far < 0, "edits")
    )


def name_pairs(names: DataFrame, kind: str, name: str, edits: int = 1) -> DataFrame:
    """Pairs (kind, a, b) of one kind within one edit, found without comparing all: names of which one equals the other after
    deleting at most one character from each meet on that form."""
    if edits != 1:
        raise ValueError("pairs are found by deletions of one character")
    n = F.length(name)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(F.col(name), F.lit(1), i - 1), F.substr(F.col(name), i + 1)))
    forms = names.select(kind, name).distinct().select(kind, name, F.explode(F.array_distinct(F.concat(F.array(name), cut))).alias("form"))
    a, b = forms.withColumnRenamed(name, "a"), forms.withColumnRenamed(name, "b")
    # forms are many times what Spark estimates from the names' file, so a broadcast of them can take all of the driver's memory
    met = a.hint("merge").join(b, [kind, "form"]).filter("a < b").select(kind, "a", "b").distinct()
    return met.filter(F.levenshtein("a", "b", edits) >= 0)


def representatives(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, canonical) for names joined by pairs (a, b): of each component the name that is in the dictionary, then with most
    aliases, then shortest, then least. names: name, known, aliases."""
    roots = components(pairs.select("a", "b")).select(F.col("node").alias("name"), "root")
    facts = roots.join(names, "name", "left")
    order = [F.desc(F.coalesce("known", F.lit(False))), F.desc(F.coalesce("aliases", F.lit(0))), F.length("name"), F.col("name")]
    best = keep_best(facts, ["root"], order).select("root", F.col("name").alias("canonical"))
    return roots.join(best, "root").select("name", "canonical")


def clean_triples(triples: DataFrame, relations: Sequence[str], default: str, most: int = 100) -> DataFrame:
    """Triples with both ends: names cut at `most`, relations off the list become the default, confidences lie within 0 and 1 (none: 0)."""
    ends = {c: F.substring(F.trim(F.col(c)), 1, most) for c in ("head", "tail")}
    kind = F.when(F.col("relation").isin(*relations), F.col("relation")).otherwise(default)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return triples.withColumns({**ends, "relation": kind, "confidence": sure}).filter("head != '' and tail != ''")


def canonical_triples(triples: DataFrame, canon: DataFrame) -> DataFrame:
    """Replace both ends of (head, relation, tail, confidence) by their canonical names; of equal triples the surest stays."""
    side = lambda c: canon.select(F.col("name").alias(c), F.col("canonical").alias(f"{c}_to"))
    moved = triples.join(side("head"), "head", "left").join(side("tail"), "tail", "left")
    ends = [F.coalesce(f"{c}_to", c).alias(c) for c in ("head", "tail")]
    return moved.select(*ends, "relation", "confidence").filter("head != tail").groupBy("head", "relation", "tail").agg(F.max("confidence").alias("confidence"))
