"""Filter interaction audit: what each filter removes, in every order of the filters.

Documents are counted once by part and failure flags; SQL's CUBE over these counts gives, for each set of filters, the documents
that pass all of them (the rows whose selected flags are all false). A step of an order is then a pair of sets: the filters before
it, and the same with its own."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, normal_text, table

FILTERS = "ABCDE"
_COUNTS = ("n", "good", "toxic")


def failures(text: str, words: str) -> dict[str, Column]:
    """Conditions A to D on columns with a whole text and its words."""
    n = F.size(words).cast("long")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic), a row a document. E: the text is that of a smaller doc_id, texts being told apart by their
    SHA-256. The first of equal texts is found by an aggregate and met on text and id together, so a text with many copies is no hot key."""
    text = normal_text(F.col("text"))
    bare = F.btrim("text", F.lit("\x20\t\n\v\f\r"))
    split = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = split.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+")))
    plain = split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in failures("text", "words").items()))
    first = docs.select(F.col("doc_id").alias("first"), F.unhex(F.sha2(text, 256)).alias("same")).groupBy("same").agg(F.min("first").alias("first"))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    met = plain.join(first, F.col("id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("same")), "left")
    got = met.join(said, F.col("id") == F.col("labelled"), "left")
    return got.select("part", *"ABCD", F.col("same").isNull().alias("E"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS[1:]))


def survivors(flags: DataFrame) -> DataFrame:
    """(part, passed, n, good, toxic): documents of a part that fail none of a set of filters, for every set that some documents
    survive; the set's bits are filters, A the lowest."""
    cells = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cube = cells.cube("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in _COUNTS), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"no{f}") for f in FILTERS))
    passed = [(F.col(f"no{f}") == 1) | ~F.col(f) for f in FILTERS]
    rows = cube.filter((F.col("all_parts") == 0)).filter(passed[0] & passed[1] & passed[2] & passed[3] & passed[4])
    bits = sum(((1 - F.col(f"no{f}")) * 2**i for i, f in enumerate(FILTERS)), F.lit(0))
    return rows.select("part", bits.cast("int").alias("passed"), *_COUNTS)


def _bits(names: Column) -> Column:
    """The filters of a string as a set."""
    return sum((F.when(F.contains(names, F.lit(f)), F.lit(2**i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    Null texts and parts count as empty. A document without doc_id comes after all others and has no labels; repeated rows count
    each, and none of them is a copy of the other, as their ids are equal. A doc_id labelled twice has a label if one row gives it.
    Empty documents give no rows. Other columns are not read."""
    got = survivors(flagged(docs, labels))
    sets = F.map_from_entries(F.collect_list(F.struct("passed", F.struct(*_COUNTS))))
    parts = got.groupBy("part").agg(sets.alias("of"))  # at most 32 entries a part
    orders = parts.select("part", "of", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).withColumn("filter", F.substr("filter_order", "step", F.lit(1)))
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in _COUNTS))
    at = lambda bits: F.coalesce(F.try_element_at("of", bits), none)
    before, own, every = _bits(F.substr(F.col("filter_order"), F.lit(1), F.col("step") - 1)), _bits(F.col("filter")), F.lit(2 ** len(FILTERS) - 1)
    pair = steps.select("part", "filter_order", "step", "filter", at(F.lit(0)).alias("all"), at(before).alias("b"), at(before + own).alias("k"), at(own).alias("own"), at(every - own).alias("others"), at(every).alias("none"))
    lost = lambda c: F.col(f"b.{c}") - F.col(f"k.{c}")
    removed = lost("n")
    return pair.select(
        "part", "filter_order", "step", F.col("k.n").alias("kept"), removed.alias("removed"), (F.col("all.n") - F.col("own.n") - removed).alias("redundant"),
        (F.col("others.n") - F.col("none.n")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
