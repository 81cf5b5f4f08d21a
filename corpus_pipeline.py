"""The corpus pipeline: quality rules, exact dedup, near-duplicates, mixing to target weights, packing.

Each stage gets what its predecessor kept, as Parquet, and returns rows with the columns of documents; the last returns packed
pieces. Null and empty texts, repeated rows and extra columns are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexquarry.llm.common import dropped, scratch, stored, table
from lexquarry.llm.exact_dedup import without_copies
from lexquarry.llm.mixing import mixed_documents
from lexquarry.llm.ngram_join import one_of_each_group
from lexquarry.llm.packing import packed
from lexquarry.llm.quality import good_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return good_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one document stays."""
    return without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one document stays."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take part by weight: a document comes once for each pass that takes words of it, with these words as its text."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two, with their bucket and place.

    Rows of one doc_id stand for passes of it; each is packed for itself."""
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Suffix-array repetition, MinHash and tokens are not for SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage and its operators stored goes when the next stage's documents are stored."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as kept:
            out = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(out.stored_at)
        if i:
            dropped(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
