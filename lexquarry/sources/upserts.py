"""Writes as rewrites: merges, upserts, pruning and partition replacement on immutable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import keep_best


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; of several new rows the last by `order` counts."""
    latest = keep_best(new, key, [F.desc(order)]) if order else new.dropDuplicates(list(key))
    return old.join(latest.select(*key), list(key), "left_anti").unionByName(latest, allowMissingColumns=True)


def version_merge(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """All keys of both; values are the new ones where there are any. `how` says what happened to a row."""
    values = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*values).alias("__old"))
    n = new.select(*key, F.struct(*values).alias("__new"))
    how = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "kept").otherwise("replaced").alias("how")
    picked = [F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col("__old")[c]).alias(c) for c in values]
    return o.join(n, list(key), "full").select(*key, *picked, how)


def merge_sets(old: DataFrame, new: DataFrame, key: str, sets: Sequence[str]) -> DataFrame:
    """Array columns become the sorted union of both sides; what one side lacks is empty."""
    both = old.select(key, *(F.col(c).alias(f"__{c}") for c in sets)).join(new.select(key, *sets), key, "full")
    none = lambda c: F.coalesce(c, F.array())
    return both.select(key, *(F.array_sort(F.array_union(none(F.col(f"__{c}")), none(F.col(c)))).alias(c) for c in sets))


def count_seen(log: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """The counter of an append-only log: seen_count, first_seen, last_seen."""
    return log.groupBy(*key).agg(F.count("*").alias("seen_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def prune(rows: DataFrame, keep: DataFrame, key: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Drop rows whose key is not in keep; with `within`, only in those groups that keep names at all."""
    kept = rows.join(keep.select(*key), list(key), "left_semi")
    if not within:
        return kept
    return kept.unionByName(rows.join(keep.select(*within).distinct(), list(within), "left_anti"))


def delete(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*key), list(key), "left_anti")


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite just those partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def backfill(rows: DataFrame, lookup: DataFrame, key: str, value: str, strip: str = r"_sub_\d+$") -> DataFrame:
    """Fill a column from a lookup by the parent's id: the row's id without its suffix."""
    parents = lookup.select(F.col(key).alias("__parent"), F.col(value).alias("__value"))
    joined = rows.withColumn("__parent", F.regexp_replace(key, strip, "")).join(parents, "__parent", "left")
    old = F.col(value) if value in rows.columns else F.lit(None)
    return joined.withColumn(value, F.coalesce("__value", old)).drop("__parent", "__value")


def stale(rows: DataFrame, version: str, current: str) -> DataFrame:
    """Rows labelled under another version, or under none."""
    return rows.filter(~F.col(version).eqNullSafe(F.lit(current)))


def renamed_ids(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Rewrite id prefixes (old, new): a prefix counts only up to the end or an underscore; the longest match is taken."""
    words = F.split("__id", "_")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), "_"))
    ids = rows.select(F.col(column).alias("__id")).distinct()
    hits = ids.select("__id", F.explode(starts).alias("old"))
    best = hits.join(mapping.select("old", "new"), "old").groupBy("__id").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("__to"))
    fresh = F.when(F.col("__to").isNull(), F.col(column)).otherwise(F.concat("__to.new", F.substr(F.col(column), F.length("__to.old") + 1)))
    return rows.join(best, F.col(column) == F.col("__id"), "left").withColumn(column, fresh).drop("__id", "__to")


def next_id(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: prefix with the highest numeric suffix plus one."""
    number = F.regexp_extract(column, r"(\d+)$", 1).try_cast("long")
    top = rows.filter(F.col(column).startswith(prefix)).agg(F.coalesce(F.max(number), F.lit(0)).alias("n"))
    return top.select(F.concat(F.lit(prefix), (F.col("n") + 1).cast("string")).alias("id"))


def collisions_renamed(rows: DataFrame, id: str, file: str) -> DataFrame:
    """An id that several files use stays with the first file; the others get the number in their file's name added."""
    first = rows.groupBy(id).agg(F.min(file).alias("__first"))
    number = F.regexp_extract(file, r"(\d+)(?=\D*$)", 1)
    return rows.join(first, id).withColumn(id, F.when(F.col(file) == F.col("__first"), F.col(id)).otherwise(F.concat_ws("_", id, number))).drop("__first")
