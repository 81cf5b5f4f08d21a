"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows lie in buckets (the partitions of the method, fixed by a hash so that reruns agree). The matrix says how many rows of each
bucket go to each shard: drawn row by row from the multivariate hypergeometric law, so bucket sizes and shard sizes both come out
exact. Within a bucket rows are put in random order and dealt by the matrix row; within a shard, the rows' places are permuted
again. Law: rows, shard sizes are at most one apart.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import normal_text, on_files, permuted, scratch, stored, table, with_row_id

SHARDS = 24
SEED = 51
#: Rows in a bucket, on average.
ROWS = 8192
#: Rows of a file among which copies of a row are numbered by one task.
RUN = 1 << 16
#: Buckets at most: bounds the matrix on the driver (some 50 MB an array); beyond, buckets grow with the input.
BUCKETS = 1 << 18


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n rows drawn from good + bad, how many are good. Beyond numpy's range: inversion from the mode outwards by lgamma."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(log(good, mode) + log(bad, n - mode) - log(good + bad, n))
    u, left, right, pl, pr = rng.random() - p, mode, mode, p, p
    while u > 0 and (left > low or right < high):
        if right < high:
            pr *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def communication_matrix(sizes: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Row sums: the bucket sizes. Column sums: the shard sizes, at most one apart."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for b, n in enumerate(sizes):
        rest = sum(room)
        for s in range(shards):
            rest -= room[s]
            out[b, s] = got = hypergeometric(rng, room[s], rest, n)
            room[s] -= got
            n -= got
    return out


def occurrences(rows: DataFrame) -> DataFrame:
    """(rid, copy) of the rows of (rid, key) whose key is not alone: copies of a key are numbered from 0 in the order of rows. Numbers
    are counted within runs of RUN rows of a file and then run by run, so a frequent key is numbered by many tasks."""
    again = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key")
    again = stored(again.select("rid", "key", F.struct("rid.file", F.floor(F.col("rid.row") / RUN).alias("run")).alias("run")), "copies")
    runs = again.groupBy("key", "run").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "run").orderBy("rid"))
    return again.withColumn("place", place).join(runs, ["key", "run"]).select("rid", (F.col("before") + F.col("place") - 1).alias("copy"))


def placed_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rid (of docs, which is on_files()), doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law has no growing).

    A row's dice are its doc_id, size, crc and, among rows that have these alike, its number; so the result is the same however the
    table is cut into files, but for which of such rows is which. Only bucket sizes reach the driver: a number for every ROWS rows,
    BUCKETS numbers at most. Rows are shuffled without text: by what they have alike to find repeats, and by bucket; ranks are taken
    inside buckets and never inside a shard. Null text is empty; repeated rows each get a slot of their own, and many repeats of one
    row share no bucket."""
    spark = docs.sparkSession
    data = F.encode(normal_text(F.col("text")), "UTF-8")
    rows = with_row_id(docs).select("rid", "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    with scratch(spark) as kept:
        copies = stored(occurrences(rows.select("rid", F.struct("doc_id", "size", "text_crc32").alias("key"))), "occurrences")
        kept.append(copies.stored_at)
    rows = rows.join(copies, "rid", "left").withColumn("copy", F.coalesce("copy", F.lit(0)))
    rows = rows.withColumn("dice", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", "copy"))
    total = docs.count()
    buckets = min(BUCKETS, max(1, -(-total // ROWS)))
    rows = rows.withColumn("bucket", F.pmod("dice", F.lit(buckets)).cast("int"))
    sizes = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([sizes.get(b, 0) for b in range(buckets)], shards, seed)
    upto, before = matrix.cumsum(1), matrix.cumsum(0) - matrix
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("upto", T.ArrayType(T.LongType())), T.StructField("before", T.ArrayType(T.LongType()))])
    plan = spark.createDataFrame([(b, upto[b].tolist(), before[b].tolist()) for b in range(buckets)], schema)
    room = F.array(*(F.lit(int(x)).cast("long") for x in matrix.sum(0)))
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("dice", F.lit("local")), "doc_id", "size", "text_crc32", "copy")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(plan, "bucket")
    shard = F.size(F.filter("upto", lambda x: x <= F.col("rank")))
    ranked = ranked.withColumn("shard", shard.cast("int"))
    s = F.col("shard")
    begin = F.when(s > 0, F.element_at("upto", F.greatest(s, F.lit(1)))).otherwise(F.lit(0).cast("long"))
    place = F.element_at("before", s + 1) + F.col("rank") - begin
    slot = permuted(place, F.element_at(room, s + 1), F.lit(seed), s)
    return ranked.select("rid", "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """placed_rows() without rid."""
    return placed_rows(on_files(docs), shards, seed).drop("rid")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The exchange itself: documents (as the struct doc) in shard folders, each in slot order."""
    docs = on_files(docs)
    rows = with_row_id(docs.select(F.struct("*").alias("doc")))
    both = rows.join(placed_rows(docs, shards).select("rid", "shard", "slot"), "rid").select("shard", "slot", "doc")
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
